"""Fill-in-the-middle transformation by a secondary sort.

A text is cut into lines (units); two boundaries between units, drawn from a hash of the document's id, part it into prefix, middle and
suffix, which are put in another order with a marker before each. No task assembles a whole output: every part travels as pieces of at most
``PIECE`` characters, keyed by document and output position. ``repartitionAndSortWithinPartitions`` brings
the pieces of a document to one task in order, which streams them into an incremental digest. The stream is
parsed at its markers, as a reader of the output would, and the parts are sorted once more within the partition, by their place in the text, for the
digest of the restored text. So a text is shuffled once, and memory holds a piece, not a document.

Nulls: a null text is empty. A null id draws its boundaries as the id ``null`` would. Rows are transformed one by one, so repeated rows give
repeated results. A text that is empty or holds a marker stays as it is (plain). Only the columns doc_id and text are read, whatever others there are; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups_for

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Parts in the order of each form's output; places in the text are those of PLACE.
FORMS = {"plain": "", "psm": "psm", "spm": "spm"}
ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
PLACE = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
PIECE = 1 << 15
PARTITION = 1 << 26


@dataclass(frozen=True)
class Settings:
    """seed: of the draws; rate, spm: percent of texts that are transformed, and of these in suffix-first form."""

    seed: int = 7
    rate: int = 100
    spm: int = 50


@dataclass(frozen=True)
class Cut:
    """How a text is parted: n units, and the code points at which prefix and middle end (None: plain)."""

    n: int
    form: str
    first: int | None = None
    second: int | None = None


def unit_ends(text: str) -> np.ndarray:
    """Code points at which the lines of a text end, each with its line break."""
    ends = np.cumsum([len(x) + 1 for x in text.split("\n")])
    ends[-1] -= 1
    return ends[:-1] if len(ends) > 1 and ends[-1] == ends[-2] else ends if text else ends[:0]


def cut(doc_id: int | None, text: str, settings: Settings) -> Cut:
    ends = unit_ends(text)
    n = len(ends)
    drawn = hashlib.sha256(f"{settings.seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in PLACE) or h3 % 100 >= settings.rate:
        return Cut(n, "plain")
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    at = [0, *ends.tolist()]
    return Cut(n, "spm" if h4 % 100 < settings.spm else "psm", at[a], at[b])


def parts(text: str, how: Cut) -> list[tuple[str, str]]:
    """(marker, part) in output order; a plain text is one part without marker."""
    if how.form == "plain":
        return [("", text)]
    of = {PREFIX: text[: how.first], MIDDLE: text[how.first : how.second], SUFFIX: text[how.second :]}
    return [(m, of[m]) for m in ORDER[how.form]]


PIECES = "doc_id long, tie long, copy long, position long, piece binary, n long, form string, prefix_chars long, middle_chars long"


def pieces(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The output of each row as pieces (doc_id, tie, copy, position, piece, n, form, prefix_chars, middle_chars); the last four at position 0 only.

    ``tie`` is a hash of the text; ``copy`` tells apart equal rows of one partition, and its partition's number is part of it.
    """

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        copy = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                how = cut(doc_id, text, settings)
                key = (doc_id, xxhash.xxh64_intdigest(text.encode()) >> 1, copy)
                about = (how.n, how.form, how.first, None if how.first is None else how.second - how.first)
                position, copy = 0, copy + 1
                for marker, part in parts(text, how):
                    for k in range(0, len(part) or 1, PIECE):
                        piece = ((marker if k == 0 else "") + part[k : k + PIECE]).encode()
                        rows.append((*key, position, piece, *(about if position == 0 else (None,) * 4)))
                        position, size = position + 1, size + len(piece)
                if size > 1 << 24:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(emit, PIECES)


_ARROW = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("copy", pa.int64()), ("position", pa.int64()), ("piece", pa.binary()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def assembled(docs: DataFrame, settings: Settings = Settings()) -> RDD:
    """((doc_id, tie, copy, position), (piece, about)) sorted within partitions, with all pieces of a document in one.

    Documents are dealt by id and text hash, which a repeated task attempt computes alike, to as many partitions as keep each at about ``PARTITION`` bytes.
    """
    made = pieces(docs, settings)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    keyed = made.rdd.map(lambda r: ((-1 if r[0] is None else r[0], r[1], r[2], r[3], r[0] is None), (bytes(r[4]), None if r[6] is None else tuple(r[5:9]))))
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups_for(size, PARTITION))
    return keyed.repartitionAndSortWithinPartitions(n, lambda key: xxhash.xxh64_intdigest(f"{key[0]}:{key[1]}") & 0x7FFFFFFF)


class Parser:
    """Parses streamed output at its markers: ``feed`` returns (place, bytes) of what is complete."""

    def __init__(self, form: str):
        self.markers = [m.encode() for m in ORDER.get(form, ())]
        self.place, self.carry = 0, b""

    def feed(self, data: bytes) -> list[tuple[int, bytes]]:
        data, found = self.carry + data, []
        while self.markers:
            at = data.find(self.markers[0])
            if at < 0:
                break
            found.append((self.place, data[:at]))
            marker = self.markers.pop(0)
            self.place, data = PLACE[marker.decode()], data[at + len(marker) :]
        held = len(PREFIX) - 1 if self.markers else 0
        self.carry = data[len(data) - min(held, len(data)) :] if held else b""
        found.append((self.place, data[: len(data) - len(self.carry)]))
        return [x for x in found if x[1]]

    def close(self) -> list[tuple[int, bytes]]:
        return [(self.place, self.carry)] if self.carry else []


RESORTED = "doc_id long, tie long, copy long, place int, seq long, piece binary, n long, form string, prefix_chars long, middle_chars long, output_sha256 string"


def _stream(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Pieces with their place in the text, read from the sorted output; a row of place -1 carries the digest of the output of each document."""
    key = about = digest = parser = None
    seq = 0
    for (doc_id, tie, copy, _, missing), (piece, given) in rows:
        if key != (doc_id, tie, copy, missing):
            if key is not None:
                yield from _last(key, about, digest, parser, seq)
            key, about, digest, parser, seq = (doc_id, tie, copy, missing), given, hashlib.sha256(), Parser(given[1]), 0
        digest.update(piece)
        for place, part in parser.feed(piece):
            yield (None if missing else doc_id, tie, copy, place, seq, part, None, None, None, None, None)
            seq += 1
    if key is not None:
        yield from _last(key, about, digest, parser, seq)


def _last(key: tuple, about: tuple, digest, parser: Parser, seq: int) -> Iterator[tuple]:
    row = (None if key[3] else key[0], key[1], key[2])
    for place, part in parser.close():
        yield (*row, place, seq, part, None, None, None, None, None)
    yield (*row, -1, 0, b"", *about, digest.hexdigest())


REPORT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def _restore(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the texts whose pieces arrive in the order of the text, each after its row of place -1."""
    names = [x.split()[0] for x in REPORT.split(", ")]
    row, digest = None, None
    for batch in batches:
        done = []
        for place, piece, *given in zip(*(batch.column(k).to_pylist() for k in (3, 5, 0, 6, 7, 8, 9, 10)), strict=True):
            if place == -1:
                if row is not None:
                    done.append((*row, digest.hexdigest()))
                row, digest = given, hashlib.sha256()
            else:
                digest.update(piece)
        if done:
            yield _report(done, names)
    if row is not None:
        yield _report([(*row, digest.hexdigest())], names)


def _report(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string() if x.endswith("sha256") or x == "form" else pa.int64() for x in names]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def digests(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256. Counts are of code points, null if plain."""
    stream = assembled(docs, settings).mapPartitions(_stream)
    resorted = docs.sparkSession.createDataFrame(stream, RESORTED, verifySchema=False).sortWithinPartitions("doc_id", "tie", "copy", "place", "seq")
    return resorted.mapInArrow(_restore, REPORT)


def outputs(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, form, output): the transformed texts themselves, each joined from its pieces."""

    def join(rows: Iterable[tuple]) -> Iterator[tuple]:
        key, form, held = None, None, []
        for (doc_id, tie, copy, _, missing), (piece, given) in rows:
            if key != (doc_id, tie, copy, missing):
                if key is not None:
                    yield (None if key[3] else key[0], form, b"".join(held).decode())
                key, form, held = (doc_id, tie, copy, missing), given[1], []
            held.append(piece)
        if key is not None:
            yield (None if key[3] else key[0], form, b"".join(held).decode())

    return docs.sparkSession.createDataFrame(assembled(docs, settings).mapPartitions(join), "doc_id long, form string, output string", verifySchema=False)


def restored(output: str, form: str) -> str:
    """The text of an output, by its form."""
    parser = Parser(form)
    found = parser.feed(output.encode()) + parser.close()
    return b"".join(part for _, part in sorted(found, key=lambda x: x[0])).decode()


DIGESTS_SQL = r"""
with cut as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u,
    sha256('7:' || coalesce(cast(doc_id as varchar), 'null')) as h from documents),
drawn as (
  select *, len(u) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from cut),
parted as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain'
      when h4 % 100 < 50 then 'spm' else 'psm' end as form from drawn),
joined as (
  select *, coalesce(array_to_string(u[1:a], ''), '') as p, coalesce(array_to_string(u[a + 1:b], ''), '') as m, coalesce(array_to_string(u[b + 1:], ''), '') as s from parted)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(p || m || s) as restored_sha256
from joined
"""
