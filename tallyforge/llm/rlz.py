"""Substring deduplication: duplicate word windows, merged into factors.

A window of words is a duplicate if its words also start at an earlier place of the corpus: a smaller document, or the
same one further to the left. The index keeps the earliest place of each window, its owner. A document's factors
are the longest runs of windows that it does not own, so a factor runs on across the seams between the
sources that it is copied from, and what straddles a seam is found as well. Factors are at least a window long and
become duplicate spans. This stands in for a relative Lempel-Ziv parse with a source position for each factor: what is removed
depends only on which windows have an earlier place, and to send the place of every duplicate window
back to its document would more than double what is shuffled.

Most windows occur once, and those are not indexed. Each window has an anchor, the smallest hash of the
short word groups inside it; equal windows have equal anchors. Anchors are counted over the whole
corpus (combined before the shuffle), and only windows whose anchor occurs at two places or more enter the
index. Whole copies of a document are found by a digest of its words and left out of the index.

A document is a row: of rows with equal ids the texts tell them apart (by a hash), and their order is that of the hashes. Rows
with equal id and text are one document. Words are compared by 64-bit hashes, windows by 96 bits made from those.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, WORD_BYTES, joined, release, stored, with_columns

WINDOW = 20
GROUP = 6
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1024), _A, np.uint64)]).cumprod(dtype=np.uint64)
    return _powers[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, in order, over the UTF-8 bytes at once."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    flat = raw[inside[1:-1]].astype(np.uint64) + np.uint64(1)
    first = np.r_[0, np.cumsum(size)[:-1]]
    flat *= _power(int(size.max()))[np.arange(len(flat)) - np.repeat(first, size)]
    return _mix(np.add.reduceat(flat, first) + size.astype(np.uint64) * _B)


def group_hashes(words: np.ndarray, size: int, by: np.uint64 = _A) -> np.ndarray:
    """A hash of every ``size`` consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * by + words[k : n + k]
    return _mix(total)


def anchors(words: np.ndarray, window: int, group: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every window: the position and the hash of its anchor (the leftmost of the smallest)."""
    g = group_hashes(words, group)
    span = window - group + 1
    if len(g) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(g) - span + 1
    at = np.empty(n, np.int64)
    for k in range(0, n, 65536):
        at[k : k + 65536] = np.lib.stride_tricks.sliding_window_view(g[k : k + 65536 + span - 1], span).argmin(1)
    at += np.arange(n)
    return at, g[at]


def _profile(docs: DataFrame, window: int, group: int) -> DataFrame:
    """doc_id, tie, n_words, a 128-bit digest of the words, and the distinct anchors with how often each occurs (2: or more)."""

    def one(text: str | None) -> tuple:
        w = word_hashes(text)
        if len(w) < window:
            return len(w), 0, 0, [], []
        at, h = anchors(w, window, group)
        new = np.r_[True, at[1:] != at[:-1]]
        kinds, n = np.unique(h[new], return_counts=True)
        digest = sha256(w.tobytes()).digest()
        return len(w), int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:16], "little", signed=True), kinds.view(np.int64), np.minimum(n, 2).astype(np.int8)

    fields = [T.StructField("n_words", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("anchors", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.ByteType()))]
    source = docs.select("doc_id", "tie", "text")
    made = source.mapInArrow(with_columns(source.schema, fields, lambda b: [*zip(*map(one, b.column(2).to_pylist()), strict=True)]), T.StructType([*source.schema.fields, *fields]))
    return stored(made.drop("text"), "anchors")


def _candidates(text: str | None, hits: np.ndarray, window: int, group: int) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of a text and the starts of its windows whose anchor is in ``hits`` (sorted)."""
    w = word_hashes(text)
    _, h = anchors(w, window, group)
    if not len(h) or not len(hits):
        return w, np.zeros(0, np.int64)
    return w, np.flatnonzero(hits[np.minimum(np.searchsorted(hits, h), len(hits) - 1)] == h)


def _hits(value: pa.Scalar) -> np.ndarray:
    return np.sort(np.asarray(value.values, np.int64).view(np.uint64))


def _windows(marked: DataFrame, window: int, group: int) -> DataFrame:
    """(w1, w2, doc_id, tie, start) of each window whose anchor is in ``hits``."""
    schema = T.StructType([T.StructField("w1", T.LongType()), T.StructField("w2", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("tie", T.IntegerType()), T.StructField("start", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                w, start = _candidates(b.column(2)[k].as_py(), _hits(b.column(3)[k]), window, group)
                if not len(start):
                    continue
                one, two = group_hashes(w, window)[start], group_hashes(w, window, _B)[start]
                ids, tie = pa.array(np.full(len(start), b.column(0)[k].as_py(), np.int64)), pa.array(np.full(len(start), b.column(1)[k].as_py(), np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32)), ids, tie, pa.array(start.astype(np.int32))], names=schema.names)

    return marked.select("doc_id", "tie", "text", "hits").mapInArrow(run, schema)


#: A part of a document's name beside its id, from the text: rows that share an id differ in it if their texts do.
TIE = "cast(xxhash64({text}) & 2147483647 as int)"


def factors(docs: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """(doc_id, tie, start, length) in words of every duplicate factor; a whole copy of a document is one factor.

    ``docs`` needs doc_id, an integer, and text. Rows with null ids or texts have no factors. An empty table has none.
    """
    spark, doc = docs.sparkSession, ["doc_id", "tie"]
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(TIE.format(text="text")).alias("tie"), "text")
    p = _profile(docs, window, group)
    long = p.where(f"n_words >= {window}")
    place = F.struct(*doc)
    first = long.groupBy("d1", "d2").agg(F.min(place).alias("source"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = stored(joined(long.select(*doc, "n_words", "d1", "d2"), first, ["d1", "d2"]).where("struct(doc_id, tie) <> source").select(*doc, "n_words").distinct(), "copies")
    # What grows with the corpus is always joined by sorting.
    own = long.join(copies.select(*doc).hint("merge"), doc, "left_anti").select(*doc, F.explode(F.arrays_zip("anchors", "times")).alias("x"))
    own = own.select(*doc, F.col("x.anchors").alias("h"), F.col("x.times").alias("times"))
    # Repeated rows are one document, but what they hold counts twice here: that only makes more windows enter the index.
    shared = own.groupBy("h").agg(F.sum("times").alias("n")).where("n > 1").select("h")
    hits = stored(joined(own.select(*doc, "h"), shared, "h").groupBy(*doc).agg(F.collect_set("h").alias("hits")), "hits")
    release(spark, p)
    marked = stored(docs.join(hits.hint("merge"), doc), "marked")
    release(spark, hits)
    # The earliest place of every window owns it. It is found by a minimum that is combined before the shuffle, and only owners go back.
    # A place is one number: id, tie, start.
    number = (F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("tie")).cast("decimal(28,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("start")
    owners = _windows(marked, window, group).groupBy("w1", "w2").agg(F.min(number.cast("decimal(38,0)")).alias("place"))
    low = "pmod(place, 4611686018427387904BD)"
    owned = owners.selectExpr("cast(floor(place / 4611686018427387904BD) as long) as doc_id", f"cast(floor({low} / 2147483648BD) as int) as tie", "cast(pmod(place, 2147483648BD) as int) as start")
    owned = owned.groupBy(*doc).agg(F.collect_list("start").alias("owned"))
    source = marked.join(owned.hint("merge"), doc, "left").select(*doc, "text", "hits", "owned")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("tie", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int, int]] = []
            for k in range(b.num_rows):
                w, start = _candidates(b.column(2)[k].as_py(), _hits(b.column(3)[k]), window, group)
                copied = np.zeros(len(w) + 1, bool)
                copied[start] = True
                mine = b.column(4)[k].values
                copied[np.asarray(mine if mine is not None else [], np.int64)] = False
                # A factor takes windows as long as each, across the seams between sources too, is found earlier.
                edge = np.flatnonzero(np.diff(np.r_[False, copied].astype(np.int8)))
                out += [(b.column(0)[k].as_py(), b.column(1)[k].as_py(), int(i), int(j - i - 1 + window)) for i, j in zip(edge[::2], edge[1::2], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int32() if c == 1 else pa.int64()) for c in range(4)], names=schema.names)

    found = stored(source.mapInArrow(run, schema).unionByName(copies.select(*doc, F.lit(0).cast("long").alias("start"), F.col("n_words").alias("length"))), "factors")
    release(spark, marked, copies)
    return found


def _marked(docs: DataFrame, window: int, group: int) -> DataFrame:
    """(row, spans): each row of ``docs`` as a struct, and the duplicate factors (start, length in words) of its document, or null."""
    by = factors(docs, window, group).groupBy("doc_id", "tie").agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    on = (F.col("row.doc_id") == by["doc_id"]) & (F.expr(TIE.format(text="row.text")) == by["tie"])
    return rows.join(by.hint("merge"), on, "left").select("row", "spans")


def _mask(n: int, spans: list[dict] | None) -> np.ndarray:
    gone = np.zeros(n, bool)
    for s in spans or []:
        gone[s["start"] : s["start"] + s["length"]] = True
    return gone


def report(docs: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space). A null text has no words; an empty table gives no rows."""
    source = _marked(docs.select("doc_id", "text"), window, group).select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), "spans")
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]

    def one(text: str | None, spans: list[dict] | None) -> tuple:
        words = WORD_BYTES.findall((text or "").encode())
        gone = _mask(len(words), spans)
        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if spans else words
        return len(words), int(gone.sum()), sha256(b" ".join(kept)).hexdigest()

    compute = with_columns(source.schema, fields, lambda b: [*zip(*map(one, b.column(1).to_pylist(), b.column(2).to_pylist()), strict=True)])
    return source.mapInArrow(compute, T.StructType([*source.schema.fields, *fields])).select("doc_id", "n_words", "n_removed", "kept_sha256")


def remove(docs: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """``docs`` without duplicate spans: each span goes with the white space before it, the rest of the text is unchanged.

    Documents that lose all their words go; n_chars, if there, is set anew. Columns, whatever their names, and other rows are unchanged.
    """
    source = _marked(docs, window, group)
    source = source.select("row", F.col("row.text").alias("text"), "spans")

    def one(text: str | None, spans: list[dict] | None) -> str | None:
        if text is None or not spans:
            return text
        words = [*WORD.finditer(text)]
        gone = _mask(len(words), spans).tolist()
        out, last = [], 0
        for m, g in zip(words, gone, strict=True):
            if not g:
                out.append(text[last : m.end()])
            last = m.end()
        return "".join(out).lstrip(" \t\n\v\f\r")

    field = [T.StructField("kept", T.StringType())]
    compute = with_columns(source.schema, field, lambda b: [[*map(one, b.column(1).to_pylist(), b.column(2).to_pylist())]])
    out = source.mapInArrow(compute, T.StructType([*source.schema.fields, *field])).where("spans is null or kept <> ''")
    new = {"text": F.col("kept")} | ({"n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*((new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns))
