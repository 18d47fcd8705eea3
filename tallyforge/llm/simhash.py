"""SimHash near-duplicates by deletion variants of two segments.

Two fingerprints that differ in at most two bits agree in one 32-bit segment but for at most one
bit. So each distinct fingerprint is indexed under segments with one bit wildcarded, and only
fingerprints that share such a variant are looked at. A variant that few fingerprints share gives
pairs, which are verified. One that many share is not expanded into pairs: its
fingerprints are indexed again under the same variant with the wildcards that the other segment
may still have, and all that share such a key are linked to its smallest member, which is exact
and linear in the group. Components then come from distributed union-find over distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, components, fresh, joined, stored

SEED = 42
#: Up to so many fingerprints of one variant are compared pair by pair;
#: beyond, the 2016 keys with two wildcards are fewer than a fingerprint's pairs.
PAIRWISE = 1024
_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, bytes(range(97, 123)))


def fingerprint(text: str | None, size: int = 3) -> int:
    """64-bit SimHash of word shingles with repeats; of a null or empty text 0."""
    words = WORD_BYTES.findall((text or "").encode().translate(_LOWER))
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.r_[0, ends[:-1]][: n - size + 1].tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n - size + 1)
    total = np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):
        total += np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(_BIT[total * 2 > len(h)].sum(dtype=np.uint64))


def _hashes(size: int) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(np.array([fingerprint(x, size) for x in t], np.uint64).view(np.int64))

    return F.pandas_udf(run, "long")


def with_fingerprint(docs: DataFrame, text_col: str = "text", size: int = 3, name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint appended as a long; no shuffle. Null and empty texts have fingerprint 0. A column of that name that is there already stays, and the new one gets an underscore."""
    return docs.withColumn(fresh(name, docs.columns), _hashes(size)(F.col(text_col)))


def _segment(fp: str, high: bool) -> str:
    return f"shiftrightunsigned({fp}, 32)" if high else f"({fp} & 4294967295L)"


def _variants(fps: DataFrame) -> DataFrame:
    """(key, w, fp): the 32 variants of the low segment with bit w wildcarded, and with w = 32 one of the high segment.

    Of two bits that differ, at most one is in the low segment, or both are: then the high segments are equal.
    So one wildcard of the high segment is enough, and each close pair has one variant of its own (see _OWN).
    """
    part = f"if(w < 32, {_segment('fp', False)}, {_segment('fp', True)})"
    return fps.selectExpr("fp", "explode(sequence(0, 32)) as w").selectExpr(f"shiftleft(cast(w as long), 32) | ({part} & ~shiftleft(1L, w % 32)) as key", "w", "fp")


#: Whether the pair (a, b) is close and is to be found under wildcard w: the low bit that differs, 0 if there is none, 32 if there are two.
_OWN = """bit_count(a ^ b) <= 2 and case bit_count((a ^ b) & 4294967295L)
  when 0 then w = 0 when 1 then w < 32 and shiftleft(1L, w) = ((a ^ b) & 4294967295L) else w = 32 end"""


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) such that components of links are
    the components of all pairs that differ in at most two bits; every link is such a pair."""
    v = _variants(fps)
    counted = v.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(joined(v, counted, "key"), "simhash-variants")
    few, many = shared.where(f"n <= {PAIRWISE}"), shared.where(f"n > {PAIRWISE}")
    pairs = joined(few.select("key", "w", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b")), "key").where(f"a > b and {_OWN}").select("a", "b")
    # Here all that share a key and the wildcards of the other segment are linked to the smallest: the wildcard w of the low
    # segment and one of the high one; no wildcard in one segment and two in the other.
    low, high = _segment("fp", False), _segment("fp", True)
    one = many.where("w < 32").selectExpr("key", "fp", "explode(sequence(0, 31)) as x").selectExpr("key", f"{high} & ~shiftleft(1L, x) as rest", "x as y", "fp")
    two = (
        many.where("w in (0, 32)")
        .selectExpr("fp", f"-1 - if(w = 0, {low}, shiftleft(1L, 32) | {high}) as key", f"if(w = 0, {high}, {low}) as o", "explode(sequence(0, 30)) as x")
        .selectExpr("fp", "key", "o", "x", "explode(sequence(x + 1, 31)) as z")
        .selectExpr("key", "o & ~shiftleft(1L, x) & ~shiftleft(1L, z) as rest", "32 + x * 32 + z as y", "fp")
    )
    dense = one.unionByName(two)
    least = dense.groupBy("key", "rest", "y").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).where("b < most")
    stars = joined(dense, least.select("key", "rest", "y", "b"), ["key", "rest", "y"]).where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = 3) -> DataFrame:
    """(id, fp, component_id): the smallest id reachable over links of at most two bits, itself included.

    Texts without words share fingerprint zero and are linked like any other. Null ids are not
    smaller than any id; rows with equal ids keep a row each.
    """
    rows = stored(docs.select(F.col(id_col).alias("_id"), _hashes(size)(F.col(text_col)).alias("fp")), "fingerprints").withColumnRenamed("_id", id_col)
    least = rows.groupBy("fp").agg(F.min(id_col).alias("low"))
    linked = components(links(least.select("fp")))
    of = joined(least, linked, least["fp"] == linked["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    low = of.groupBy("component").agg(F.min("low").alias("component_id"))
    to = joined(of, low, "component").select("fp", "component_id")
    return joined(rows, to, "fp").select(id_col, "fp", "component_id")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row: texts that are null or have no words share fingerprint 0, repeated rows keep a row each, an empty table gives none, and other columns are not read."""
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component: the one with the smallest id. Columns unchanged.

    Only ids are shuffled against the verdicts' side; rows whose id is null are kept.
    """
    c = classes(docs.where(F.col(id_col).isNotNull()), text_col, id_col)
    gone = c.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(gone.hint("merge"), id_col, "left_anti").select(*(F.col(f"`{x}`") for x in docs.columns))
