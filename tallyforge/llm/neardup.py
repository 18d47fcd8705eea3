"""Near-duplicate documents by SimHash and MinHash over five-word shingles, verified by exact Jaccard similarity.

Texts with equal words (ASCII letters in lower case) become one row first. SimHash components and bands of minima give candidates, which are
compared as long as they are not yet connected (see ``common.clusters``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import WORD_BYTES, clusters, delete, joined, stored
from .simhash import _LOWER

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 5, 14
_RNG = np.random.default_rng(42)
_TIMES = _RNG.integers(0, 1 << 63, (ROWS * BANDS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, (ROWS * BANDS, 1), np.uint64)


def _words(text: str | None) -> list[bytes]:
    return WORD_BYTES.findall((text or "").encode().translate(_LOWER))


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of five-word shingles; a shorter text is one shingle, one without words too."""
    w = _words(text)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(w[i : i + SHINGLE])) for i in range(max(1, len(w) - SHINGLE + 1))), np.uint64))


def bands(text: str | None) -> np.ndarray:
    h, low = shingles(text), np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 1024):
        low = np.minimum(low, (h[i : i + 1024] * _TIMES + _PLUS).min(1))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), b) for b, x in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _bands(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield pd.Series([bands(x) for x in t])


def _key(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield pd.Series(np.array([xxhash.xxh64_intdigest(b" ".join(_words(x))) for x in t], np.uint64).view(np.int64))


def _close(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for x, y in pairs:
        sets = ((shingles(p), shingles(q)) for p, q in zip(x, y, strict=True))
        counts = ((len(p) + len(q), len(np.intersect1d(p, q, assume_unique=True))) for p, q in sets)
        yield pd.Series([both >= SIMILARITY * (n - both) for n, both in counts], dtype=bool)


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (a, b, ...) whose texts, by texts (k, text), are similar."""
    a, b = texts.select(F.col("k").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("k").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where(F.pandas_udf(_close, "boolean")("text_a", "text_b")).select(*pairs.columns)


#: Residue bands of a row: the least shingle of each of so many bins.
RESIDUE = 16


def _residue(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for x, y in pairs:
        out = []
        for p, q in zip(x, y, strict=True):
            h, hub = shingles(p), shingles(q)
            own, lacks = np.setdiff1d(h, hub, assume_unique=True), np.setdiff1d(hub, h, assume_unique=True)
            chosen = [(0, own)] + ([(1, lacks)] if 8 * len(own) < len(lacks) else [])
            # Sorted, so the first of a bin is its least.
            out.append(np.array([xxhash.xxh64_intdigest(v.tobytes(), sign) for sign, s in chosen for v in s[np.unique(s >> np.uint64(8) & np.uint64(RESIDUE - 1), return_index=True)[1]]], np.uint64).view(np.int64))
        yield pd.Series(out)


def residue(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(band, k) of the residue of rows (band, k, hub), by texts (k, text): the least of each bin of the shingles that the hub lacks, and if these are few, of those that the row lacks."""
    pairs, hub = rows.select("k", "hub").distinct(), texts.select(F.col("k").alias("hub"), F.col("text").alias("hub_text"))
    both = pairs.join(texts.hint("merge"), "k").join(hub.hint("merge"), "hub")
    each = both.select("k", "hub", F.explode(F.pandas_udf(_residue, "array<long>")("text", "hub_text")).alias("h"))
    return joined(rows, each, ["k", "hub"]).select(F.xxhash64("band", "hub", "h").alias("band"), "k")


def components_of_texts(texts: DataFrame) -> DataFrame:
    """(node, component) of the keys of distinct texts (k, text) that are similar to another.

    Candidates are texts of one SimHash component (see ``simhash``) over the same shingles, and texts that share a band of minima.
    """
    spark = texts.sparkSession
    near = simhash.classes(texts, "text", "k", SHINGLE).select("k", F.xxhash64(F.lit("simhash"), "component_id").alias("band"))
    each = stored(texts.select("k", F.explode(F.pandas_udf(_bands, "array<long>")("text")).alias("band")).unionByName(near), "near-bands")
    shared = each.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    members = stored(joined(each, shared, "band"), "near-members")
    delete(spark, each)
    found = clusters(members, lambda pairs: similar(pairs, texts), lambda rows: residue(rows, texts))
    delete(spark, members)
    return found


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component of similar ones: the smallest id. Columns unchanged; rows whose id is null are kept, and so are all
    rows of the id that stays. Texts without words are equal. An empty table stays empty."""
    rows = stored(docs.where("doc_id is not null").select("doc_id", "text").withColumn("k", F.pandas_udf(_key, "long")("text")), "near-keys")
    texts = stored(rows.groupBy("k").agg(F.first("text").alias("text")), "near-texts")
    member = components_of_texts(texts)
    of = joined(rows.select("doc_id", "k"), member, F.col("k") == member["node"], "left").select("doc_id", F.coalesce("component", "k").alias("c"))
    first = of.groupBy("c").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    gone = joined(of, first, "c").where("doc_id <> low").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*(F.col(f"`{x}`") for x in docs.columns))
