"""From documents to packed training sequences: five stages, each written as Parquet and read by the next.

Quality rules, fuzzy line deduplication, near-duplicates by five-word shingles, substring deduplication, packing. Each stage
works on all rows that the one before kept and returns the columns of documents; the last returns
the pieces of packed sequences.

Nulls and edges: a null or empty text has too few words and goes with the first stage, so the later ones see words only; rows with a null id are judged and
packed like others, but lose no lines and are no near-duplicates of any. Rows with equal id and text are kept or dropped together. Extra columns of any name are passed on up to
packing. An empty table gives an empty result. Without labels of both kinds the forest rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import linedup, neardup, packing, rlz, rules
from tallyforge.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules and the isolation forest keep; texts that are null or have fewer than 50 words go."""
    return rules.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that are similar to an earlier line of the corpus; a document that is left without a word goes."""
    return linedup.remove(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each component of five-word Jaccard similarity 0.8 or more; candidates are SimHash components and bands of minima."""
    return neardup.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without word spans that occur earlier in the corpus; a document that is left without a word goes."""
    return rlz.remove(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences: a row each, with its document, place and sequence."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]

#: The forest, MinHash and packing are not expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all stages applied to ``documents`` of ``sf_dir``, each but the last written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
