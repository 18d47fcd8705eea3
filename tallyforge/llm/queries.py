"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fim, idcodec, lexical, linedup, media, nbsvm, packing, rlz, rules, secretscan, simhash
from .common import stored, table


def op1_naive_bayes_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_features(stored(media.store_texts(table(spark, sf_dir, "documents")), "media"))


def op3_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op4_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_context_mixing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idcodec.read_documents(idcodec.write_documents(table(spark, sf_dir, "documents")))


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.report(table(spark, sf_dir, "documents"))


def op7_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprints(table(spark, sf_dir, "documents"))


def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat.digests(rows.unionByName(chat.extra(spark)))


def op10_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.report(table(spark, sf_dir, "documents"))


def op11_best_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.report(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_naive_bayes_svm,
        op2_media_columns,
        op3_bpe_automaton,
        op4_isolation_rules,
        op5_context_mixing_ids,
        op6_fuzzy_lines,
        op7_simhash_variants,
        op8_vector_packing,
        op9_chat_formatting,
        op10_relative_lz,
        op11_best_position,
        op12_blob_ledger,
        op13_fill_in_middle,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op9_chat_formatting": chat.DIGESTS_SQL,
        "op11_best_position": lexical.SEARCH_SQL,
        "op12_blob_ledger": secretscan.REPORT_SQL,
        "op13_fill_in_middle": fim.DIGESTS_SQL,
    }
