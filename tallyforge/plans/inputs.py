"""The views that the queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import estimates as O
from ..operators import normalize as N
from ..sources import views as V

FIELDS = "match_id, career_id, side, pick_order, champion_id"


def sql(body: str, base: str = V.SQL, recursive: bool = False) -> str:
    return f"with {'recursive ' * recursive}{base}\n{body}"


def raw(spark: SparkSession, d: str) -> DataFrame:
    return V.raw_contests(spark, d)


def contests(spark: SparkSession, d: str) -> DataFrame:
    """Valid contests, nested, with winner."""
    return N.with_winner(N.fixed_format(V.raw_contests(spark, d))).where("winner_side is not null")


def patches(spark: SparkSession) -> DataFrame:
    return V.patches(spark)


def events(spark: SparkSession, d: str) -> DataFrame:
    return V.patch_events(spark, d)


def facts(spark: SparkSession, d: str) -> DataFrame:
    return N.facts(V.raw_contests(spark, d), V.patches(spark), V.patch_events(spark, d))


def weighted(spark: SparkSession, d: str) -> DataFrame:
    return O.weighted(facts(spark, d), V.patches(spark), V.patch_events(spark, d))


def bans(spark: SparkSession, d: str) -> DataFrame:
    return N.bans(contests(spark, d))


def tiers(spark: SparkSession, d: str) -> DataFrame:
    return O.tier(weighted(spark, d), bans(spark, d))


def flag_text(df: DataFrame) -> DataFrame:
    return df.withColumn("include_scrim", F.col("include_scrim").cast("string"))
