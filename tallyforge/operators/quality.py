"""Integrity rules over the facts, and canonical digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rule name to a condition that a row violates.
ROW_RULES = {
    "pick_order": "pick_order not between 1 and 4",
    "champion_known": "champion_id not between 1 and 40",
    "official_dated": "match_type = 'OFFICIAL' and (season is null or day is null)",
    "change_count": "change_count < 0",
    "healing_known": "healing is null",
}


def report(facts: DataFrame, bans: DataFrame) -> DataFrame:
    """(rule, violations): all row rules in one pass, group rules from one grouping each."""
    rows = facts.agg(*(F.count_if(F.expr(v)).alias(k) for k, v in ROW_RULES.items()))
    sides = facts.groupBy("match_id").agg(F.count_if(F.col("side") == "BLUE").alias("b"), F.count_if(F.col("side") == "RED").alias("r"), F.count("*").alias("n"), F.count_distinct("champion_id").alias("d"))
    group = sides.agg(F.coalesce(F.sum(F.expr("int(b <> 4 and b > 0) + int(r <> 4 and r > 0)")), F.lit(0)).cast("bigint").alias("side_size"), F.count_if(F.expr("n <> d")).alias("champion_once"))
    once = bans.groupBy("match_id").agg(F.count_distinct("champion_id").alias("d")).agg(F.count_if(F.expr("d <> 6")).alias("ban_once"))

    def long(df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("rule"), F.col(c).alias("violations")) for c in df.columns))).alias("x")).select("x.*")

    return long(rows).unionByName(long(group)).unionByName(long(once))


def valid_observations(facts: DataFrame) -> DataFrame:
    """Contests with both sides, no champion twice, and no negative change count."""
    g = facts.groupBy("career_id", "match_id").agg(F.count_if(F.col("side") == "BLUE").alias("b"), F.count_if(F.col("side") == "RED").alias("r"), F.count("*").alias("n"), F.count_distinct("champion_id").alias("d"), F.min("change_count").alias("low"))
    return g.where("b > 0 and r > 0 and n = d and low >= 0").select("career_id", "match_id")


def canonical_digest(rows: DataFrame, by: list[str], order: str, fields: list[str], per_range: int = 1024) -> DataFrame:
    """(by, range, rows, digest): sha-256 over the rows of a set in order, fields and rows joined by fixed separators.

    A set is cut into ranges of ``per_range`` values of ``order``, so that no group grows with the set.
    """
    line = F.concat_ws(":", *fields)
    ranged = rows.withColumn("range", F.floor(F.col(order) / per_range).cast("bigint"))
    return ranged.groupBy(*by, "range").agg(F.count("*").alias("rows"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("x")).select(*by, "range", "rows", F.sha2(F.array_join(F.transform("x", lambda s: s["l"]), ","), 256).alias("digest"))


def digest(rows: DataFrame, order: str, buckets: int = 1024) -> DataFrame:
    """An order-free digest at any size: sha-256 of each row, summed in hash buckets; equal tables have equal rows."""
    h = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    return rows.select(F.pmod(F.xxhash64(order), F.lit(buckets)).alias("bucket"), F.conv(F.substring(h, 1, 15), 16, 10).cast("decimal(38,0)").alias("v")).groupBy("bucket").agg(F.count("*").alias("rows"), F.sum("v").alias("total"))


def mismatches(actual: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Keys whose digest differs from the manifest's, or that only one side has."""
    a, m = actual.select(key, F.col("digest").alias("_a")), manifest.select(key, F.col("digest").alias("_m"))
    return a.join(m, key, "full_outer").where("not (_a <=> _m)").select(key, F.col("_a").alias("actual"), F.col("_m").alias("expected"))


def reconciled(actual: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, state, rows, expected_rows) of the record sets whose digests (keys, rows, digest) are not those of a manifest: 'missing' from the records, 'extra' there, or
    'changed'. Keys may be null, and a null key is a key like others; both sides are as many as there are ranges of records."""
    a, m = actual.select(*keys, F.col("rows").alias("_r"), F.col("digest").alias("_d"), F.lit(True).alias("_a")), manifest.select(*(F.col(k).alias(f"_m_{k}") for k in keys), F.col("rows").alias("_s"), F.col("digest").alias("_e"), F.lit(True).alias("_m"))
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_m_{k}")) for k in keys))
    joined = a.join(m, same, "full_outer").where("_a is null or _m is null or not (_d <=> _e)")
    names = [F.when(F.col("_a").isNull(), F.col(f"_m_{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    return joined.select(*names, F.when(F.col("_a").isNull(), "missing").when(F.col("_m").isNull(), "extra").otherwise("changed").alias("state"), F.col("_r").alias("rows"), F.col("_s").alias("expected_rows"))


def row_counts(tables: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """(name, rows, complete): how many rows each seeded dimension has, and whether that is the number expected. ``require`` makes a failure of it."""
    each = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows", (F.col("rows") == F.lit(expected[name])).alias("complete")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, each)


def require(counts: DataFrame) -> None:
    """An error that names the dimensions without the expected number of rows."""
    bad = [f"{r['name']} has {r['rows']} rows" for r in counts.where("not complete").collect()]
    if bad:
        raise ValueError("; ".join(bad))
