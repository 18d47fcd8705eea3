"""Serving over the fitted effects, against the SQL of the plain queries run on the same effects; sides of sets, next pieces, line-up scores."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import season as S
from tallyforge.operators import serving as V
from tallyforge.plans import inputs as I
from tallyforge.plans import registry, serving
from tests.test_oracle import rows

PAIRS = {
    "f7_fitted_pairs": None,
    "f8_fitted_top": "f8_bucket_top",
    "f9_fitted_warnings": "f9_warnings",
    "g2_fitted_candidates": "g2_counter_candidates",
    "g3_fitted_counters": None,
    "g6_fitted_unexplored": "g6_unexplored_pairs",
}


@pytest.fixture(scope="module")
def fitted(spark):
    """Effects of the ridge fit at sf0.01, where pairs have enough observations, as a DuckDB table."""
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{sf}/{f}')")
    # Four times as large, since the tables are noise and few effects would pass a threshold.
    effects = serving.fitted_effects(spark, sf).withColumn("effect", F.round(4 * F.col("effect"), 3)).cache()
    con.register("fitted", effects.toPandas())
    return sf, con, effects


def over_fitted(sql):
    """The plain query's SQL with its effects replaced by the fitted ones."""
    a = sql.index("ef as (")
    b = sql.index("\npv as (")
    return f"{sql[:a]}ef as (select career_id, metric, side, subject, other, observations, effect from fitted),{sql[b:]}"


@pytest.mark.parametrize("name", sorted(PAIRS))
def test_fitted_queries(spark, fitted, monkeypatch, name):
    sf, con, effects = fitted
    assert effects.count() > 500
    monkeypatch.setattr(serving, "fitted_effects", lambda *_: effects)
    monkeypatch.setattr(serving, "known_pairs", lambda s, d, _=None: effects.where("side = 'ALLY'").select("career_id", F.least("subject", "other").alias("a"), F.greatest("subject", "other").alias("b")).distinct())
    sql = registry.oracle_sql()
    plain = {
        "f7_fitted_pairs": sql["f5_buckets"].replace("select career_id, side, subject, other, bucket from cl", "select career_id, side, subject, other, bucket, round(rank_value, 6) as rank_value, lead_metric, favourable, signature from cl"),
        "g3_fitted_counters": sql["g3_best_counters"].replace("select career_id, champion_id, target, observations from", "select career_id, champion_id, target, observations, (observations < 20)::int as to_test from"),
    }.get(name) or sql[PAIRS[name]]
    df = registry.queries()[name](spark, sf)
    cur = con.execute(over_fitted(plain))
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    got = rows(df.columns, df.collect())
    assert got == rows(names, cur.fetchall()) and got


def test_deck_scores(spark):
    decks = spark.createDataFrame([(1, 0, k, c, t) for k, (c, t) in enumerate(((5, 9), (2, None), (7, 8), (3, None)))], "career_id int, deck int, slot int, champion_id long, target long")
    known = spark.createDataFrame([(1, 2, 3), (1, 5, 7), (2, 2, 5)], "career_id int, a long, b long")
    tried = spark.createDataFrame([(1, 2, 3), (1, 2, 5)], "career_id int, a long, b long")
    r = V.deck_scores(decks, known, tried).first()
    assert (r["known"], r["tried"], r["unexplored"], r["targets"]) == (2, 1, 3, 2)


def test_sides_of_match(spark):
    schema = "k int, n int, blue_team_id int, red_team_id int, winner_side string, blue_picks array<int>, red_picks array<int>"
    sets = spark.createDataFrame([(1, 1, 5, 6, "BLUE", [1], [2]), (1, 2, 6, 5, "BLUE", [3], [4]), (1, 3, 6, 5, None, [], None)], schema)
    match = spark.createDataFrame([(1, 5, 6)], "k int, blue_team_id int, red_team_id int")
    got = {r["n"]: (r["swapped"], r["blue_team_id"], r["winner_side"], r["blue_picks"], r["red_picks"]) for r in S.sides_of_match(sets, match, ["k"], ["picks"]).collect()}
    assert got == {1: (False, 5, "BLUE", [1], [2]), 2: (True, 5, "RED", [4], [3]), 3: (True, 5, None, None, [])}
    with pytest.raises(Exception, match="a set of teams 5 7 in a match of 5 6"):
        S.sides_of_match(sets.limit(1).withColumn("red_team_id", F.lit(7)), match, ["k"], ["picks"]).collect()


def test_next_unwritten(spark):
    c = spark.createDataFrame([(1, 1, 5, 10), (1, 2, 3, 12), (1, 2, 3, 11), (2, 1, 1, None), (3, 1, 1, 20)], "g int, season int, day int, id int")
    got = S.next_unwritten(c, spark.createDataFrame([(20,), (None,)], "id int"), ["id"], ["g"], "id").collect()
    assert [(r["g"], r["id"]) for r in got] == [(1, 11)]
    assert S.next_unwritten(c, c.select("id").limit(0), ["id"], ["g"], "id").count() == 3


def test_lookup_falls_back(spark):
    keys = "career_id int, champion_id int"
    cat = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], keys)
    overall = spark.createDataFrame([(1, 1, 4, 9, 0.5), (1, 2, None, 0, None)], f"{keys}, rank int, games int, adjusted double")
    got = {r["champion_id"]: (r["found"], r["rank"], r["games"]) for r in V.lookup(cat, overall, spark.createDataFrame([(1, 1, 2)], f"{keys}, rank int"), ["career_id", "champion_id"]).collect()}
    assert got == {1: ("role", 2, 9), 2: ("overall", None, 0), 3: ("bare", None, 0)}


def test_timeline_stages(spark, sf):
    c = I.contests(spark, sf)
    none = c.limit(0).select("career_id", "season", "day", "blue_team_id", "red_team_id")
    rows_ = S.timeline(c, none.withColumn("article_id", F.lit(1)), none.withColumn("batch_id", F.lit(1)), 3).collect()
    assert rows_ and all(r["stage"] == 0 and r["batches"] == 0 and r["article_id"] is None for r in rows_)
    first = c.where("match_type = 'OFFICIAL'").limit(1).select("career_id", "season", "day", F.col("red_team_id").alias("blue_team_id"), F.col("blue_team_id").alias("red_team_id"))
    staged = S.timeline(c, first.withColumn("article_id", F.lit(7)), first.unionByName(first).withColumn("batch_id", F.lit(8)), 3).where("stage = 2").collect()
    assert [(r["article_id"], r["batch_id"], r["batches"]) for r in staged] == [(7, 8, 2)]
