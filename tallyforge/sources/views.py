"""Contest, version and schedule views over the driver's tables, as DataFrames and as SQL for the oracle.

Eight consecutive events form a contest, grouped once into a nested record, as the readers of real contest
records return; everything about a contest is then computed in its row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STAT = "struct(pos, if(pos < 4, 'BLUE', 'RED') as side, pos % 4 + 1 as pick_order, 1 + user_id % 40 as champion_id, (user_id % 40) div 8 as role, k div 10 as kills, (k div 7) % 8 as deaths, k % 12 as assists, cents as dealing, (cents * 7) % 5003 as tanking, if(event_id % 97 = 0, null, (k * 13) % 500) as healing)"
METRICS = ("dealing", "tanking", "healing", "kills", "deaths", "assists")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested contest records before any check: match_id, stats (array by position), t."""
    rows = read(spark, sf_dir, "events").selectExpr(
        "event_id", "event_id div 8 as match_id", "event_id % 8 as pos", "user_id", "cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k", "cast(round(value * 100) as bigint) as cents", "ts"
    )
    grouped = rows.selectExpr("match_id", "ts", f"{STAT} as s").groupBy("match_id").agg(F.array_sort(F.collect_list("s")).alias("stats"), F.min("ts").alias("t"))
    side = "aggregate(filter(stats, s -> s.side = '{}'), 0L, (a, s) -> a + s.kills)"
    return grouped.selectExpr(
        "match_id",
        "if(match_id % 5 = 0, 2, 1) as career_id",
        "if(match_id % 3 = 0, 'SCRIM', 'OFFICIAL') as match_type",
        "year(t) as season",
        "day(t) as day",
        f"{side.format('BLUE')} as blue_score",
        f"{side.format('RED')} as red_score",
        "if(match_id % 3 = 0, null, 1 + match_id % 10) as blue_team_id",
        "if(match_id % 3 = 0, null, 1 + (match_id % 10 + 1 + (match_id div 10) % 9) % 10) as red_team_id",
        "stats",
    )


def patches(spark: SparkSession) -> DataFrame:
    """The version boundaries of each career: seq 1 to 4."""
    return spark.sql("select c as career_id, s as seq, 2024 as season, if(c = 1, 6 * s, 6 * s + 1) as day from (select explode(array(1, 2)) as c) cross join (select explode(sequence(1, 4)) as s)")


def patch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(career_id, seq, champion_id, attack): what each boundary changed. All parts of a champion and boundary are summed; an odd sum means no change."""
    total = F.sum(F.col("p_size").cast("bigint"))
    one = read(spark, sf_dir, "part").groupBy((1 + F.col("p_partkey") % 40).alias("champion_id"), (1 + F.col("p_size") % 4).cast("int").alias("seq")).agg(total.alias("size")).where("size % 2 = 0").withColumn("attack", F.col("size") % 51 - 25)
    return one.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("career_id"), "seq", "champion_id", "attack").withColumn("attack", F.expr("if(career_id = 2, -attack, attack)"))


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of two to five contests, over orders."""
    o = read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as schedule_id", "cast(substring(o_orderpriority, 1, 1) as int) as p", "year(o_orderdate) as season", "dayofyear(o_orderdate) as day", "o_custkey", "cast(round(o_totalprice * 100) as bigint) as c", "o_orderstatus"
    )
    # The nine smallest ids of each season: Spark keeps nine per season and task before the shuffle.
    by_id = Window.partitionBy("season").orderBy("schedule_id")
    smallest = o.select("season", "schedule_id").withColumn("n", F.row_number().over(by_id)).where("n <= 9").select("schedule_id", F.lit(True).alias("bracket"))
    return o.join(smallest, "schedule_id", "left").selectExpr(
        "schedule_id",
        "if(bracket, 6, p) as competition_id",
        "season",
        "day",
        "1 + o_custkey % 10 as blue_team_id",
        "1 + (o_custkey % 10 + 1 + schedule_id % 9) % 10 as red_team_id",
        "c % 4 as blue_score",
        "(c div 4) % 4 as red_score",
        "(c div 16) % 30 as blue_kill",
        "(c div 480) % 30 as red_kill",
        "3 as need_win",
        "if(o_orderstatus = 'O', 0.0D, 1.0D) as progress",
    )


SQL_RAW = """
ev as (select event_id, event_id // 8 as match_id, event_id % 8 as pos, user_id, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k, cast(round(value * 100) as bigint) as cents, ts from events),
pr as (select match_id, pos, case when pos < 4 then 'BLUE' else 'RED' end as side, pos % 4 + 1 as pick_order, 1 + user_id % 40 as champion_id, (user_id % 40) // 8 as role, k // 10 as kills, (k // 7) % 8 as deaths, k % 12 as assists, cents as dealing, (cents * 7) % 5003 as tanking, case when event_id % 97 = 0 then null else (k * 13) % 500 end as healing, ts from ev),
mv as (select match_id, count(*) as n, count(distinct champion_id) as nd, min(ts) as t, coalesce(sum(kills) filter (side = 'BLUE'), 0)::bigint as blue_score, coalesce(sum(kills) filter (side = 'RED'), 0)::bigint as red_score from pr group by match_id),
mt as (select match_id, n, nd, case when match_id % 5 = 0 then 2 else 1 end as career_id, case when match_id % 3 = 0 then 'SCRIM' else 'OFFICIAL' end as match_type, year(t) as season, day(t) as day, blue_score, red_score,
  case when match_id % 3 <> 0 then 1 + match_id % 10 end as blue_team_id, case when match_id % 3 <> 0 then 1 + (match_id % 10 + 1 + (match_id // 10) % 9) % 10 end as red_team_id,
  case when blue_score > red_score then 'BLUE' when red_score > blue_score then 'RED' when match_id % 3 = 0 then null when match_id % 2 = 0 then 'BLUE' else 'RED' end as winner_side from mv),
pt as (select c.career_id, s.seq, 2024 as season, case when c.career_id = 1 then 6 * s.seq else 6 * s.seq + 1 end as day from (values (1), (2)) c(career_id), (values (1), (2), (3), (4)) s(seq)),
pe as (select c.career_id, seq, champion_id, case when c.career_id = 2 then -attack else attack end as attack from (select 1 + p_partkey % 40 as champion_id, 1 + p_size % 4 as seq, sum(p_size)::bigint % 51 - 25 as attack from part group by all having sum(p_size)::bigint % 2 = 0), (values (1), (2)) c(career_id))"""

SQL = (
    SQL_RAW
    + """,
ct as (select m.*, p.patch_seq from mt m join (select mt.match_id, max(pt.seq) as patch_seq from mt left join pt on pt.career_id = mt.career_id and (pt.season < mt.season or (pt.season = mt.season and pt.day <= mt.day)) group by mt.match_id) p using (match_id) where n = 8 and nd = 8 and winner_side is not null),
p0 as (select pr.* exclude (ts), ct.career_id, match_type, season, day, patch_seq, winner_side, winner_side = side as is_winner, case side when 'BLUE' then blue_team_id else red_team_id end as team_id from pr join ct using (match_id)),
cc as (select p0.match_id, p0.pos, count(pe.seq) as change_count from p0 left join pe on pe.career_id = p0.career_id and pe.champion_id = p0.champion_id and pe.seq <= p0.patch_seq group by all),
pa as (select p0.*, cc.change_count from p0 join cc using (match_id, pos)),
rc as (select career_id, champion_id, count(*) as ref_count from pe group by all),
wt as (select pa.*, abs(4 - coalesce(patch_seq, 0)) as elapsed, abs(coalesce(ref_count, 0) - change_count) as self_d, pow(0.5, abs(coalesce(ref_count, 0) - change_count) / 2.0) * pow(0.5, abs(4 - coalesce(patch_seq, 0)) / 2.0) as w from pa left join rc using (career_id, champion_id)),
fl as (select wt.*, f.include_scrim from wt join (values (true), (false)) f(include_scrim) on f.include_scrim or match_type = 'OFFICIAL'),
bn as (select ct.match_id, career_id, case when s.pos < 4 then 'BLUE' else 'RED' end as side, s.pos % 4 + 1 as ban_order, 1 + (ct.match_id * 11 + s.pos * 5) % 40 as champion_id from ct, (values (0), (1), (2), (4), (5), (6)) s(pos) where match_type = 'OFFICIAL')"""
)
SQL_SCHEDULE = """
oo as (select o_orderkey as schedule_id, cast(substring(o_orderpriority, 1, 1) as int) as p, year(o_orderdate) as season, dayofyear(o_orderdate) as day, o_custkey, cast(round(o_totalprice * 100) as bigint) as c, o_orderstatus, row_number() over (partition by year(o_orderdate) order by o_orderkey) as rn from orders),
sc as (select schedule_id, case when rn <= 9 then 6 else p end as competition_id, season, day, 1 + o_custkey % 10 as blue_team_id, 1 + (o_custkey % 10 + 1 + schedule_id % 9) % 10 as red_team_id, c % 4 as blue_score, (c // 4) % 4 as red_score, (c // 16) % 30 as blue_kill, (c // 480) % 30 as red_kill, case when o_orderstatus = 'O' then 0.0 else 1.0 end as progress from oo)"""
