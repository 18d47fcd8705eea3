"""Queries of the season book and match facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import season as S
from ..sources import views as V
from . import inputs as I
from .inputs import sql
from .registry import query

BASE = V.SQL_SCHEDULE + """,
sw as (select *, progress >= 1 as played, case when progress >= 1 and blue_score > red_score then blue_team_id when progress >= 1 and red_score > blue_score then red_team_id end as winner_id from sc),
tm as (select schedule_id, competition_id, season, day, played, winner_id, case s.me when 'blue' then blue_team_id else red_team_id end as team_id, case s.me when 'blue' then 1 else -1 end * (blue_score - red_score) as sd, case s.me when 'blue' then 1 else -1 end * (blue_kill - red_kill) as kd from sw, (values ('blue'), ('red')) s(me)),
dl as (select competition_id, season, team_id, day, count(*) as n, count(*) filter (winner_id = team_id) as w, sum(sd) as s, sum(kd) as k from tm where played group by all),
sp as (select d.competition_id, d.season, d.day, t.team_id from (select distinct competition_id, season, day from sc) d join (select distinct competition_id, season, team_id from dl) t on t.competition_id = d.competition_id and t.season = d.season),
st0 as (select * from (select sp.*, (sum(coalesce(n, 0)) over w)::bigint as played, (sum(coalesce(w, 0)) over w)::bigint as wins, (sum(coalesce(s, 0)) over w)::bigint as set_diff, (sum(coalesce(k, 0)) over w)::bigint as kill_diff
  from sp left join dl on dl.competition_id = sp.competition_id and dl.season = sp.season and dl.team_id = sp.team_id and dl.day = sp.day window w as (partition by sp.competition_id, sp.season, sp.team_id order by sp.day rows between unbounded preceding and 1 preceding)) where played > 0),
st as materialized (select *, rank() over (partition by competition_id, season, day order by wins desc, set_diff desc, kill_diff desc) as rank from st0),
br as (select competition_id, season, count(distinct schedule_id) as matches, count(distinct team_id) as teams, count(distinct schedule_id) = count(distinct team_id) - 1 as bracket from tm group by all),
bf as materialized (select sw.*, br.bracket, b.played as bp, b.wins as bw, r.played as rp, r.wins as rw, case when not bracket then b.rank end as blue_rank, case when not bracket then r.rank end as red_rank from sw join br using (competition_id, season)
  left join st b on b.competition_id = sw.competition_id and b.season = sw.season and b.day = sw.day and b.team_id = sw.blue_team_id left join st r on r.competition_id = sw.competition_id and r.season = sw.season and r.day = sw.day and r.team_id = sw.red_team_id),
rt as materialized (select schedule_id, case when bp >= 5 then bw / bp end as blue_rate, case when rp >= 5 then rw / rp end as red_rate from bf),
ch as (select *, case when blue_rate is not null and red_rate is not null then case when blue_rate * (1 - red_rate) + red_rate * (1 - blue_rate) <= 0 then 0.5 else blue_rate * (1 - red_rate) / (blue_rate * (1 - red_rate) + red_rate * (1 - blue_rate)) end end as chance from rt),
mb as (select m.schedule_id, coalesce(f.first < m.season, false)::int as met from sw m left join (select least(blue_team_id, red_team_id) as a, greatest(blue_team_id, red_team_id) as b, min(season) as first from sw where played group by all) f on f.a = least(blue_team_id, red_team_id) and f.b = greatest(blue_team_id, red_team_id)),
pl as (select *, case when winner_id is null then -1 when winner_id = team_id then 1 else 0 end as r from tm where played),
il as (select *, sum(nw) over (partition by competition_id, season, team_id order by day, schedule_id) as isle from (select *, case when lag(r) over (partition by competition_id, season, team_id order by day, schedule_id) = r then 0 else 1 end as nw from pl)),
rn as (select *, row_number() over (partition by competition_id, season, team_id, isle order by day, schedule_id) as run from il),
en as (select competition_id, season, team_id, day, arg_max(case r when 1 then run when 0 then -run else 0 end, schedule_id) as s from rn group by all),
sk as materialized (select tm.schedule_id, tm.team_id, coalesce(arg_max(en.s, en.day), 0)::bigint as streak from tm left join en on en.competition_id = tm.competition_id and en.season = tm.season and en.team_id = tm.team_id and en.day < tm.day group by tm.schedule_id, tm.team_id),
pv as (select bf.schedule_id, (blue_team_id = 3 or red_team_id = 3)::int as plays, case when blue_team_id = 3 or red_team_id = 3 then case when winner_id is null then 0 when winner_id = 3 then 1 else -1 end end as outcome,
  case when not (blue_team_id = 3 or red_team_id = 3) and not bracket and winner_id is not null and o.rank is not null then (o.wins - case when winner_id = blue_team_id then bw else rw end - 1)::bigint end as gap from bf left join st o on o.competition_id = bf.competition_id and o.season = bf.season and o.day = bf.day and o.team_id = 3 where bf.played)"""
TEAM = 3


def matches(spark: SparkSession, d: str) -> DataFrame:
    return V.schedule(spark, d)


def q(body: str) -> str:
    return sql(body, BASE)


@query(q("select schedule_id, least(blue_team_id, red_team_id) as team_a, greatest(blue_team_id, red_team_id) as team_b, row_number() over (partition by season order by day, competition_id, schedule_id) as place from sc"))
def h1_schedule_order(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("season").orderBy(F.col("day").asc_nulls_last(), F.col("competition_id").asc_nulls_last(), "schedule_id")
    return S.winner(matches(spark, d)).select("schedule_id", "team_a", "team_b", F.row_number().over(w).cast("bigint").alias("place"))


@query(q("select competition_id, season, day, least(blue_team_id, red_team_id) as team_a, greatest(blue_team_id, red_team_id) as team_b, count(*) as sets from sc group by all"))
def h2_sets_to_matches(spark: SparkSession, d: str) -> DataFrame:
    return S.winner(matches(spark, d)).where("team_a is not null and team_b is not null").groupBy("competition_id", "season", "day", "team_a", "team_b").agg(F.count("*").alias("sets"))


@query(q("select schedule_id, case when blue_team_id > red_team_id then red_score else blue_score end as score_a, case when blue_team_id > red_team_id then blue_score else red_score end as score_b, case when blue_team_id > red_team_id then red_kill else blue_kill end as kill_a from sc"))
def h3_side_normalised(spark: SparkSession, d: str) -> DataFrame:
    swap = F.col("blue_team_id") > F.col("red_team_id")
    return matches(spark, d).select("schedule_id", F.when(swap, F.col("red_score")).otherwise(F.col("blue_score")).alias("score_a"), F.when(swap, F.col("blue_score")).otherwise(F.col("red_score")).alias("score_b"), F.when(swap, F.col("red_kill")).otherwise(F.col("blue_kill")).alias("kill_a"))


_SETS = """
cy as (select *, first_value(blue_team_id) over (partition by career_id, season, day, least(blue_team_id, red_team_id), greatest(blue_team_id, red_team_id) order by match_id) as m_blue from ct where match_type = 'OFFICIAL'),
pk as (select match_id, side, string_agg(champion_id, '-' order by pick_order) as picks from p0 group by all),
bk as (select match_id, side, string_agg(champion_id, '-' order by ban_order) as bans from bn group by all),
sd as (select cy.match_id, m_blue <> blue_team_id as swapped, blue_team_id, red_team_id, blue_score, red_score, winner_side, pb.picks as bp, pr2.picks as rp, bb.bans as bb, rb.bans as rb from cy
  join pk pb on pb.match_id = cy.match_id and pb.side = 'BLUE' join pk pr2 on pr2.match_id = cy.match_id and pr2.side = 'RED' join bk bb on bb.match_id = cy.match_id and bb.side = 'BLUE' join bk rb on rb.match_id = cy.match_id and rb.side = 'RED')"""


@query(sql("""select match_id, swapped::int as swapped, case when swapped then red_team_id else blue_team_id end as blue_team_id, ((winner_side = 'BLUE') <> swapped)::int as blue_won, case when swapped then red_score else blue_score end as blue_score, case when swapped then blue_score else red_score end as red_score,
  case when swapped then rp else bp end as blue_picks, case when swapped then bp else rp end as red_picks, case when swapped then rb else bb end as blue_bans, case when swapped then bb else rb end as red_bans from sd""", V.SQL + "," + _SETS))  # fmt: skip
def h3_sets_by_match(spark: SparkSession, d: str) -> DataFrame:
    """Scores, picks, bans and winners of all sets, from the sides that the first set of the match had."""
    keys = ["career_id", "season", "day", "team_a", "team_b"]
    c = I.contests(spark, d).where("match_type = 'OFFICIAL'").withColumns({"team_a": F.least("blue_team_id", "red_team_id"), "team_b": F.greatest("blue_team_id", "red_team_id")})
    listed = lambda x: F.array_join(F.transform(x, lambda i: i.cast("string")), "-")
    side = lambda name: F.transform(F.array_sort(F.transform(F.filter("stats", lambda x: x["side"] == name), lambda x: F.struct(x["pick_order"], x["champion_id"]))), lambda x: x["champion_id"])
    bans = I.bans(spark, d).groupBy("match_id").agg(*(listed(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == x.upper(), F.struct("ban_order", "champion_id")))), lambda b: b["champion_id"])).alias(f"{x}_bans") for x in ("blue", "red")))
    sets = c.withColumns({f"{x}_picks": listed(side(x.upper())) for x in ("blue", "red")}).join(bans, "match_id")
    matches_ = c.groupBy(*keys).agg(F.min_by(F.struct("blue_team_id", "red_team_id"), "match_id").alias("m")).select(*keys, "m.*")
    out = S.sides_of_match(sets, matches_, keys, ["score", "picks", "bans"])
    return out.select("match_id", F.col("swapped").cast("int").alias("swapped"), "blue_team_id", (F.col("winner_side") == "BLUE").cast("int").alias("blue_won"), "blue_score", "red_score", "blue_picks", "red_picks", "blue_bans", "red_bans")


@query(sql("select match_id, blue_score, (sum(kills) filter (side = 'BLUE') = blue_score and sum(kills) filter (side = 'RED') = red_score)::int as reconciled from p0 join ct using (match_id) group by match_id, blue_score, red_score"))
def h4_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    blue, red = (F.sum(F.when(F.col("side") == s, F.col("kills"))) for s in ("BLUE", "RED"))
    g = I.facts(spark, d).groupBy("match_id", "blue_score", "red_score").agg(blue.alias("b"), red.alias("r"))
    return g.select("match_id", "blue_score", ((F.col("b") == F.col("blue_score")) & (F.col("r") == F.col("red_score"))).cast("int").alias("reconciled"))


@query(sql("select match_id, champion_id, side from pa"))
def h5_player_side(spark: SparkSession, d: str) -> DataFrame:
    """The side whose picks hold a stat's champion, if exactly one does."""
    c = I.contests(spark, d).selectExpr("match_id", "stats", "transform(filter(stats, s -> s.side = 'BLUE'), s -> s.champion_id) as blue", "transform(filter(stats, s -> s.side = 'RED'), s -> s.champion_id) as red")
    one = c.selectExpr("match_id", "blue", "red", "inline(transform(stats, s -> struct(s.champion_id as champion_id)))")
    b, r = F.array_contains("blue", F.col("champion_id")), F.array_contains("red", F.col("champion_id"))
    return one.where(b != r).select("match_id", "champion_id", F.when(b, "BLUE").otherwise("RED").alias("side"))


@query(sql("select career_id, season, day, champion_id, side, count(*) as games, sum(kills)::bigint as kills, sum(deaths)::bigint as deaths, sum(assists)::bigint as assists, sum(dealing)::bigint as dealing, sum(healing)::bigint as healing, string_agg(pick_order, '' order by match_id) as picks from pa group by all"))
def h6_athlete_totals(spark: SparkSession, d: str) -> DataFrame:
    g = I.facts(spark, d).groupBy("career_id", "season", "day", "champion_id", "side")
    picks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("match_id", "pick_order"))), lambda x: x["pick_order"].cast("string")), "")
    return g.agg(F.count("*").alias("games"), *(F.sum(c).alias(c) for c in ("kills", "deaths", "assists", "dealing", "healing")), picks.alias("picks"))


@query(q("select schedule_id, winner_id, case when winner_id = blue_team_id then red_team_id when winner_id = red_team_id then blue_team_id end as loser_id, (winner_id is not null and least(blue_score, red_score) = 0)::int as sweep from sw"))
def h7_winner_loser(spark: SparkSession, d: str) -> DataFrame:
    return S.winner(matches(spark, d)).select("schedule_id", "winner_id", "loser_id", F.col("sweep").cast("int").alias("sweep"))


@query(q("select * from (select season, day, count(*) as matches, arg_max(schedule_id, {'m': abs(blue_kill - red_kill), 'i': -schedule_id}) as widest from sw where played group by season, day having count(*) >= 2) join (select season, day, count(distinct team_id) as teams from tm where played group by all) using (season, day)"))
def h8_round_brief(spark: SparkSession, d: str) -> DataFrame:
    m = S.winner(matches(spark, d)).where("played")
    margin = F.struct(F.abs(F.col("blue_kill") - F.col("red_kill")), -F.col("schedule_id"))
    g = m.groupBy("season", "day").agg(F.count("*").alias("matches"), F.max_by("schedule_id", margin).alias("widest"), F.size(F.array_distinct(F.flatten(F.collect_set(F.array("blue_team_id", "red_team_id"))))).cast("bigint").alias("teams"))
    return g.where("matches >= 2")


@query(q("select a.schedule_id, count(b.schedule_id) as earlier from sc a left join sw b on b.competition_id = a.competition_id and b.season = a.season and b.day < a.day and b.played group by a.schedule_id"))
def h9_earlier_matches(spark: SparkSession, d: str) -> DataFrame:
    """How many matches of the competition were played on earlier days; the same day is not seen."""
    w = Window.partitionBy(*S.GROUP).orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    return S.winner(matches(spark, d)).select("schedule_id", F.count_if(F.col("played")).over(w).alias("earlier"))


@query(q("select competition_id, season, day, team_id, played, wins, set_diff, kill_diff from st"))
def h10_standings(spark: SparkSession, d: str) -> DataFrame:
    return S.standings(S.winner(matches(spark, d))).drop("rank")


@query(q("select schedule_id, blue_rank, red_rank from bf"))
def h11_ranks(spark: SparkSession, d: str) -> DataFrame:
    return S.before(S.winner(matches(spark, d))).select("schedule_id", "blue_rank", "red_rank")


@query(q("""select schedule_id, team_id, rank_before, rank_after from (select m.schedule_id, st.team_id, m.blue_team_id, m.red_team_id, st.rank as rank_before,
  rank() over (partition by m.schedule_id order by st.wins + (st.team_id = m.winner_id)::int desc, st.set_diff + x.g * (m.blue_score - m.red_score) desc, st.kill_diff + x.g * (m.blue_kill - m.red_kill) desc) as rank_after,
  count(*) filter (st.team_id in (m.blue_team_id, m.red_team_id)) over (partition by m.schedule_id) as n
  from sw m join st on st.competition_id = m.competition_id and st.season = m.season and st.day = m.day, lateral (select case when st.team_id = m.blue_team_id then 1 when st.team_id = m.red_team_id then -1 else 0 end as g) x where m.winner_id is not null)
  where n = 2 and team_id in (blue_team_id, red_team_id)"""))  # fmt: skip
def h12_rank_movement(spark: SparkSession, d: str) -> DataFrame:
    return S.after(matches(spark, d))


@query(q("select schedule_id, (count(*) filter (not played) over (partition by competition_id, season) - (not played)::int)::bigint as remaining from sw"))
def h13_remaining(spark: SparkSession, d: str) -> DataFrame:
    return S.remaining(matches(spark, d))


@query(q("select competition_id, season, matches, teams, bracket::int as bracket from br"))
def h14_brackets(spark: SparkSession, d: str) -> DataFrame:
    return S.brackets(S.winner(matches(spark, d))).withColumn("bracket", F.col("bracket").cast("int"))


@query(q("select schedule_id, round(blue_rate, 6) as blue_rate, round(red_rate, 6) as red_rate, round(chance, 6) as chance from ch"))
def h15_win_chances(spark: SparkSession, d: str) -> DataFrame:
    c = S.chances(matches(spark, d))
    return c.select("schedule_id", *(F.round(x, 6).alias(x) for x in ("blue_rate", "red_rate", "chance")))


@query(q("select * from sk"))
def h16_streaks(spark: SparkSession, d: str) -> DataFrame:
    return S.streaks(matches(spark, d))


@query(q("select * from mb"))
def h17_met_before(spark: SparkSession, d: str) -> DataFrame:
    return S.met_before(matches(spark, d))


@query(q("select * from pv"))
def h18_perspective(spark: SparkSession, d: str) -> DataFrame:
    return S.perspective(matches(spark, d), TEAM)


@query(q("""select bf.schedule_id, array_to_string(list_slice(list_filter([case when pv.plays = 1 then 'own:' || pv.outcome else 'other' end, case when blue_rank is not null and red_rank is not null then 'rank:' || blue_rank || ':' || red_rank end,
  case when abs(sb.streak) >= 2 then 'blue:' || sb.streak end, case when abs(sr.streak) >= 2 then 'red:' || sr.streak end, case when met = 1 then 'met' end], lambda x: x is not null), 1, 4), ',') as tags
  from bf join pv using (schedule_id) join mb using (schedule_id) join sk sb on sb.schedule_id = bf.schedule_id and sb.team_id = bf.blue_team_id join sk sr on sr.schedule_id = bf.schedule_id and sr.team_id = bf.red_team_id where bf.played"""))  # fmt: skip
def h19_context_tags(spark: SparkSession, d: str) -> DataFrame:
    return S.tags(matches(spark, d), TEAM)


@query(q("""select schedule_id, round(score, 6) as score, reasons from (select schedule_id, greatest(0, least(1, (0.35 * tp + 0.2 * tc + 0.2 * coalesce(ts, 0) + 0.15 * coalesce(tu, 0) + 0.1 * coalesce(tv, 0)) / (0.35 + 0.2 + case when ts is not null then 0.2 else 0 end + case when tu is not null then 0.15 else 0 end + case when tv is not null then 0.1 else 0 end))) as score,
  array_to_string(list_filter([case when tp = 1 then 'own' end, case when tc > 0.7 then 'close' end, case when ts >= 0.7 then 'standings' end, case when tu >= 0.6 then 'upset' end, case when tv = 1 then 'rivalry' end], lambda x: x is not null), ',') as reasons
  from (select bf.schedule_id, (blue_team_id = 3 or red_team_id = 3)::int as tp, least(1.0, least(blue_score, red_score) / 2) as tc, case when blue_rank is not null and red_rank is not null and l.league > 1 then 1 - least(1.0, abs(blue_rank - red_rank) / (l.league - 1)) end as ts,
  case when chance is not null and winner_id is not null then case when winner_id = blue_team_id then 1 - chance else chance end end as tu, case when met = 1 then 1.0 end as tv
  from bf join ch using (schedule_id) join mb using (schedule_id) left join (select competition_id, season, day, count(*) as league from st group by all) l using (competition_id, season, day) where bf.played))"""))  # fmt: skip
def h20_notability(spark: SparkSession, d: str) -> DataFrame:
    return S.notability(matches(spark, d), TEAM).select("schedule_id", F.round("score", 6).alias("score"), "reasons")


@query(q("select competition_id, max(season * 1000 + day) as latest from sw where played and schedule_id % 3 <> 0 group by all"))
def h21_next_unwritten(spark: SparkSession, d: str) -> DataFrame:
    """The latest played match of each competition that has not been written about."""
    m = S.winner(matches(spark, d)).where("played")
    open_ = m.join(m.where("schedule_id % 3 = 0").select("schedule_id"), "schedule_id", "left_anti")
    return open_.groupBy("competition_id").agg(F.max_by(F.col("season") * 1000 + F.col("day"), F.struct("season", "day")).alias("latest"))


@query(q("""select 'match' as kind, competition_id, season, day, schedule_id from (select *, row_number() over (partition by competition_id order by season desc, day desc, schedule_id) as rn from sw where played and schedule_id % 4 <> 1 and schedule_id % 3 <> 0) where rn = 1
  union all select 'gallery', competition_id, season, day, schedule_id from (select *, row_number() over (partition by competition_id order by season desc, day desc, schedule_id) as rn from sw where played and schedule_id % 4 <> 1 and schedule_id % 6 <> 0) where rn = 1
  union all select 'round', competition_id, (max(season * 1000 + day)) // 1000, (max(season * 1000 + day)) % 1000, null from sw where played and (season * 31 + day) % 4 <> 0 group by competition_id"""))  # fmt: skip
def h21_next_pieces(spark: SparkSession, d: str) -> DataFrame:
    """What is to be written next for each competition: the latest match that has sets and no article, the latest that has sets and no gallery, and the latest day without a round summary."""
    m = S.winner(matches(spark, d)).where("played").select("competition_id", "season", "day", "schedule_id")
    with_sets, by = m.where("schedule_id % 4 <> 1"), ["competition_id"]
    match = S.next_unwritten(with_sets, m.where("schedule_id % 3 = 0"), ["schedule_id"], by, "schedule_id")
    gallery = S.next_unwritten(with_sets, m.where("schedule_id % 6 = 0"), ["schedule_id"], by, "schedule_id")
    days = m.select("competition_id", "season", "day").distinct()
    rounds = S.next_unwritten(days, days.where("(season * 31 + day) % 4 = 0"), ["competition_id", "season", "day"], by).withColumn("schedule_id", F.lit(None).cast("bigint"))
    made = [x.select(F.lit(k).alias("kind"), "competition_id", "season", "day", "schedule_id") for k, x in (("match", match), ("gallery", gallery), ("round", rounds))]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query(q("select season, count(*) as matches from sc group by all"))
def h22_matches_per_season(spark: SparkSession, d: str) -> DataFrame:
    return matches(spark, d).groupBy("season").agg(F.count("*").alias("matches"))


@query(q("select schedule_id, n1.n_name as blue_name, n2.n_name as red_name from sw join nation n1 on n1.n_nationkey = blue_team_id join nation n2 on n2.n_nationkey = red_team_id where played order by season desc, day desc, schedule_id desc limit 20"))
def h23_recent_cards(spark: SparkSession, d: str) -> DataFrame:
    """The latest twenty matches with team names (a feed of fixed length)."""
    latest = S.winner(matches(spark, d)).where("played").orderBy(F.col("season").desc(), F.col("day").desc(), F.col("schedule_id").desc()).limit(20)
    n = V.read(spark, d, "nation")
    for side in ("blue", "red"):
        latest = latest.join(n.select(F.col("n_nationkey").alias(f"{side}_team_id"), F.col("n_name").alias(f"{side}_name")), f"{side}_team_id")
    return latest.select("schedule_id", "blue_name", "red_name")


@query(q("select team_id, n_name as name, count(*) as rows from tm join nation on n_nationkey = team_id group by all"))
def h24_name_reference(spark: SparkSession, d: str) -> DataFrame:
    names = V.read(spark, d, "nation").select(F.col("n_nationkey").alias("team_id"), F.col("n_name").alias("name"))
    return S.team_rows(S.winner(matches(spark, d))).groupBy("team_id").agg(F.count("*").alias("rows")).join(names, "team_id").select("team_id", "name", "rows")
