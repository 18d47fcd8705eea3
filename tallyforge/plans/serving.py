"""Queries over the aggregate tables, and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import estimates as O
from ..operators import season as SE
from ..operators import serving as S
from ..sources import views as V
from . import inputs as I
from .estimates import OBS, TIER_SQL
from .inputs import sql
from .registry import query

TIER = V.SQL + ",\n" + TIER_SQL
EF_SQL = """ef as (select zz.career_id, metric, pp.side, subject, other, count(*) as observations, round(avg(z), 3) + 0.0 as effect from zz join pp on pp.match_id = zz.match_id and pp.subject = zz.champion_id group by all having count(*) >= 10),
pv as (select career_id, side, subject, other, max(effect) filter (metric = 'dealing') as dealing, max(effect) filter (metric = 'tanking') as tanking, max(effect) filter (metric = 'healing') as healing, max(effect) filter (metric = 'kills') as kills, max(effect) filter (metric = 'deaths') as deaths, max(effect) filter (metric = 'assists') as assists, max(observations) filter (metric = 'dealing') as observations from ef group by all)"""
CL_SQL = f"pb as (select *, {S.BUCKET} as bucket from pv),\ncl as (select *, {S.RANK_VALUE} as rank_value, {S.LEAD_METRIC} as lead_metric, (bucket in ('EASY_FOE', 'DUO'))::int as favourable, {S.SIGNATURE} as signature from pb)"
EF = OBS + ",\n" + EF_SQL
CL = EF + ",\n" + CL_SQL


def mean_effects(spark: SparkSession, d: str) -> DataFrame:
    """Plain mean of z for each pair: an effect table that SQL can also compute, for the serving queries."""
    z = O.standardised(O.unpivoted(O.observations(I.weighted(spark, d))))
    two = F.expr("concat(transform(mates, m -> struct('ALLY' as side, m.id as other)), transform(foes, m -> struct('FOE' as side, m.id as other)))")
    g = z.withColumn("p", F.explode(two)).groupBy("career_id", "metric", F.col("p.side").alias("side"), F.col("champion_id").alias("subject"), F.col("p.other").alias("other")).agg(F.count("*").alias("observations"), (F.round(F.avg("z"), 3) + 0.0).alias("effect"))
    return g.where("observations >= 10")


def champions(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue: every champion that any record names, valid or not."""
    return I.raw(spark, d).select(F.explode("stats.champion_id").alias("champion_id")).distinct()


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    """The champions of each career; all have the same."""
    careers = I.patches(spark).agg(F.collect_set("career_id").alias("careers"))
    return champions(spark, d).join(F.broadcast(careers), how="cross").select(F.explode("careers").alias("career_id"), "champion_id")  # one row


def fitted_effects(spark: SparkSession, d: str) -> DataFrame:
    """The effects of the ridge fit, which serving uses in earnest."""
    return O.pair_effects(I.weighted(spark, d))


def classified(spark: SparkSession, d: str, effects=mean_effects) -> DataFrame:
    return S.classified(S.pair_pivot(effects(spark, d)))


@query(sql("select career_id, include_scrim::varchar as include_scrim, c.champion_id, coalesce(games, 0) as games, adjusted from (select distinct champion_id from pr) c cross join (select distinct career_id, include_scrim from tr) k left join tr using (career_id, include_scrim, champion_id)", TIER))
def f1_tier_list(spark: SparkSession, d: str) -> DataFrame:
    """All playable champions with their estimate, best first, those without one last."""
    t = I.tiers(spark, d)
    ids = champions(spark, d).agg(F.array_sort(F.collect_set("champion_id")).alias("ids"))
    all_ = t.select("career_id", "include_scrim").distinct().join(F.broadcast(ids), how="cross").select("career_id", "include_scrim", F.explode("ids").alias("champion_id"))  # one row
    joined = all_.join(t, ["career_id", "include_scrim", "champion_id"], "left").select("career_id", "include_scrim", "champion_id", F.coalesce("games", F.lit(0)).alias("games"), "adjusted")
    return I.flag_text(joined).orderBy("career_id", "include_scrim", F.col("adjusted").desc_nulls_last(), "champion_id")


@query(sql("select career_id, include_scrim::varchar as include_scrim, champion_id, games, wins, bans, ess, adjusted, win_rate, pick_rate, ban_rate, case when games > 0 then rank() over (partition by career_id, include_scrim order by adjusted desc nulls last) end as rank from tr", TIER))
def f2_tier_rank(spark: SparkSession, d: str) -> DataFrame:
    t = S_ranked(spark, d, ["career_id", "include_scrim"])
    return t.select("career_id", "include_scrim", "champion_id", "games", "wins", "bans", "ess", "adjusted", "win_rate", "pick_rate", "ban_rate", "rank")


def S_ranked(spark: SparkSession, d: str, by: list[str]) -> DataFrame:
    t = I.tiers(spark, d).withColumn("role", F.expr("(champion_id - 1) div 8"))
    return I.flag_text(O.ranked(t, by))


@query(sql("select career_id, include_scrim::varchar as include_scrim, champion_id, case when games > 0 then rank() over (partition by career_id, include_scrim, (champion_id - 1) // 8 order by adjusted desc nulls last) end as rank from tr", TIER))
def f3_rank_in_role(spark: SparkSession, d: str) -> DataFrame:
    return S_ranked(spark, d, ["career_id", "include_scrim", "role"]).select("career_id", "include_scrim", "champion_id", "rank")


#: Champions whose number ends in zero have no role yet; one more was never played.
_LOOKUP = TIER + """,
cg as (select k.career_id, c.champion_id from (select distinct career_id from pt) k cross join (select distinct champion_id from pr union all select max(champion_id) + 1 from pr) c),
ov as (select career_id, champion_id, games, adjusted, case when games > 0 then rank() over (partition by career_id order by adjusted desc nulls last) end as rank from tr where not include_scrim),
ro as (select career_id, champion_id, case when games > 0 then rank() over (partition by career_id, (champion_id - 1) // 8 order by adjusted desc nulls last) end as rank from tr where not include_scrim and champion_id % 10 <> 0)"""


@query(sql("select cg.career_id, cg.champion_id, case when ov.champion_id is null then 'bare' when ro.champion_id is null then 'overall' else 'role' end as found, case when ro.champion_id is null then ov.rank else ro.rank end as rank, coalesce(ov.games, 0) as games, adjusted from cg left join ov using (career_id, champion_id) left join ro using (career_id, champion_id)", _LOOKUP))
def f3_champion_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every champion by its rank in its role, in all, or bare."""
    t = I.tiers(spark, d).where("not include_scrim").withColumn("role", F.expr("(champion_id - 1) div 8"))
    ids = catalogue(spark, d)
    never = ids.groupBy("career_id").agg((F.max("champion_id") + 1).alias("champion_id"))
    in_role = O.ranked(t.where("champion_id % 10 <> 0"), ["career_id", "role"])
    return S.lookup(ids.unionByName(never), O.ranked(t, ["career_id"]), in_role, ["career_id", "champion_id"])


@query(sql("select career_id, side, subject, other, dealing, tanking, healing, kills, deaths, assists, observations from pv", EF))
def f4_pair_pivot(spark: SparkSession, d: str) -> DataFrame:
    return S.pair_pivot(mean_effects(spark, d)).select("career_id", "side", "subject", "other", "dealing", "tanking", "healing", "kills", "deaths", "assists", "observations")


@query(sql("select career_id, side, subject, other, bucket from cl", CL))
def f5_buckets(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).select("career_id", "side", "subject", "other", "bucket")


@query(sql("select career_id, side, subject, other, round(rank_value, 6) + 0.0 as rank_value, lead_metric, favourable from cl", CL))
def f6_rank_value(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).select("career_id", "side", "subject", "other", (F.round("rank_value", 6) + 0.0).alias("rank_value"), "lead_metric", "favourable")


@query(sql("select career_id, side, subject, other, signature from cl", CL))
def f7_signature(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).select("career_id", "side", "subject", "other", "signature")


@query()
def f7_fitted_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Buckets, rank values, lead metrics and signatures over the fitted effects. No SQL for the fit; the rules are those of f5 to f7, the effects those of e10."""
    c = classified(spark, d, fitted_effects)
    return c.select("career_id", "side", "subject", "other", "bucket", F.round("rank_value", 6).alias("rank_value"), "lead_metric", "favourable", "signature")


_LANES = " union all ".join(f"select career_id, subject, other, '{k}' as lane, rank_value, {S.AFFINITY[k]} as affinity, bucket = '{k}' as hit from cl where side = '{S.SIDE_OF[k]}' and (bucket = '{k}' or (bucket = 'NEUTRAL' and {S.AFFINITY[k]} > 0))" for k in S.AFFINITY)


@query(
    sql(
        f"""select career_id, subject, lane, other, case when hit then 'sure' else 'leans' end as kind, rn from (select *, row_number() over (partition by career_id, subject, lane, hit order by case when hit then rank_value else affinity end desc, other) as rn,
        least(10, count(*) filter (hit) over (partition by career_id, subject, lane)) as hits from ({_LANES})) where case when hit then rn <= 10 else rn <= greatest(0, 5 - hits) end""",
        CL,
    )
)
def f8_bucket_top(spark: SparkSession, d: str) -> DataFrame:
    return S.buckets(classified(spark, d))


@query()
def f8_fitted_top(spark: SparkSession, d: str) -> DataFrame:
    """The lists of f8 over the fitted effects."""
    return S.buckets(classified(spark, d, fitted_effects))


@query(sql("select career_id, subject, other, round(rank_value, 6) as rank_value from cl where bucket = 'ANTI_SYNERGY'", CL))
def f9_warnings(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).where("bucket = 'ANTI_SYNERGY'").select("career_id", "subject", "other", F.round("rank_value", 6).alias("rank_value")).orderBy(F.col("rank_value").desc())


@query()
def f9_fitted_warnings(spark: SparkSession, d: str) -> DataFrame:
    """The warnings of f9 over the fitted effects."""
    return classified(spark, d, fitted_effects).where("bucket = 'ANTI_SYNERGY'").select("career_id", "subject", "other", F.round("rank_value", 6).alias("rank_value")).orderBy(F.col("rank_value").desc())


@query(sql("select p.career_id, (t.career_id is not null)::int as filled, (row_number() over (order by (t.career_id is not null) desc, p.career_id) = 1)::int as chosen from (select distinct career_id from pt) p left join (select distinct career_id from tr) t using (career_id)", TIER))
def f10_careers(spark: SparkSession, d: str) -> DataFrame:
    """Careers, whether they have aggregates, and the default: the first filled one, else the first. A row a career."""
    filled = I.tiers(spark, d).select("career_id").distinct().withColumn("filled", F.lit(1))
    j = I.patches(spark).select("career_id").distinct().join(filled, "career_id", "left").withColumn("filled", F.coalesce("filled", F.lit(0)))
    return j.withColumn("chosen", (F.row_number().over(Window.orderBy(F.col("filled").desc(), "career_id")) == 1).cast("int"))


PLAYER_TEAM = 3
_NUMBER = "season * 100000 + day * 1000 + blue_team_id * 31 + red_team_id * 31"


@query(sql(f"""select m.*, case when 3 = team_a then (wins_a * 2 > sets)::int when 3 = team_b then (wins_a * 2 < sets)::int end as own_won, article_id, batch_id, coalesce(batches, 0) as batches, case when batches > 0 then 2 when article_id is not null then 1 else 0 end as stage
  from (select career_id, season, day, team_a, team_b, count(*) as sets, count(*) filter (case winner_side when 'BLUE' then blue_team_id else red_team_id end = team_a) as wins_a, max(match_id) as last_set from oc group by all) m
  left join (select career_id, season, day, team_a, team_b, max({_NUMBER}) as article_id from oc where ({_NUMBER}) % 3 = 0 group by all) a using (career_id, season, day, team_a, team_b)
  left join (select career_id, season, day, team_a, team_b, max(match_id) as batch_id, count(*) as batches from oc where match_id % 4 = 0 group by all) b using (career_id, season, day, team_a, team_b)""", V.SQL + ",\noc as (select *, least(blue_team_id, red_team_id) as team_a, greatest(blue_team_id, red_team_id) as team_b from ct where match_type = 'OFFICIAL')"))  # fmt: skip
def f11_cycle_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Matches with their sets, articles and galleries. A third of the matches have an article, every fourth contest a batch."""
    c = I.contests(spark, d)
    official = c.where("match_type = 'OFFICIAL'").select("career_id", "season", "day", "blue_team_id", "red_team_id", "match_id", F.expr(_NUMBER).alias("article_id"))
    return SE.timeline(c, official.where("article_id % 3 = 0"), official.where("match_id % 4 = 0").withColumn("batch_id", F.col("match_id")), PLAYER_TEAM)


TG_SQL = """tg as (select career_id, champion_id as target, adjusted, row_number() over (partition by career_id order by adjusted desc, champion_id) as place from tr where not include_scrim and games >= 20 qualify place <= 6),
cd as (select ef.career_id, ef.subject as target, ef.other as champion_id, effect, observations, coalesce(tr.games, 0) as games from ef join tg on tg.career_id = ef.career_id and tg.target = ef.subject left join tr on tr.career_id = ef.career_id and tr.champion_id = ef.other and not tr.include_scrim where ef.side = 'FOE' and metric = 'deaths' and effect > 0.1)"""
CD = EF + ",\n" + TIER_SQL + ",\n" + TG_SQL


def candidates(spark: SparkSession, d: str, effects=mean_effects) -> DataFrame:
    t = I.tiers(spark, d)
    return S.counter_candidates(effects(spark, d), S.meta_targets(t), t)


@query(sql("select * from tg", CD))
def g1_meta_targets(spark: SparkSession, d: str) -> DataFrame:
    return S.meta_targets(I.tiers(spark, d))


@query(sql("select * from cd", CD))
def g2_counter_candidates(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).select("career_id", "target", "champion_id", "effect", "observations", "games")


@query()
def g2_fitted_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The candidates of g2 over the fitted effects."""
    return candidates(spark, d, fitted_effects).select("career_id", "target", "champion_id", "effect", "observations", "games")


@query(sql("select career_id, champion_id, target, observations from (select *, row_number() over (partition by career_id, champion_id order by observations, effect desc, target) as rn from cd) where rn = 1", CD))
def g3_best_counters(spark: SparkSession, d: str) -> DataFrame:
    return S.best_counters(candidates(spark, d)).select("career_id", "champion_id", "target", "observations")


@query(sql("select career_id, champion_id, target, (observations < 20)::int as to_test from cd", CD))
def g4_worth_testing(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).select("career_id", "champion_id", "target", (F.col("observations") < S.TESTED).cast("int").alias("to_test"))


@query()
def g3_fitted_counters(spark: SparkSession, d: str) -> DataFrame:
    """The counters of g3 and g4 over the fitted effects."""
    return S.best_counters(candidates(spark, d, fitted_effects)).select("career_id", "champion_id", "target", "observations", "to_test")


SIDES_SQL = "select a.career_id, a.champion_id as a, b.champion_id as b, count(*) as times from pa a join pa b on a.match_id = b.match_id and a.side = b.side and a.champion_id < b.champion_id where a.match_type = '{}' group by all"
KNOWN_SQL = "select distinct career_id, least(subject, other) as a, greatest(subject, other) as b from ef where side = 'ALLY'"


def known_pairs(spark: SparkSession, d: str, effects=mean_effects) -> DataFrame:
    return effects(spark, d).where("side = 'ALLY'").select("career_id", F.least("subject", "other").alias("a"), F.greatest("subject", "other").alias("b")).distinct()


@query(sql(f"select coalesce(k.career_id, t.career_id) as career_id, coalesce(k.a, t.a) as a, coalesce(k.b, t.b) as b, (k.a is not null)::int as known, coalesce(times, 0) as tried from ({KNOWN_SQL}) k full join ({SIDES_SQL.format('SCRIM')}) t on k.career_id = t.career_id and k.a = t.a and k.b = t.b", EF))
def g5_pair_coverage(spark: SparkSession, d: str) -> DataFrame:
    k, t = known_pairs(spark, d).withColumn("known", F.lit(1)), S.tried_pairs(I.facts(spark, d), "SCRIM")
    return k.join(t, ["career_id", "a", "b"], "full_outer").select("career_id", "a", "b", F.coalesce("known", F.lit(0)).alias("known"), F.coalesce("times", F.lit(0)).alias("tried"))


@query(sql(f"select c.career_id, x.i as a, y.i as b from (select distinct career_id from pt) c, (select distinct champion_id as i from pr) x, (select distinct champion_id as i from pr) y where x.i < y.i and (c.career_id, x.i, y.i) not in (select career_id, a, b from ({KNOWN_SQL})) and (c.career_id, x.i, y.i) not in (select career_id, a, b from ({SIDES_SQL.format('SCRIM')}))", EF))
def g6_unexplored_pairs(spark: SparkSession, d: str) -> DataFrame:
    return S.unexplored(catalogue(spark, d), known_pairs(spark, d), S.tried_pairs(I.facts(spark, d), "SCRIM"))


@query()
def g6_fitted_unexplored(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of g6 beside those that the fitted effects know."""
    return S.unexplored(catalogue(spark, d), known_pairs(spark, d, fitted_effects), S.tried_pairs(I.facts(spark, d), "SCRIM"))


def built_decks(spark: SparkSession, d: str) -> DataFrame:
    t = I.tiers(spark, d)
    pool = t.where("not include_scrim").select("career_id", "champion_id", F.expr("(champion_id - 1) div 8").alias("role"), "games")
    free = S.unexplored(catalogue(spark, d), known_pairs(spark, d, fitted_effects), S.tried_pairs(I.facts(spark, d), "SCRIM"))
    return S.decks(S.best_counters(candidates(spark, d, fitted_effects)), pool, free)


@query()
def g7_decks(spark: SparkSession, d: str) -> DataFrame:
    """Greedy and sequential within a career: not expressible in SQL, tested against the rules."""
    return built_decks(spark, d)


@query()
def g8_deck_scores(spark: SparkSession, d: str) -> DataFrame:
    return S.deck_scores(built_decks(spark, d), known_pairs(spark, d, fitted_effects), S.tried_pairs(I.facts(spark, d), "SCRIM"))


@query(sql("select a.career_id, a.champion_id as a, b.champion_id as b, count(*) as games, sum(a.is_winner::int)::bigint as wins from pa a join pa b on a.match_id = b.match_id and a.side = b.side and a.champion_id < b.champion_id group by all"))
def g9_combos_of_two(spark: SparkSession, d: str) -> DataFrame:
    return S.combos(I.facts(spark, d), 2)


@query(sql("select a.career_id, a.champion_id as a, b.champion_id as b, c.champion_id as c3, count(*) as games, sum(a.is_winner::int)::bigint as wins from pa a join pa b on a.match_id = b.match_id and a.side = b.side and a.champion_id < b.champion_id join pa c on c.match_id = b.match_id and c.side = b.side and b.champion_id < c.champion_id group by all"))
def g9_combos_of_three(spark: SparkSession, d: str) -> DataFrame:
    return S.combos(I.facts(spark, d), 3)


@query(sql("select career_id, comp, count(*) as games, sum(won)::bigint as wins, round((sum(won) + 12.0) / (count(*) + 24), 6) as adjusted from (select career_id, match_id, side, max(is_winner::int) as won, concat_ws('-', " + ", ".join(f"count(*) filter (role = {r})" for r in range(5)) + ") as comp from pa group by all) group by all"))
def g10_compositions(spark: SparkSession, d: str) -> DataFrame:
    return S.compositions(I.facts(spark, d))
