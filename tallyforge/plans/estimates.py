"""Queries of tallies, tier estimates, counters and pair effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import estimates as E
from ..operators import estimates as O
from ..operators import normalize as N
from ..sources import views as V
from . import inputs as I
from .inputs import sql
from .registry import query

def R6(c):
    """Six decimals; halves of powers of two are nudged up so that the order of a sum does not decide them."""
    return F.round(F.col(c) + 1e-9 if isinstance(c, str) else c + 1e-9, 6)


TALLY = "count(*) as games, sum(is_winner::int)::bigint as wins, round(sum(w) + 1e-9, 6) as weight, round(sum(w * is_winner::int) + 1e-9, 6) as weighted_wins, round(sum(w * w) + 1e-9, 6) as square"
TIER_SQL = """t as (select career_id, include_scrim, champion_id, count(*) as games, sum(is_winner::int)::bigint as wins, sum(w) as sw, sum(w * is_winner::int) as sww, sum(w * w) as sq from fl group by all),
bb as (select career_id, champion_id, count(*) as bans, f.include_scrim from bn, (values (true), (false)) f(include_scrim) group by all),
tot as (select career_id, include_scrim, count(distinct match_id) as matches, count(distinct match_id) filter (match_type = 'OFFICIAL') as officials from fl group by all),
tr as (select career_id, include_scrim, champion_id, coalesce(games, 0) as games, coalesce(wins, 0) as wins, coalesce(bans, 0) as bans, matches, officials,
  round(case when sq > 0 then sw * sw / sq else 0 end, 4) as ess, round((coalesce(sww, 0) + 24 * 0.5) / (coalesce(sw, 0) + 24), 4) as adjusted,
  case when coalesce(games, 0) > 0 then round(wins / games, 4) end as win_rate, round(coalesce(games, 0) / matches, 4) as pick_rate, case when officials > 0 then round(coalesce(bans, 0) / officials, 4) end as ban_rate
  from t full join bb using (career_id, include_scrim, champion_id) join tot using (career_id, include_scrim))"""


def _rounded_tally(t: DataFrame, *keys: str) -> DataFrame:
    return t.select(*keys, "games", "wins", R6("weight").alias("weight"), R6("weighted_wins").alias("weighted_wins"), R6("square").alias("square"))


@query(sql("select p.career_id, 4::bigint as ref_seq, champion_id, ref_count from (select distinct career_id from pt) p left join rc using (career_id)"))
def c1_reference_point(spark: SparkSession, d: str) -> DataFrame:
    return O.reference(I.patches(spark), I.events(spark, d)).select("career_id", F.col("ref_seq").cast("bigint").alias("ref_seq"), "champion_id", "ref_count")


@query(sql("select career_id, champion_id, count(*) as games, round(sum(pow(0.5, abs(coalesce(k, 0) - change_count) / 2.0) * pow(0.5, abs(2 - coalesce(patch_seq, 0)) / 2.0)) + 1e-9, 6) as weight from pa left join (select career_id, champion_id, count(*) as k from pe where seq <= 2 group by all) using (career_id, champion_id) group by all"))
def c2_reference_in_the_past(spark: SparkSession, d: str) -> DataFrame:
    w = O.weighted(I.facts(spark, d), I.patches(spark), I.events(spark, d), seq=2)
    return w.groupBy("career_id", "champion_id").agg(F.count("*").alias("games"), R6(F.sum("w")).alias("weight"))


@query(sql("select match_id, champion_id, elapsed::bigint as elapsed, self_d::bigint as self_d from wt"))
def c3_distances(spark: SparkSession, d: str) -> DataFrame:
    return I.weighted(spark, d).select("match_id", "champion_id", F.col("elapsed").cast("bigint").alias("elapsed"), F.col("self_d").cast("bigint").alias("self_d"))


@query(sql("select match_id, champion_id, round(w + 1e-9, 6) as w from wt"))
def c4_decay_weight(spark: SparkSession, d: str) -> DataFrame:
    return I.weighted(spark, d).select("match_id", "champion_id", R6("w").alias("w"))


@query(sql("select career_id, match_type, (patch_seq is null)::int as undated, count(*) as rows from pa group by all"))
def c5_observation_scan(spark: SparkSession, d: str) -> DataFrame:
    return I.facts(spark, d).groupBy("career_id", "match_type", F.col("patch_seq").isNull().cast("int").alias("undated")).agg(F.count("*").alias("rows"))


@query(sql("select career_id, include_scrim::varchar as include_scrim, count(*) as rows from fl group by all"))
def c6_scrim_variants(spark: SparkSession, d: str) -> DataFrame:
    return I.flag_text(O.variants(I.facts(spark, d)).groupBy("career_id", "include_scrim").agg(F.count("*").alias("rows")))


@query(sql("select career_id, champion_id, count(*) as bans from bn group by all"))
def c7_ban_counts(spark: SparkSession, d: str) -> DataFrame:
    return I.bans(spark, d).groupBy("career_id", "champion_id").agg(F.count("*").alias("bans"))


@query(sql(f"select career_id, include_scrim::varchar as include_scrim, champion_id, {TALLY} from fl group by all"))
def c8_champion_tally(spark: SparkSession, d: str) -> DataFrame:
    t = O.tally(O.variants(I.weighted(spark, d)), ["career_id", "include_scrim", "champion_id"])
    return I.flag_text(_rounded_tally(t, "career_id", "include_scrim", "champion_id"))


@query(sql(f"select include_scrim::varchar as include_scrim, champion_id, {TALLY} from fl group by all"))
def c9_global_tally(spark: SparkSession, d: str) -> DataFrame:
    t = O.tally(O.variants(I.weighted(spark, d)), ["career_id", "include_scrim", "champion_id"])
    return I.flag_text(_rounded_tally(O.merged(t, ["include_scrim", "champion_id"]), "include_scrim", "champion_id"))


@query(sql("select career_id, include_scrim::varchar as include_scrim, count(distinct match_id) as matches, count(distinct match_id) filter (match_type = 'OFFICIAL') as officials from fl group by all"))
def c10_denominators(spark: SparkSession, d: str) -> DataFrame:
    v = O.variants(I.facts(spark, d))
    return I.flag_text(v.groupBy("career_id", "include_scrim").agg(F.count_distinct("match_id").alias("matches"), F.count_distinct(F.when(F.col("match_type") == "OFFICIAL", F.col("match_id"))).alias("officials")))


@query(sql("select career_id, champion_id, round(sum(w) * sum(w) / sum(w * w), 4) as ess from wt group by all"))
def c11_effective_size(spark: SparkSession, d: str) -> DataFrame:
    t = O.tally(I.weighted(spark, d), ["career_id", "champion_id"])
    return t.select("career_id", "champion_id", F.round(E.effective_size("weight", "square"), 4).alias("ess"))


@query(sql("select career_id, champion_id, round((sum(w * is_winner::int) + 12) / (sum(w) + 24) + 1e-9, 6) as adjusted from wt group by all"))
def c12_shrinkage(spark: SparkSession, d: str) -> DataFrame:
    t = O.tally(I.weighted(spark, d), ["career_id", "champion_id"])
    return t.select("career_id", "champion_id", R6(E.shrink("weighted_wins", "weight", 0.5, 24)).alias("adjusted"))


@query(sql("""select p.career_id, p.champion_id, p.patch_seq::bigint as patch_seq, round((p.v + 15 * (o.v + 12) / (o.n + 24)) / (p.n + 15) + 1e-9, 6) as adjusted
  from (select career_id, champion_id, patch_seq, count(*) as n, sum(is_winner::int) as v from pa where patch_seq is not null group by all) p
  join (select career_id, champion_id, count(*) as n, sum(is_winner::int) as v from pa group by all) o using (career_id, champion_id)"""))  # fmt: skip
def c13_two_stage_shrinkage(spark: SparkSession, d: str) -> DataFrame:
    f = I.facts(spark, d).withColumn("w", F.lit(1.0))
    overall = O.tally(f, ["career_id", "champion_id"]).select("career_id", "champion_id", E.shrink("weighted_wins", "weight", 0.5, 24).alias("target"))
    each = O.tally(f.where("patch_seq is not null"), ["career_id", "champion_id", "patch_seq"])
    return each.join(overall, ["career_id", "champion_id"]).select("career_id", "champion_id", F.col("patch_seq").cast("bigint").alias("patch_seq"), R6(E.shrink("weighted_wins", "weight", F.col("target"), 15)).alias("adjusted"))


@query(sql("select career_id, include_scrim::varchar as include_scrim, champion_id, games, wins, bans, matches, officials, ess, adjusted from tr", V.SQL + ",\n" + TIER_SQL))
def c14_tier_rows(spark: SparkSession, d: str) -> DataFrame:
    return I.flag_text(I.tiers(spark, d)).drop("win_rate", "pick_rate", "ban_rate")


@query(sql("select career_id, include_scrim::varchar as include_scrim, champion_id, win_rate, pick_rate, ban_rate from tr", V.SQL + ",\n" + TIER_SQL))
def c15_rates(spark: SparkSession, d: str) -> DataFrame:
    return I.flag_text(I.tiers(spark, d)).select("career_id", "include_scrim", "champion_id", "win_rate", "pick_rate", "ban_rate")


@query(sql("select career_id, champion_id, games, (games >= 10)::int as shown from (select career_id, champion_id, count(*) as games from pa group by all)"))
def c16_config_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """The validated settings, applied at display."""
    config = E.validated(E.CONFIG | {"unknown": 1.0})
    t = I.facts(spark, d).groupBy("career_id", "champion_id").agg(F.count("*").alias("games"))
    return t.withColumn("shown", (F.col("games") >= config["min_sample"]).cast("int"))


PAIRS_SQL = """oc as (select a.career_id, a.match_id, a.match_type, a.champion_id as winner, b.champion_id as loser, pow(0.5, (a.self_d + b.self_d) / 2.0) * pow(0.5, a.elapsed / 2.0) as w from wt a join wt b on a.match_id = b.match_id and a.is_winner and not b.is_winner),
dr as (select career_id, f.include_scrim, case when x.d = 1 then winner else loser end as a, case when x.d = 1 then loser else winner end as b, x.d as won, w from oc join (values (true), (false)) f(include_scrim) on f.include_scrim or match_type = 'OFFICIAL', (values (1), (0)) x(d))"""
PAIRS = V.SQL + ",\n" + PAIRS_SQL
SWEEPS = 1000
#: Bradley-Terry strengths by so many sweeps over the pair counts; each sweep is scaled to geometric mean 1.
STRENGTHS_SQL = f"""pc as materialized (select career_id, include_scrim, a, b, count(*) as n, sum(won) as won from dr group by all),
ch as materialized (select career_id, include_scrim, a, sum(won) as won from pc group by all),
sweep(i, career_id, include_scrim, a, s) as (select 0, career_id, include_scrim, a, 1.0::double from ch union all
  select i, career_id, include_scrim, a, raw / exp(avg(ln(raw)) over (partition by career_id, include_scrim)) from (select x.i + 1 as i, x.career_id, x.include_scrim, x.a, (any_value(ch.won) + 0.5) / (1 / (any_value(x.s) + 1) + sum(pc.n / (x.s + y.s))) as raw
  from sweep x join pc on pc.career_id = x.career_id and pc.include_scrim = x.include_scrim and pc.a = x.a join sweep y on y.career_id = x.career_id and y.include_scrim = x.include_scrim and y.a = pc.b
  join ch on ch.career_id = x.career_id and ch.include_scrim = x.include_scrim and ch.a = x.a where x.i < {SWEEPS} group by x.i, x.career_id, x.include_scrim, x.a)),
bt as (select * from sweep where i = {SWEEPS}),
er as (select dr.career_id, dr.include_scrim, dr.a, dr.b, count(*) as games, sum(won)::bigint as wins, sum(w) as sw, sum(w * won) as sww, sum(w * w) as sq, any_value(p.s) / (any_value(p.s) + any_value(q.s)) as expected from dr
  join bt p on p.career_id = dr.career_id and p.include_scrim = dr.include_scrim and p.a = dr.a join bt q on q.career_id = dr.career_id and q.include_scrim = dr.include_scrim and q.a = dr.b group by all)"""
FITTED = V.SQL + ",\n" + PAIRS_SQL + ",\n" + STRENGTHS_SQL


@query(sql("select career_id, winner, loser, count(*) as n, round(sum(w) + 1e-9, 6) as weight from oc group by all", PAIRS))
def d1_winner_loser_pairs(spark: SparkSession, d: str) -> DataFrame:
    return O.outcomes(I.weighted(spark, d)).groupBy("career_id", "winner", "loser").agg(F.count("*").alias("n"), R6(F.sum("w")).alias("weight"))


@query(sql("select career_id, include_scrim::varchar as include_scrim, a, b, count(*) as games, sum(won)::bigint as wins, round(sum(w) + 1e-9, 6) as weight, round(sum(w * won) + 1e-9, 6) as weighted_wins, round(sum(w * w) + 1e-9, 6) as square from dr group by all", PAIRS))
def d2_directed_pairs(spark: SparkSession, d: str) -> DataFrame:
    return I.flag_text(_rounded_tally(O.directed(O.outcomes(I.weighted(spark, d))), "career_id", "include_scrim", "a", "b"))


@query(sql("select include_scrim::varchar as include_scrim, a, b, count(*) as games, sum(won)::bigint as wins from dr group by all", PAIRS))
def d3_pairs_over_careers(spark: SparkSession, d: str) -> DataFrame:
    t = O.directed(O.outcomes(I.weighted(spark, d)))
    return I.flag_text(O.merged(t, ["include_scrim", "a", "b"]).select("include_scrim", "a", "b", "games", "wins"))


@query(sql("select career_id, include_scrim::varchar as include_scrim, a as champion_id, wins, games, round(s, 6) as strength from bt join (select career_id, include_scrim, a, sum(won)::bigint as wins, count(*) as games from dr group by all) using (career_id, include_scrim, a)", FITTED, recursive=True))
def d4_strengths(spark: SparkSession, d: str) -> DataFrame:
    """Per champion the strength and the wins and games that it is fitted on."""
    pairs = O.outcomes(I.weighted(spark, d))
    stats = O.directed(pairs).groupBy("career_id", "include_scrim", F.col("a").alias("champion_id")).agg(F.sum("wins").alias("wins"), F.sum("games").alias("games"))
    joined = stats.join(O.strengths(pairs), ["career_id", "include_scrim", "champion_id"])
    return I.flag_text(joined.select("career_id", "include_scrim", "champion_id", "wins", "games", F.round("strength", 6).alias("strength")))


@query(sql("select career_id, include_scrim::varchar as include_scrim, a, b, round(expected, 6) as expected from er", FITTED, recursive=True))
def d5_expected_rates(spark: SparkSession, d: str) -> DataFrame:
    c = O.counters(O.outcomes(I.weighted(spark, d)))
    return I.flag_text(c.select("career_id", "include_scrim", "a", "b", F.round("expected", 6).alias("expected")))


@query(sql("select career_id, include_scrim::varchar as include_scrim, a, b, games, wins, round(sw * sw / sq, 4) as ess, round(expected, 6) as expected, round((sww + K0 * expected) / (sw + K0), 6) as adjusted, round((sww + K0 * expected) / (sw + K0) - expected, 6) + 0.0 as effect from er".replace("K0", str(E.CONFIG["prior_strength_k0"])), FITTED, recursive=True))
def d6_counter_rows(spark: SparkSession, d: str) -> DataFrame:
    c = O.counters(O.outcomes(I.weighted(spark, d)))
    return I.flag_text(c.select("career_id", "include_scrim", "a", "b", "games", "wins", F.round("ess", 4).alias("ess"), F.round("expected", 6).alias("expected"), F.round("adjusted", 6).alias("adjusted"), (F.round("effect", 6) + 0.0).alias("effect")))


OBS_SQL = """ob as (select wt.* from wt join (select match_id from wt where match_type = 'OFFICIAL' group by match_id having count(*) filter (side = 'BLUE') = 4 and count(*) filter (side = 'RED') = 4) using (match_id)),
lg as (select ob.career_id, ob.match_id, ob.champion_id, ob.role, ob.team_id, ob.side, w, m.metric, case m.metric when 'dealing' then dealing when 'tanking' then tanking when 'healing' then healing when 'kills' then kills when 'deaths' then deaths else assists end as value
  from ob, (values ('dealing'), ('tanking'), ('healing'), ('kills'), ('deaths'), ('assists')) m(metric) where m.metric <> 'healing' or match_id not in (select match_id from ob where healing is null)),
mo as (select career_id, metric, champion_id, avg(value) as mean, stddev_pop(value) as sd from lg group by all),
mg as (select career_id, metric, stddev_pop(value) as all_sd from lg group by all),
zz as (select lg.*, (value - mean) / case when sd >= 1e-9 then sd when all_sd >= 1e-9 then all_sd else 1 end as z from lg join mo using (career_id, metric, champion_id) join mg using (career_id, metric)),
pp as (select a.career_id, a.match_id, a.champion_id as subject, a.role as ra, b.champion_id as other, b.role as rb, case when a.side = b.side then 'ALLY' else 'FOE' end as side from ob a join ob b on a.match_id = b.match_id and a.champion_id <> b.champion_id)"""
OBS = V.SQL + ",\n" + OBS_SQL


@query(sql("select ob.match_id, ob.champion_id, ob.team_id, round(ob.w, 6) as w, sum(pp.other) filter (pp.side = 'ALLY')::bigint as mates, sum(pp.other) filter (pp.side = 'FOE')::bigint as foes from ob join pp on pp.match_id = ob.match_id and pp.subject = ob.champion_id group by all", OBS))
def e1_pair_observations(spark: SparkSession, d: str) -> DataFrame:
    o = O.observations(I.weighted(spark, d))
    return o.selectExpr("match_id", "champion_id", "team_id", "round(w, 6) as w", "aggregate(mates, 0L, (a, m) -> a + m.id) as mates", "aggregate(foes, 0L, (a, m) -> a + m.id) as foes")


@query(sql("select career_id, metric, count(*) as rows, sum(value)::bigint as total from lg group by all", OBS))
def e2_metric_rows(spark: SparkSession, d: str) -> DataFrame:
    return O.unpivoted(O.observations(I.weighted(spark, d))).groupBy("career_id", "metric").agg(F.count("*").alias("rows"), F.sum("value").cast("bigint").alias("total"))


@query(sql("select match_id, champion_id, metric, round(z, 5) + 0.0 as z from zz", OBS))
def e3_standardised(spark: SparkSession, d: str) -> DataFrame:
    z = O.standardised(O.unpivoted(O.observations(I.weighted(spark, d))))
    return z.select("match_id", "champion_id", "metric", (F.round("z", 5) + 0.0).alias("z"))


FEATURES = """ft as (select career_id, match_id, champion_id, 'TEAM' as kind, team_id::bigint as subject, 0::bigint as other from ob where team_id is not null
  union all select career_id, match_id, subject, case side when 'ALLY' then 'MATE_ROLE' else 'FOE_ROLE' end, ra, rb from pp
  union all select career_id, match_id, subject, case side when 'ALLY' then 'MATE' else 'FOE' end, subject, other from pp)"""


@query(sql("select career_id, kind, subject, other, count(*) as n from ft group by all", OBS + ",\n" + FEATURES))
def e4_features(spark: SparkSession, d: str) -> DataFrame:
    return O.feature_counts(O.observations(I.weighted(spark, d)))


@query("select p_partkey, p_type, dense_rank() over (order by case when p_type like 'PROMO%' then 0 when p_type like 'STANDARD%' then 1 else 2 end) - 1 as role_no from part")
def e5_role_numbers(spark: SparkSession, d: str) -> DataFrame:
    """A role's number is its rank in the declared order of categories, not in the alphabet; the few categories are ranked, not the rows."""
    p = V.read(spark, d, "part").select("p_partkey", "p_type")
    order = F.when(F.col("p_type").startswith("PROMO"), 0).when(F.col("p_type").startswith("STANDARD"), 1).otherwise(2)
    from pyspark.sql import Window

    kinds = p.select(order.alias("o")).distinct().withColumn("role_no", (F.dense_rank().over(Window.orderBy("o")) - 1).cast("bigint"))
    return p.withColumn("o", order).join(kinds, "o").select("p_partkey", "p_type", "role_no")


@query(sql("select career_id, kind, count(*) as seen, count(*) filter (n_train = 0) as dropped from (select career_id, kind, subject, other, count(*) filter (match_id % 5 <> 0) as n_train, count(*) filter (match_id % 5 = 0) as n_valid from ft group by all) where n_valid > 0 group by all", OBS + ",\n" + FEATURES))
def e6_feature_projection(spark: SparkSession, d: str) -> DataFrame:
    """Features of the validation part, and those that training has not seen and that are dropped."""
    o = O.observations(I.weighted(spark, d))
    valid, train = (O.feature_counts(o.where(c)).select("career_id", "kind", "subject", "other") for c in ("match_id % 5 = 0", "match_id % 5 <> 0"))
    marked = valid.join(train.withColumn("known", F.lit(1)), ["career_id", "kind", "subject", "other"], "left")
    return marked.groupBy("career_id", "kind").agg(F.count("*").alias("seen"), F.count_if(F.col("known").isNull()).alias("dropped"))


@query(sql("select z.career_id, z.metric, kind || ':' || subject || ':' || other as feature, round(sum(w * z), 4) + 0.0 as moment from zz z join ft on ft.match_id = z.match_id and ft.champion_id = z.champion_id group by all", OBS + ",\n" + FEATURES))
def e7_ridge(spark: SparkSession, d: str) -> DataFrame:
    """The right side of the normal equations, rebuilt from the solution: per feature the weighted sum of the predictions of its
    observations, and its own penalised coefficient. It equals the moment of the data if and only if the solution is the minimum."""
    o = O.observations(I.weighted(spark, d))
    z, theta = O.standardised(O.unpivoted(o)), O.ridge(o).select("career_id", "metric", "feature", "theta")
    long = z.withColumn("f", F.explode(O.features(z))).select("career_id", "metric", "match_id", "champion_id", "w", F.concat_ws(":", "f.kind", "f.subject", "f.other").alias("feature"))
    known = long.join(theta, ["career_id", "metric", "feature"])
    predicted = known.groupBy("career_id", "metric", "match_id", "champion_id").agg(F.sum("theta").alias("p"))
    terms = known.join(predicted, ["career_id", "metric", "match_id", "champion_id"]).groupBy("career_id", "metric", "feature").agg(F.sum(F.col("w") * F.col("p")).alias("g"), F.first("theta").alias("theta"))
    penalty = F.when(F.col("feature").startswith("TEAM:"), O.RIDGE_TEAM).otherwise(O.RIDGE_OTHER)
    return terms.select("career_id", "metric", "feature", (F.round(F.col("g") + penalty * F.col("theta"), 4) + 0.0).alias("moment"))


@query(sql("select career_id, metric, count(*) as rows, true as better from zz group by all", OBS))
def e8_squared_errors(spark: SparkSession, d: str) -> DataFrame:
    """Whether the fit's weighted squared error is below that of predicting zero."""
    o = O.observations(I.weighted(spark, d))
    z, theta = O.standardised(O.unpivoted(o)), O.ridge(o).select("career_id", "metric", "feature", "theta")
    long = z.withColumn("f", F.explode(O.features(z))).withColumn("feature", F.concat_ws(":", "f.kind", "f.subject", "f.other"))
    predicted = long.join(theta, ["career_id", "metric", "feature"], "left").groupBy("career_id", "metric", "match_id", "champion_id").agg(F.first("z").alias("z"), F.first("w").alias("w"), F.sum("theta").alias("p"))
    errors = predicted.groupBy("career_id", "metric").agg(F.count("*").alias("rows"), F.sum(F.col("w") * F.pow(F.col("z") - F.col("p"), 2)).alias("sse"), F.sum(F.col("w") * F.pow("z", F.lit(2))).alias("zero"))
    return errors.select("career_id", "metric", "rows", (F.col("sse") <= F.col("zero")).alias("better"))


@query(sql("select career_id, side, subject, other, count(*) as observations from pp group by all", OBS))
def e9_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return O.pair_observations(O.observations(I.weighted(spark, d)))


@query(sql("select p.career_id, m.metric, side, subject, other, observations from (select career_id, side, subject, other, count(*) as observations from pp group by all having count(*) >= 10) p join (select distinct career_id, metric from lg) m using (career_id)", OBS))
def e10_effect_rows(spark: SparkSession, d: str) -> DataFrame:
    """Which effects are kept. Their values are checked by the optimality of the fit and by a planted effect in the tests."""
    return O.pair_effects(I.weighted(spark, d)).drop("effect")


@query(sql("select career_id, metric, count(*) as rows, round(sum(w), 4) as effective from lg group by all", OBS))
def e11_effective_rows(spark: SparkSession, d: str) -> DataFrame:
    return O.unpivoted(O.observations(I.weighted(spark, d))).groupBy("career_id", "metric").agg(F.count("*").alias("rows"), F.round(F.sum("w"), 4).alias("effective"))
