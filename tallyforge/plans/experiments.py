"""Queries of the statistical experiments and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import estimates as E
from ..operators import estimates as O
from ..operators import experiments as X
from ..operators import logit as L
from ..operators import refits as RF
from ..sources import views as V
from . import inputs as I
from .estimates import FITTED, PAIRS, TIER_SQL
from .inputs import sql
from .registry import query

R = lambda c, n=6: (F.round(F.col(c) if isinstance(c, str) else c, n) + 0.0)
SEED = 11
FLIP = f"{X.DRAW_SQL.format(i='match_id', s=SEED)} % 2 = 1"
OR = V.SQL + f""",
og as (select ct.*, {FLIP} as flip, ((winner_side = 'BLUE') <> ({FLIP}))::int as y from ct),
os as (select p0.match_id, p0.champion_id, og.y, case when (p0.side = 'BLUE') <> flip then 1 else -1 end as sign from p0 join og using (match_id))"""


def oriented(spark: SparkSession, d: str) -> DataFrame:
    return X.oriented(I.contests(spark, d), SEED)


@query(sql("select og.match_id, og.y, (case when flip then -1 else 1 end * (blue_score - red_score))::bigint as margin, (sum(champion_id) filter (sign = 1))::bigint as left_ids from og join os using (match_id) group by all", OR))
def j1_oriented(spark: SparkSession, d: str) -> DataFrame:
    return oriented(spark, d).select("match_id", "y", "margin", F.expr("aggregate(left, 0L, (a, x) -> a + x)").alias("left_ids"))


#: Signed terms of every block, champions of a side, of opponents and of teams joined with each other.
TERMS = OR + """,
tm as (
  select match_id, y, 'champion' as kind, champion_id as a, 0::bigint as b, 0::bigint as c, sign from os
  union all select match_id, y, 'team', career_id::bigint, (case when flip then red_team_id else blue_team_id end)::bigint, 0, 1 from og where match_type = 'OFFICIAL'
  union all select match_id, y, 'team', career_id::bigint, (case when flip then blue_team_id else red_team_id end)::bigint, 0, -1 from og where match_type = 'OFFICIAL'
  union all select x.match_id, x.y, 'pair', x.champion_id, y.champion_id, 0, x.sign from os x join os y on x.match_id = y.match_id and x.sign = y.sign and x.champion_id < y.champion_id
  union all select x.match_id, x.y, 'triple', x.champion_id, y.champion_id, z.champion_id, x.sign
    from os x join os y on x.match_id = y.match_id and x.sign = y.sign and x.champion_id < y.champion_id join os z on z.match_id = x.match_id and z.sign = x.sign and y.champion_id < z.champion_id
  union all select x.match_id, x.y, 'counter', least(x.champion_id, y.champion_id), greatest(x.champion_id, y.champion_id), 0, case when x.champion_id < y.champion_id then 1 else -1 end
    from os x join os y on x.match_id = y.match_id and x.sign = 1 and y.sign = -1)"""
BASE_GRID, EXTRA_GRID, FOLDS = [1.0, 4.0, 16.0, 64.0], [4.0, 16.0, 64.0, 256.0], 5


@query(sql("select kind, a, b, c, count(*) as n, sum(sign)::bigint as net from tm group by all", TERMS))
def j2_signed_features(spark: SparkSession, d: str) -> DataFrame:
    return L.signed_terms(oriented(spark, d)).groupBy("kind", "a", "b", "c").agg(F.count("*").alias("n"), F.sum("sign").alias("net"))


@query(sql("select kind, a, b, c, count(*) as n, sum(sign * y)::double as moment from tm group by all", TERMS))
def j3_ridge_logistic(spark: SparkSession, d: str) -> DataFrame:
    """All blocks fitted, champions and teams under penalty 16, combos under 64. ``moment`` is the chance-weighted sum of signs plus the penalty's pull,
    from coefficients and chances alone: at the minimum, and only there, it equals the sum of signed wins of the data."""
    o = oriented(spark, d)
    fits = [L.Fit("M6", 16.0, 64.0)]
    problem = L.packed(o, F.array("y"), F.array(F.lit(0)))
    thetas = L.solve(problem, fits)
    p = L.scores(problem, fits, thetas).select("match_id", "p")
    sums = L.by_contest(L.signed_terms(o), p).groupBy("kind", "a", "b", "c").agg(F.count("*").alias("n"), F.sum(F.col("sign") * F.col("p")).alias("expected"))
    pull = F.when(F.col("kind").isin(*L.BASE_KINDS), 16.0).otherwise(64.0) * F.col("theta")
    return sums.join(L.coefficients(problem, "M6", thetas[0]), ["kind", "a", "b", "c"]).select("kind", "a", "b", "c", "n", R(F.col("expected") + pull, 3).alias("moment"))


@query()
def j4_log_likelihood(spark: SparkSession, d: str) -> DataFrame:
    """Champions and teams (penalty 16), in sample: mean log-likelihood and accuracy of each career."""
    o = oriented(spark, d)
    fits = [L.Fit("M2", 16.0)]
    problem = L.packed(o, F.array("y"), F.array(F.lit(0)))
    held = L.by_contest(L.scores(problem, fits, L.solve(problem, fits)), o.select("match_id", "career_id"))
    return held.groupBy("career_id").agg(F.count("*").alias("contests"), F.avg("log_likelihood").alias("log_likelihood"), F.avg("hit").alias("accuracy"))


def held_out(spark: SparkSession, d: str) -> DataFrame:
    return L.cross_validated(oriented(spark, d), (X.draw("match_id", SEED) % FOLDS).cast("int"), FOLDS, BASE_GRID, EXTRA_GRID)


@query()
def j5_cross_validation(spark: SparkSession, d: str) -> DataFrame:
    """Every nested model under every pair of penalties, held out by fold, and which penalties each model chooses."""
    return L.settings(held_out(spark, d)).drop("setting")


@query()
def j6_model_comparison(spark: SparkSession, d: str) -> DataFrame:
    """What champions, teams, pairs, triples and counters add to held-out log-likelihood: paired mean, standard error, t and verdict."""
    return L.compared(held_out(spark, d))


@query()
def j7_margin(spark: SparkSession, d: str) -> DataFrame:
    """Score difference explained by champions, held out: rmse and r2 for each fold."""
    o = oriented(spark, d).withColumn("fold", (X.draw("match_id", SEED) % 5).cast("int")).withColumn("w", F.lit(1.0))
    g = X.gram_by_fold(o, ["career_id"], X.margin_terms(), "margin", "w")
    cv = X.nested_cv(g, ["career_id"], {"champions": ("champion",)}, {"champion": 16.0}, "career_id int")
    return cv.groupBy("career_id").agg(F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse"), (1 - F.sum("sse") / F.sum("zero")).alias("r2"))


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    z = O.wide_standardised(O.observations(I.weighted(spark, d)), ("match_id",))
    return O.gram_by_fold(z.withColumn("fold", (X.draw("match_id", SEED) % 4).cast("int")), 4)


PENALTIES = {"TEAM": 64.0, "MATE_ROLE": 16.0, "FOE_ROLE": 16.0, "MATE": 16.0, "FOE": 16.0}


@query()
def j8_output_models(spark: SparkSession, d: str) -> DataFrame:
    """Nested models of standardised outputs, held out by contest."""
    models = {"P0": (), "P1": ("TEAM",), "P2": ("TEAM", "FOE"), "P3": ("TEAM", "MATE"), "P4": ("TEAM", "MATE", "FOE")}
    return X.nested_cv(_outputs(spark, d), ["career_id", "metric"], models, PENALTIES, "career_id int, metric string").groupBy("career_id", "metric", "model").agg(F.sum("sse").alias("sse"), F.sum("n").alias("weight"))


@query()
def j9_role_ladder(spark: SparkSession, d: str) -> DataFrame:
    models = {"R0": (), "R1": ("TEAM",), "R2": ("TEAM", "MATE_ROLE", "FOE_ROLE"), "R3": ("TEAM", "MATE_ROLE", "FOE_ROLE", "MATE"), "R4": ("TEAM", "MATE_ROLE", "FOE_ROLE", "MATE", "FOE")}
    return X.nested_cv(_outputs(spark, d), ["career_id", "metric"], models, PENALTIES, "career_id int, metric string").groupBy("career_id", "metric", "model").agg(F.sum("sse").alias("sse"), F.sum("n").alias("weight"))


SIDES = V.SQL + """,
cr as (select champion_id, (sum(is_winner::int) + 12.0) / (count(*) + 24) as r from pa group by all),
sd as (select match_id, side, max(is_winner::int) as won, avg(r) as p from pa join cr using (champion_id) group by all),
cm as (select a.champion_id as a, b.champion_id as b, count(*) as n, sum(sd.won) as wins, sum(p) as expected, sum(p * (1 - p)) as noise from sd join pa a on a.match_id = sd.match_id and a.side = sd.side join pa b on b.match_id = sd.match_id and b.side = sd.side and a.champion_id < b.champion_id group by all)"""
LEAST = 5


_TRIPLES = "select a.champion_id as a, b.champion_id as b, c.champion_id as c3, count(*) as n, sum(sd.won) as wins, sum(p) as expected, sum(p * (1 - p)) as noise from sd join pa a on a.match_id = sd.match_id and a.side = sd.side join pa b on b.match_id = sd.match_id and b.side = sd.side and a.champion_id < b.champion_id join pa c on c.match_id = sd.match_id and c.side = sd.side and b.champion_id < c.champion_id group by all"


@query(sql("select a, b, n, wins::bigint as wins, round(expected, 6) as expected, round(noise, 6) as noise from cm", SIDES))
def g9_moments_of_two(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a side: contests, wins, the wins that their champions' rates lead to expect, and what chance scatters."""
    return moments(spark, d).select("a", "b", "n", "wins", R("expected").alias("expected"), R("noise").alias("noise"))


@query(sql(f"select a, b, c3, n, wins::bigint as wins, round(expected, 6) as expected, round(noise, 6) as noise from ({_TRIPLES})", SIDES))
def g9_moments_of_three(spark: SparkSession, d: str) -> DataFrame:
    m = X.combo_moments(X.side_rates(I.facts(spark, d)), size=3)
    return m.select("a", "b", "c3", "n", "wins", R("expected").alias("expected"), R("noise").alias("noise"))


def moments(spark: SparkSession, d: str) -> DataFrame:
    return X.combo_moments(X.side_rates(I.facts(spark, d)))


@query(sql("select count(*) as combos, round(var_pop(wins / n), 6) as observed, round(var_pop(expected / n), 6) as expected, round(var_pop((wins - expected) / n), 6) as residual, round(avg(noise / (n * n)), 6) as noise from cm where n >= 5", SIDES))
def j10_variance_decomposition(spark: SparkSession, d: str) -> DataFrame:
    return X.decomposition(moments(spark, d), LEAST).select("combos", *(R(c).alias(c) for c in ("observed", "expected", "residual", "noise")))


@query()
def j11_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """What pairs, triples and counters vary beyond champions alone, and beyond champions and teams, against refitted replicates of the fitted chances."""
    o = oriented(spark, d)
    return RF.bootstrap(o, "M1", 20, LEAST, SEED).withColumn("model", F.lit("M1")).unionByName(RF.bootstrap(o, "M2", 20, LEAST, SEED).withColumn("model", F.lit("M2")))


@query(sql("select round(greatest(residual - noise, 0) / residual, 6) as reliability, round(case when residual > noise then noise / (residual - noise) else null end, 3) as needed from (select var_pop((wins - expected) / n) as residual, avg(noise / (n * n)) as noise from cm where n >= 5)", SIDES))
def j12_reliability(spark: SparkSession, d: str) -> DataFrame:
    """Share of the residual variance that is not chance, and how many times the observations one to one would need."""
    v = X.decomposition(moments(spark, d), LEAST)
    real = F.greatest(F.col("residual") - F.col("noise"), F.lit(0.0))
    return v.select(R(real / F.col("residual")).alias("reliability"), F.round(F.when(F.col("residual") > F.col("noise"), F.col("noise") / real), 3).alias("needed"))


@query()
def j13_power(spark: SparkSession, d: str) -> DataFrame:
    """How often held-out comparison finds pair effects of a known spread."""
    return RF.power(oriented(spark, d), [0.0, 0.1, 0.2, 0.3, 0.45, 0.6], 10, FOLDS, SEED)


@query(sql("""select a, b, n, round(observed, 6) as observed, round(expected, 6) as expected, round(r, 6) as reliability, round(shrunk, 6) + 0.0 as shrunk from (
  select *, v / (v + nz) as r, (observed - expected) * v / (v + nz) as shrunk, row_number() over (order by round(abs((observed - expected) * v / (v + nz)), 9) desc, a, b) as place from (
    select a, b, n, wins / n as observed, expected / n as expected, noise / (n * n) as nz, (select greatest(var_pop((wins - expected) / n) - avg(noise / (n * n)), 0) from cm where n >= 5) as v from cm where n >= 5)) where place <= 8""", SIDES))
def j12_top_combos(spark: SparkSession, d: str) -> DataFrame:
    """The eight largest effects of pairs (a report of fixed length), each shrunk by its own reliability."""
    return X.shrunk_combos(moments(spark, d), LEAST, 8).select("a", "b", "n", R("observed").alias("observed"), R("expected").alias("expected"), R("reliability").alias("reliability"), R("shrunk").alias("shrunk"))


@query(sql("select career_id, axis, distance::bigint as distance, count(*) as n, round(sum(w), 6) as kept from (select career_id, 'elapsed' as axis, elapsed as distance, w from wt union all select career_id, 'self', self_d, w from wt) group by all"))
def j14_distance_histograms(spark: SparkSession, d: str) -> DataFrame:
    """How many observations lie how far back on either axis, and the weight that they keep."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("axis"), F.col(c).cast("bigint").alias("distance")) for k, c in (("elapsed", "elapsed"), ("self", "self_d"))))).alias("x")
    return I.weighted(spark, d).select("career_id", "w", each).groupBy("career_id", "x.axis", "x.distance").agg(F.count("*").alias("n"), R(F.sum("w")).alias("kept"))


@query(sql("select career_id, coalesce(patch_seq, 0)::bigint as patch_seq, count(distinct match_id) as contests, round(sum(w) / count(*), 6) as kept, max(elapsed)::bigint as elapsed, max(self_d)::bigint as self_d from wt group by all"))
def j14_patch_measures(spark: SparkSession, d: str) -> DataFrame:
    w = I.weighted(spark, d)
    return w.groupBy("career_id", F.coalesce("patch_seq", F.lit(0)).cast("bigint").alias("patch_seq")).agg(F.count_distinct("match_id").alias("contests"), R(F.sum("w") / F.count("*")).alias("kept"), F.max("elapsed").cast("bigint").alias("elapsed"), F.max("self_d").cast("bigint").alias("self_d"))


GRID = V.SQL + """,
gr as (select h.half_life, champion_id, count(*) as n, sum(gw) as sw, sum(gw * is_winner::int) as sv, sum(gw * gw) as sq from (select wt.*, h.half_life, case when h.half_life = 0 then 1.0 else pow(0.5, elapsed / h.half_life) end as gw from wt, (values (0.0), (1.0), (2.0), (4.0)) h(half_life)) h group by all),
gp as (select *, (sv + 12) / (sw + 24) as rate, sw * sw / sq as ess, row_number() over (partition by half_life order by (sv + 12) / (sw + 24) desc, champion_id) as place from gr),
gj as (select g.*, b.rate as r0, b.place as p0 from gp g join gp b on b.half_life = 0 and b.champion_id = g.champion_id)"""
LIVES = [0.0, 1.0, 2.0, 4.0]


@query(sql("select half_life::double as half_life, round(sum(sw) / sum(n), 6) as kept, round(corr(place, p0), 5) + 0.0 as spearman, round(max(abs(rate - r0)), 6) as max_shift from gj group by all", GRID))
def j15_half_life_grid(spark: SparkSession, d: str) -> DataFrame:
    s = X.grid_summary(X.half_life_grid(I.weighted(spark, d), LIVES))
    return s.select("half_life", R("kept").alias("kept"), R("spearman", 5).alias("spearman"), R("max_shift").alias("max_shift"))


WIN = V.SQL + """,
ew as (select career_id, champion_id, coalesce(patch_seq, 0) as win, count(*) as n, avg(is_winner::int) as r from pa group by all),
ww as (select a.career_id, a.champion_id, b.win as seq, a.n as n0, a.r as r0, b.n as n1, b.r as r1, (pe.seq is not null)::int as touched, coalesce(sign(pe.attack), 0)::int as direction from ew a join ew b on b.career_id = a.career_id and b.champion_id = a.champion_id and b.win = a.win + 1 left join pe on pe.career_id = a.career_id and pe.champion_id = a.champion_id and pe.seq = b.win)"""


def windows(spark: SparkSession, d: str) -> DataFrame:
    return X.windows(I.facts(spark, d), I.events(spark, d))


@query(sql("select career_id, seq::bigint as seq, touched, count(*) as champions, round(avg(abs(r1 - r0)), 6) as shift from ww where n0 >= 8 and n1 >= 8 group by all", WIN))
def j16_before_after(spark: SparkSession, d: str) -> DataFrame:
    return windows(spark, d).where("n0 >= 8 and n1 >= 8").groupBy("career_id", F.col("seq").cast("bigint").alias("seq"), "touched").agg(F.count("*").alias("champions"), R(F.avg(F.abs(F.col("r1") - F.col("r0")))).alias("shift"))


@query(sql(f"""select split, max(n) as estimates, count(*) filter (c >= 10) as solid, round(max(dev) filter (rn = n // 2 + 1), 6) as median, round(max(dev) filter (rn = (n * 9) // 10 + 1), 6) as p90, round(max(dev), 6) as most
  from (select split, c, dev, row_number() over (partition by split order by dev) as rn, count(*) over (partition by split) as n
    from (select split, c, abs((v + 15 * t) / (c + 15) - t) as dev from (
      select 'version' as split, career_id, champion_id, patch_seq as win, count(*) as c, sum(is_winner::int) as v from pa where patch_seq is not null group by all
      union all select 'random', career_id, champion_id, win, count(*), sum(is_winner::int) from pa join dw using (match_id, career_id) group by all)
    join (select career_id, champion_id, (sum(is_winner::int) + 12.0) / (count(*) + 24) as t from pa group by all) using (career_id, champion_id))) group by split""", V.SQL + f""",
sz as (select career_id, patch_seq, sum(count(*)) over (partition by career_id order by patch_seq) as stop from ct where patch_seq is not null group by career_id, patch_seq),
dr as (select career_id, match_id, row_number() over (partition by career_id order by {X.DRAW_SQL.format(i='match_id', s=SEED)}, match_id) - 1 as place from ct where patch_seq is not null),
dw as (select dr.career_id, match_id, min(patch_seq) as win from dr join sz on sz.career_id = dr.career_id and place < stop group by all)"""))
def j17_patch_deviation(spark: SparkSession, d: str) -> DataFrame:
    """Deviation of each version's estimate from the whole, beside that of random windows of the same sizes; median and p90 are elements of the sorted list."""
    dev = X.split_deviation(I.facts(spark, d), SEED)
    at = X.elements(dev, "dev", ["split"], {"median": F.floor(F.col("n") / 2), "p90": F.floor(F.col("n") * 9 / 10)})
    rest = dev.groupBy("split").agg(F.count_if(F.col("n") >= 10).alias("solid"), R(F.max("dev")).alias("most"))
    return at.join(rest, "split").select("split", F.col("n").alias("estimates"), "solid", R("median").alias("median"), R("p90").alias("p90"), "most")


def _spread(value) -> list:
    """Mean, its standard error and their ratio over a group; the last two are null for one value, or none apart."""
    se = F.stddev_samp(value) / F.sqrt(F.count("*").cast("double"))
    return [R(F.avg(value)).alias("effect"), R(se).alias("se"), R(F.when(se > 1e-9, F.avg(value) / se), 4).alias("t")]


@query(sql("""select direction, windows, round(m, 6) + 0.0 as effect, round(se, 6) + 0.0 as se, round(case when se > 1e-9 then m / se end, 4) + 0.0 as t
  from (select direction, count(*) as windows, avg(direction * (r1 - r0)) as m, stddev_samp(direction * (r1 - r0)) / sqrt(count(*)) as se from ww where touched = 1 group by all)""", WIN))  # fmt: skip
def j18_patch_direction(spark: SparkSession, d: str) -> DataFrame:
    """Shift of touched champions in the direction of their change: mean, standard error, t."""
    return windows(spark, d).where("touched = 1").groupBy("direction").agg(F.count("*").alias("windows"), *_spread(F.col("direction") * (F.col("r1") - F.col("r0"))))


@query(sql("""select *, 2 * se as detectable from (select windows, round(m, 6) + 0.0 as effect, round(se, 6) + 0.0 as se, round(case when se > 1e-9 then m / se end, 4) + 0.0 as t, round(residual, 6) as residual from (select count(*) as windows, avg(v) as m, stddev_samp(v) / sqrt(count(*)) as se, any_value(sqrt(rv)) as residual
  from (select direction * (r1 - r0 - (s * r0 + i)) as v, rv from ww, (select regr_slope(r1 - r0, r0) as s, regr_intercept(r1 - r0, r0) as i, (regr_syy(r1 - r0, r0) - regr_sxy(r1 - r0, r0) * regr_sxy(r1 - r0, r0) / nullif(regr_sxx(r1 - r0, r0), 0)) / nullif(count(*) - 2, 0) as rv from ww where touched = 0) where touched = 1)))""", WIN))  # fmt: skip
def j19_detectable_size(spark: SparkSession, d: str) -> DataFrame:
    """Net effect of all changes in their direction, spread of the line's residuals, and the size that this many windows could show (t = 2)."""
    w, y, x = windows(spark, d), F.col("r1") - F.col("r0"), F.col("r0")
    rv = (F.regr_syy(y, x) - F.pow(F.regr_sxy(y, x), 2) / F.nullif(F.regr_sxx(y, x), F.lit(0.0))) / F.nullif(F.count("*") - 2, F.lit(0))
    line = w.where("touched = 0").agg(F.regr_slope(y, x).alias("s"), F.regr_intercept(y, x).alias("i"), rv.alias("rv"))
    net = w.where("touched = 1").join(F.broadcast(line), how="cross").select((F.col("direction") * (y - (F.col("s") * x + F.col("i")))).alias("v"), "rv")  # one row
    return net.agg(F.count("*").alias("windows"), *_spread(F.col("v")), R(F.sqrt(F.first("rv"))).alias("residual")).withColumn("detectable", 2 * F.col("se"))


@query(sql("select w.career_id, w.champion_id, w.seq::bigint as seq, round(r1 - r0 - (s * r0 + i), 5) + 0.0 as net from ww w, (select regr_slope(r1 - r0, r0) as s, regr_intercept(r1 - r0, r0) as i from ww where touched = 0) where touched = 1", WIN))
def j19_regression_to_mean(spark: SparkSession, d: str) -> DataFrame:
    """Shifts of touched champions less what untouched ones of the same start show."""
    w = windows(spark, d)
    line = w.where("touched = 0").agg(F.regr_slope(F.col("r1") - F.col("r0"), F.col("r0")).alias("s"), F.regr_intercept(F.col("r1") - F.col("r0"), F.col("r0")).alias("i"))
    return w.where("touched = 1").join(F.broadcast(line), how="cross").select("career_id", "champion_id", F.col("seq").cast("bigint").alias("seq"), R(F.col("r1") - F.col("r0") - (F.col("s") * F.col("r0") + F.col("i")), 5).alias("net"))  # one row


@query(sql("select career_id, champion_id, count(*) as games, round(count(*) filter (self_d > 0) / count(*), 6) as stale, round((sum(is_winner::int) filter (self_d = 0) + 12.0) / (count(*) filter (self_d = 0) + 24) - (sum(is_winner::int) + 12.0) / (count(*) + 24), 6) + 0.0 as hard_cut from wt group by all having count(*) filter (self_d = 0) > 0"))
def j20_stale_share(spark: SparkSession, d: str) -> DataFrame:
    w, fresh, win = I.weighted(spark, d), F.col("self_d") == 0, F.col("is_winner").cast("int")
    t = w.groupBy("career_id", "champion_id").agg(F.count("*").alias("games"), F.count_if(fresh).alias("fresh"), F.sum(F.when(fresh, win)).alias("fw"), F.sum(win).alias("wins")).where("fresh > 0")
    return t.select("career_id", "champion_id", "games", R(1 - F.col("fresh") / F.col("games")).alias("stale"), R((F.col("fw") + 12) / (F.col("fresh") + 24) - (F.col("wins") + 12) / (F.col("games") + 24)).alias("hard_cut"))


SELF_LIVES, AGE_LIVES = [X.NO_DECAY, 2.0, 1.0, 0.5, X.HARD_CUT], [X.NO_DECAY, 4.0, 1.0]
DECAY = V.SQL + f""",
dg as (select self_life, life, champion_id, round((sum(gw * is_winner::int) + 12) / (sum(gw) + 24), 9) as rate, sum(gw) as sw from (
  select champion_id, is_winner, s.self_life, a.life, case when s.self_life = 0 then (self_d = 0)::int::double else pow(0.5, self_d / s.self_life) end * pow(0.5, elapsed / a.life) as gw
  from wt, (values {", ".join(f"({x}::double)" for x in SELF_LIVES)}) s(self_life), (values {", ".join(f"({x}::double)" for x in AGE_LIVES)}) a(life)) group by all),
dp as (select *, row_number() over (partition by self_life, life order by rate, champion_id) as place from dg),
dc as (select distinct champion_id from wt where self_d > 0),
dj as (select x.*, b.rate as r0, b.sw as w0, b.place as p0, dc.champion_id is not null as changed from dp x join dp b on b.champion_id = x.champion_id and b.self_life = 1e9 and b.life = 1e9 left join dc on dc.champion_id = x.champion_id)"""


@query(sql("select self_life, life, count(*) filter (changed) as changed, round(sum(sw) filter (changed) / sum(w0) filter (changed), 6) as kept, round(avg(abs(rate - r0)) filter (changed), 6) as mean_shift, round(max(abs(rate - r0)) filter (changed), 6) as max_shift, max(abs(place - p0))::bigint as max_move from dj group by all", DECAY))
def j20_decay_grid(spark: SparkSession, d: str) -> DataFrame:
    """Half-lives of own changes, down to a hard cut, beside half-lives of age: rates kept and moved, and rank moves."""
    g = X.decay_grid(I.weighted(spark, d), SELF_LIVES, AGE_LIVES)
    return g.select("self_life", "life", "changed", *(R(c).alias(c) for c in ("kept", "mean_shift", "max_shift")), "max_move")


@query(sql("select champion_id, sum(attack) filter (career_id = 1)::bigint as first, sum(attack) filter (career_id = 2)::bigint as second from pe group by champion_id having count(distinct sign(attack)) filter (attack <> 0) > 1"))
def j21_divergence(spark: SparkSession, d: str) -> DataFrame:
    e = I.events(spark, d)
    g = e.groupBy("champion_id").agg(F.sum(F.when(F.col("career_id") == 1, F.col("attack"))).alias("first"), F.sum(F.when(F.col("career_id") == 2, F.col("attack"))).alias("second"), F.count_distinct(F.when(F.col("attack") != 0, F.signum("attack"))).alias("signs"))
    return g.where("signs > 1").drop("signs")


@query(sql("select half_life::double as half_life, count(*) filter (ess >= 10) as solid, round(avg(abs(rate - r0)), 6) as mean_shift, max(abs(place - p0))::bigint as max_move from gj group by all", GRID))
def j22_meta_grid(spark: SparkSession, d: str) -> DataFrame:
    s = X.grid_summary(X.half_life_grid(I.weighted(spark, d), LIVES))
    return s.select("half_life", "solid", R("mean_shift").alias("mean_shift"), "max_move")


GRID_CAREERS = GRID.replace("select h.half_life, champion_id,", "select h.half_life, career_id, champion_id,").replace("partition by half_life order by", "partition by career_id, half_life order by").replace("b.champion_id = g.champion_id", "b.champion_id = g.champion_id and b.career_id = g.career_id")


@query(sql("select career_id, half_life::double as half_life, round(sum(sw) / sum(n), 6) as kept, count(*) filter (ess >= 10) as solid, round(avg(abs(rate - r0)), 6) as mean_shift, round(max(abs(rate - r0)), 6) as max_shift, max(abs(place - p0))::bigint as max_move from gj group by all", GRID_CAREERS))
def j22_meta_grid_by_career(spark: SparkSession, d: str) -> DataFrame:
    s = X.grid_summary(X.half_life_grid(I.weighted(spark, d), LIVES, by=["career_id"]), ["career_id"])
    return s.select("career_id", "half_life", R("kept").alias("kept"), "solid", R("mean_shift").alias("mean_shift"), R("max_shift").alias("max_shift"), "max_move")


@query(sql("select match_type, count(*) filter (a.side <> b.side) as enemies, count(*) filter (a.side = b.side) as allies from pa a join (select match_id, side from pa where champion_id = 9) b using (match_id) where a.champion_id = 4 group by all"))
def j23_head_to_head(spark: SparkSession, d: str) -> DataFrame:
    ids = lambda s: F.transform(F.filter("stats", lambda x: x["side"] == s), lambda x: x["champion_id"])
    c = I.contests(spark, d).select("match_type", ids("BLUE").alias("b"), ids("RED").alias("r"))
    four, nine = F.lit(4).cast("bigint"), F.lit(9).cast("bigint")
    same = (F.array_contains("b", four) & F.array_contains("b", nine)) | (F.array_contains("r", four) & F.array_contains("r", nine))
    cross = (F.array_contains("b", four) & F.array_contains("r", nine)) | (F.array_contains("r", four) & F.array_contains("b", nine))
    return c.where(same | cross).groupBy("match_type").agg(F.count_if(cross).alias("enemies"), F.count_if(same).alias("allies"))


TIER = V.SQL + ",\n" + TIER_SQL


@query(sql("select career_id, include_scrim::varchar as include_scrim, count(*) as champions, round(avg(adjusted) + 1e-9, 5) as mean, round(stddev_samp(adjusted) + 1e-9, 5) as sd, min(adjusted) as low, max(adjusted) as high, round(quantile_cont(adjusted, 0.05) + 1e-9, 5) as p05, round(quantile_cont(adjusted, 0.5) + 1e-9, 5) as p50, round(quantile_cont(adjusted, 0.95) + 1e-9, 5) as p95, sum(games)::bigint as games, sum(wins)::bigint as wins, count(*) filter (games = 0 and bans > 0) as only_banned, round(sum(pick_rate), 1) as picks from tr group by all", TIER))
def j24_tier_report(spark: SparkSession, d: str) -> DataFrame:
    t = I.tiers(spark, d).groupBy("career_id", "include_scrim")
    return I.flag_text(
        t.agg(
            F.count("*").alias("champions"), F.round(F.avg("adjusted") + 1e-9, 5).alias("mean"), F.round(F.stddev_samp("adjusted") + 1e-9, 5).alias("sd"), F.min("adjusted").alias("low"), F.max("adjusted").alias("high"),
            *(F.round(F.percentile("adjusted", p) + 1e-9, 5).alias(n) for n, p in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))),
            F.sum("games").alias("games"), F.sum("wins").alias("wins"), F.count_if((F.col("games") == 0) & (F.col("bans") > 0)).alias("only_banned"), F.round(F.sum("pick_rate"), 1).alias("picks"),
        )
    )


@query(sql("""select career_id, include_scrim::varchar as include_scrim, champions, round(sqrt(ov), 6) as observed, round(sqrt(nv), 6) as noise, case when ov > nv + 1e-12 then round(sqrt(ov - nv), 5) end as real, case when ov > nv + 1e-12 then round(pq / (ov - nv), 2) end as implied_k0, case when ov > 0 then round(nv / ov, 5) end as noise_share
  from (select career_id, include_scrim, count(*) as champions, var_samp(wins / games) as ov, avg(wins / games * (1 - wins / games) / games) as nv, avg(wins / games * (1 - wins / games)) as pq from tr where games > 0 group by all)""", TIER))
def j24_signal_noise(spark: SparkSession, d: str) -> DataFrame:
    """How far raw rates scatter, how far chance alone would, what is left, and the strength of shrinkage that this implies."""
    p, n = F.col("wins") / F.col("games"), F.col("games")
    t = I.tiers(spark, d).where("games > 0").groupBy("career_id", "include_scrim").agg(F.count("*").alias("champions"), F.var_samp(p).alias("ov"), F.avg(p * (1 - p) / n).alias("nv"), F.avg(p * (1 - p)).alias("pq"))
    some = F.col("ov") > F.col("nv") + 1e-12
    out = t.select(
        "career_id", "include_scrim", "champions", F.round(F.sqrt("ov"), 6).alias("observed"), F.round(F.sqrt("nv"), 6).alias("noise"), F.when(some, F.round(F.sqrt(F.col("ov") - F.col("nv")), 5)).alias("real"),
        F.when(some, F.round(F.col("pq") / (F.col("ov") - F.col("nv")), 2)).alias("implied_k0"), F.when(F.col("ov") > 0, F.round(F.col("nv") / F.col("ov"), 5)).alias("noise_share"),
    )
    return I.flag_text(out)


@query(sql("select career_id, include_scrim::varchar as include_scrim, count(*) as pairs, count(distinct a) as champions, max(games) as most from (select career_id, include_scrim, a, b, count(*) as games from dr group by all) group by all", PAIRS))
def j25_rows_per_scope(spark: SparkSession, d: str) -> DataFrame:
    """How many directed pairs each scope has, of how many champions, and the games of the commonest."""
    p = O.directed(O.outcomes(I.weighted(spark, d)))
    return I.flag_text(p.groupBy("career_id", "include_scrim").agg(F.count("*").alias("pairs"), F.count_distinct("a").alias("champions"), F.max("games").alias("most")))


@query(sql("select career_id, a, b, games, wins, rn from (select career_id, a, b, count(*) as games, sum(won)::bigint as wins, row_number() over (partition by career_id order by sum(won) / count(*) desc, count(*) desc, a, b) as rn from dr where include_scrim group by career_id, a, b having count(*) >= 3) where rn <= 20", PAIRS))
def j25_counter_report(spark: SparkSession, d: str) -> DataFrame:
    """The twenty directed pairs of each career with the best raw rate among those seen often enough."""
    p = O.directed(O.outcomes(I.weighted(spark, d))).where("include_scrim and games >= 3")
    w = Window.partitionBy("career_id").orderBy((F.col("wins") / F.col("games")).desc(), F.col("games").desc(), "a", "b")
    return p.withColumn("rn", F.row_number().over(w).cast("bigint")).where("rn <= 20").select("career_id", "a", "b", "games", "wins", "rn")


@query(sql("select career_id, match_type, winner_side, count(*) as contests, sum((blue = 4 and red = 4)::int)::bigint as balanced from (select career_id, match_type, winner_side, match_id, count(*) filter (side = 'BLUE') as blue, count(*) filter (side = 'RED') as red from pa group by all) group by all"))
def j26_pair_audit(spark: SparkSession, d: str) -> DataFrame:
    m = I.facts(spark, d).groupBy("career_id", "match_type", "winner_side", "match_id").agg(F.count_if(F.col("side") == "BLUE").alias("blue"), F.count_if(F.col("side") == "RED").alias("red"))
    return m.groupBy("career_id", "match_type", "winner_side").agg(F.count("*").alias("contests"), F.sum(F.expr("int(blue = 4 and red = 4)")).alias("balanced"))


_LISTED = (("top", "adjusted desc", "games > 0", 5), ("bottom", "adjusted", "games > 0", 5), ("banned", "bans desc", "bans > 0", 10))


@query(sql(" union all ".join(f"select career_id, include_scrim::varchar as include_scrim, '{n}' as list, champion_id, rn from (select *, row_number() over (partition by career_id, include_scrim order by {o}, champion_id) as rn from tr where {w}) where rn <= {k}" for n, o, w, k in _LISTED), TIER))
def j24_tier_lists(spark: SparkSession, d: str) -> DataFrame:
    """Best and worst five by estimate and the ten most banned, per career and flag."""
    t, out = I.flag_text(I.tiers(spark, d)), None
    for name, order, where, most in _LISTED:
        w = Window.partitionBy("career_id", "include_scrim").orderBy(F.expr(order.removesuffix(" desc")).desc() if order.endswith(" desc") else F.expr(order), "champion_id")
        part = t.where(where).withColumn("rn", F.row_number().over(w).cast("bigint")).where(F.col("rn") <= most).select("career_id", "include_scrim", F.lit(name).alias("list"), "champion_id", "rn")
        out = part if out is None else out.unionByName(part)
    return out


@query(sql("select a.career_id, a.champion_id, a.games as with_scrim, b.games as official, round(a.adjusted - b.adjusted, 4) + 0.0 as difference from tr a join tr b using (career_id, champion_id) where a.include_scrim and not b.include_scrim and a.games > 0 and b.games > 0", TIER))
def j24_scrim_difference(spark: SparkSession, d: str) -> DataFrame:
    """How far estimates move when unofficial contests count."""
    t = I.tiers(spark, d).where("games > 0")
    on, off = (t.where(f"{'' if x else 'not '}include_scrim").select("career_id", "champion_id", F.col("games").alias(n), F.col("adjusted").alias(f"e_{n}")) for x, n in ((True, "with_scrim"), (False, "official")))
    return on.join(off, ["career_id", "champion_id"]).select("career_id", "champion_id", "with_scrim", "official", R(F.col("e_with_scrim") - F.col("e_official"), 4).alias("difference"))


@query(sql("""select career_id, a, b, by_effect, by_raw, (by_effect <= 20 and by_raw <= 20)::int as both from (select career_id, a, b, row_number() over (partition by career_id order by round((sww + K0 * expected) / (sw + K0) - expected, 6) desc, a, b) as by_effect,
  row_number() over (partition by career_id order by wins / games desc, games desc, a, b) as by_raw from er where include_scrim and games >= 3) where by_effect <= 20 or by_raw <= 20""".replace("K0", str(E.CONFIG["prior_strength_k0"])), FITTED, recursive=True))  # fmt: skip
def j25_list_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The top twenty pairs of each career by fitted effect and by raw rate, with their places in both lists."""
    c = O.counters(O.outcomes(I.weighted(spark, d))).where("include_scrim and games >= 3").withColumn("e", F.round("effect", 6))
    effect, raw = (Window.partitionBy("career_id").orderBy(*order, "a", "b") for order in ([F.col("e").desc()], [(F.col("wins") / F.col("games")).desc(), F.col("games").desc()]))
    placed = c.select("career_id", "a", "b", F.row_number().over(effect).cast("bigint").alias("by_effect"), F.row_number().over(raw).cast("bigint").alias("by_raw")).where("by_effect <= 20 or by_raw <= 20")
    return placed.withColumn("both", F.expr("int(by_effect <= 20 and by_raw <= 20)"))


@query(sql("select career_id, count(*) as pairs, round(min(ess), 4) as low, round(quantile_cont(ess, 0.5), 4) as median, round(max(ess), 4) as high, count(*) filter (ess >= 10) as solid, round(sum(sw) / sum(n), 6) as kept from (select career_id, a, b, count(*) as n, sum(w) as sw, sum(w) * sum(w) / sum(w * w) as ess from dr where include_scrim group by all) group by all", PAIRS))
def j25_effective_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Effective sizes of the directed pairs of a career, and the share of weight that decay leaves."""
    p = O.directed(O.outcomes(I.weighted(spark, d))).where("include_scrim").withColumn("ess", F.col("weight") * F.col("weight") / F.col("square"))
    return p.groupBy("career_id").agg(F.count("*").alias("pairs"), R(F.min("ess"), 4).alias("low"), R(F.percentile("ess", 0.5), 4).alias("median"), R(F.max("ess"), 4).alias("high"), F.count_if(F.col("ess") >= 10).alias("solid"), R(F.sum("weight") / F.sum("games")).alias("kept"))


@query(sql("select a.career_id, a.match_type, least(a.champion_id, b.champion_id) as a, greatest(a.champion_id, b.champion_id) as b, count(*) filter (a.side = b.side) as mates, count(*) filter (a.side <> b.side) as foes from pa a join pa b on a.match_id = b.match_id and a.champion_id < b.champion_id group by all"))
def j26_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """How often each two champions met, on one side and on opposite ones, per career and type of contest; pairs come from a contest's own eight rows."""
    two = "flatten(transform(stats, x -> transform(filter(stats, y -> y.champion_id > x.champion_id), y -> struct(x.champion_id as a, y.champion_id as b, x.side = y.side as same))))"
    c = I.contests(spark, d).select("career_id", "match_type", F.explode(F.expr(two)).alias("p"))
    return c.groupBy("career_id", "match_type", "p.a", "p.b").agg(F.count_if("p.same").alias("mates"), F.count_if(~F.col("p.same")).alias("foes"))
