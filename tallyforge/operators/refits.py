"""Experiments that fit the same model to many redrawn label sets: a bootstrap null with refits, and power by injected effects.

A replicate is a label column of the packed contests, so all replicates are fitted together (see ``logit``). Draws are hashes of ids, replicate and seed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import logit as L
from .experiments import MODULUS, draw

#: Penalty of every block in the variance decomposition, and of both kinds of blocks in the power run.
NULL_PENALTY, POWER_PENALTY = 1.0, 16.0


def uniform(ident: Column | str, seed: Column | int) -> Column:
    return draw(ident, seed) / float(MODULUS)


def normal(*ids: Column) -> Column:
    """A standard normal by two hashes of ids (Box and Muller)."""
    u = [(F.pmod(F.xxhash64(F.lit(k), *ids), F.lit(1 << 52)) + 0.5) / float(1 << 52) for k in (1, 2)]
    return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1])


def measured(o: DataFrame) -> DataFrame:
    """(match_id, measure, a, b, c, left): pairs and triples of each side, and both directions of opponents; ``left``: the key's chance is the left side's."""

    def combos(side: str, left: str) -> str:
        return f"""flatten(transform({side}, x -> transform(filter({side}, y -> y > x), y -> struct('pair' as measure, x as a, y as b, 0L as c, {left} as left)))),
            flatten(flatten(transform({side}, x -> transform(filter({side}, y -> y > x), y -> transform(filter({side}, z -> z > y), z -> struct('triple' as measure, x as a, y as b, z as c, {left} as left))))))"""

    def counters(x: str, y: str, left: str) -> str:
        return f"flatten(transform({x}, x -> transform({y}, y -> struct('counter' as measure, x as a, y as b, 0L as c, {left} as left))))"

    every = F.expr(f"concat({combos('left', 'true')}, {combos('right', 'false')}, {counters('left', 'right', 'true')}, {counters('right', 'left', 'false')})")
    return o.select("match_id", F.explode(every).alias("m")).select("match_id", "m.*")


def raw_variance(o: DataFrame, chances: DataFrame, least: int) -> DataFrame:
    """(replicate, measure, groups, raw): variance of observed less expected rates of combos of at least ``least`` contests, less what chance gives (the moments of a
    Poisson binomial), for chances (match_id, replicate, p, y) of the left side. Fewer than two combos give no row."""
    q, won = F.when(F.col("left"), F.col("p")).otherwise(1 - F.col("p")), F.when(F.col("left"), F.col("y")).otherwise(1 - F.col("y"))
    each = L.by_contest(measured(o), chances).groupBy("replicate", "measure", "a", "b", "c").agg(F.count("*").alias("n"), F.sum(won).alias("wins"), F.sum(q).alias("sum_p"), F.sum(q * (1 - q)).alias("sum_pq"))
    n = F.col("n")
    made = each.where(n >= least).groupBy("replicate", "measure").agg(F.count("*").alias("groups"), (F.var_pop((F.col("wins") - F.col("sum_p")) / n) - F.avg(F.col("sum_pq") / (n * n))).alias("raw"))
    return made.where("groups >= 2")


def bootstrap(o: DataFrame, model: str, replicates: int, least: int, seed: int) -> DataFrame:
    """(measure, groups, replicates, seen, floor, floor_sd, corrected, p_value): the variance that combos add beyond ``model``, against labels redrawn from its
    chances. Every replicate is fitted anew, since the fit itself makes a floor; p-values count the data as one more replicate."""
    first = L.packed(o, F.array("y"), F.array(F.lit(0)))
    fit = [L.Fit(model, NULL_PENALTY, NULL_PENALTY)]
    fitted = L.scores(first, fit, L.solve(first, fit)).select("match_id", F.col("p").alias("p0"))
    redrawn = [(uniform("match_id", seed + 7919 * r) < F.col("p0")).cast("int") for r in range(1, replicates + 1)]
    drawn = L.written(L.by_contest(o, fitted).withColumn("labels", F.array("y", *redrawn)), "bootstrap-labels")
    fits = [L.Fit(model, NULL_PENALTY, NULL_PENALTY, label=r) for r in range(replicates + 1)]
    problem = L.packed(drawn, F.col("labels"), F.array(F.lit(0)), (first.keys, first.sizes))
    made = L.scores(problem, fits, L.solve(problem, fits)).select("match_id", F.col("fit").alias("replicate"), "p")
    chances = L.by_contest(made, drawn.select("match_id", "labels")).select("match_id", "replicate", "p", F.col("labels")[F.col("replicate")].alias("y"))
    raw = L.written(raw_variance(o, chances, least), "bootstrap-variance")
    seen = raw.where("replicate = 0").select("measure", "groups", F.col("raw").alias("seen"))
    null = raw.where("replicate > 0").join(F.broadcast(seen), "measure")  # a row for each measure
    out = null.groupBy("measure", "seen").agg(
        F.max("replicate").alias("replicates"), F.avg("raw").alias("floor"), F.stddev_pop("raw").alias("floor_sd"), ((F.count_if(F.col("raw") >= F.col("seen")) + 1) / (F.count("*") + 1)).alias("p_value")
    )
    return out.join(seen.select("measure", "groups"), "measure").select("measure", "groups", "replicates", "seen", "floor", "floor_sd", (F.col("seen") - F.col("floor")).alias("corrected"), "p_value")


def power(o: DataFrame, spreads: list[float], repeats: int, folds: int, seed: int) -> DataFrame:
    """(spread, repeats, hits, hit_rate, mean_t): how often the paired t of pairs over teams (M2 to M3), held out, exceeds 2 when each pair of a side has a
    normal effect of the given spread on the log-odds. A repeat has the same effects, draws and folds under every spread."""
    start = L.packed(o, F.array("y"), F.array(F.lit(0)))
    fit = [L.Fit("M2", POWER_PENALTY)]
    base = L.scores(start, fit, L.solve(start, fit)).select("match_id", F.log(F.col("p") / (1 - F.col("p"))).alias("eta"))

    def shift(side: str, r: int) -> Column:
        pairs = F.expr(f"flatten(transform({side}, x -> transform(filter({side}, y -> y > x), y -> struct(x as a, y as b))))")
        return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + normal(x["a"], x["b"], F.lit(r), F.lit(seed)))

    moved = L.by_contest(o, base).withColumn("shift", F.array(*(shift("left", r) - shift("right", r) for r in range(repeats))))
    label = [(uniform("match_id", seed + 104729 + 7919 * r) < 1 / (1 + F.exp(-(F.col("eta") + F.lit(s) * F.col("shift")[r])))).cast("int") for s in spreads for r in range(repeats)]
    fold = [(draw("match_id", seed + 15485863 + 6007 * r) % folds).cast("int") for r in range(repeats)]
    drawn = L.written(moved.withColumn("labels", F.array(*label)).withColumn("folds", F.array(*fold)), "power-labels")
    problem = L.packed(drawn, F.col("labels"), F.col("folds"), (start.keys, start.sizes))
    fits, about = [], []
    for k, s in enumerate(spreads):
        for r in range(repeats):
            for m in ("M2", "M3"):
                about += [(len(fits) + f, float(s), r, m) for f in range(folds)]
                fits += [L.Fit(m, POWER_PENALTY, POWER_PENALTY, k * repeats + r, r, f) for f in range(folds)]
    names = o.sparkSession.createDataFrame(about, "fit int, spread double, repeat int, model string")  # a row for each fit
    held = L.scores(problem, fits, L.solve(problem, fits)).join(F.broadcast(names), "fit")
    gain = held.groupBy("match_id", "spread", "repeat").agg(F.sum(F.when(F.col("model") == "M3", F.col("log_likelihood")).otherwise(-F.col("log_likelihood"))).alias("d"))
    t = L.paired(gain.groupBy("spread", "repeat"))
    return t.groupBy("spread").agg(F.count("*").alias("repeats"), F.count_if(F.col("t") > 2).alias("hits"), F.avg((F.col("t") > 2).cast("double")).alias("hit_rate"), F.avg("t").alias("mean_t"))
