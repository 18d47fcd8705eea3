"""Fits take about as many passes however little their penalties weigh beside the contests."""

import numpy as np
from pyspark.sql import functions as F

from tallyforge.operators import logit as L
from tallyforge.operators import refits as RF


def drawn(spark, n: int):
    """Contests of four of fourteen champions a side and six teams of two careers; some have no teams."""
    dealt = "transform(slice(array_sort(transform(sequence(1L, 14L), x -> struct(xxhash64(id, x) as h, x as x))), 1, 8), s -> s.x)"
    c = spark.range(n).selectExpr("id as match_id", "1 + id % 2 as career_id", f"{dealt} as d", "pmod(xxhash64(id, 'y'), 2) as y", "pmod(xxhash64(id, 't'), 6) as t")
    teams = (F.expr(f"if(match_id % 3 = 0, null, {x})") for x in ("t", "(t + 1 + match_id % 5) % 6"))
    return c.select("match_id", "career_id", "y", F.expr("array_sort(slice(d, 1, 4))").alias("left"), F.expr("array_sort(slice(d, 5, 4))").alias("right"), *(t.alias(n) for t, n in zip(teams, ("left_team", "right_team"), strict=True)))


def test_passes_do_not_grow_as_penalties_shrink(spark, monkeypatch):
    problem = L.packed(drawn(spark, 6000), F.array("y"), F.array(F.lit(0)))
    fits = [L.Fit(m, 0.02, 0.05) for m in L.MODELS]
    monkeypatch.setattr(L, "PASSES", 100)
    thetas = L.solve(problem, fits)
    terms = {k: np.zeros((6000, v)) for k, v in problem.sizes.items()}
    rows = L.signed_terms(drawn(spark, 6000)).join(problem.keys, ["kind", "a", "b", "c"]).select("match_id", "kind", "id", "sign").toPandas()
    for k, part in rows.groupby("kind"):
        np.add.at(terms[k], (part["match_id"], part["id"]), part["sign"])
    y = drawn(spark, 6000).orderBy("match_id").toPandas()["y"].to_numpy()
    for f, theta in zip(fits, thetas, strict=True):
        if len(theta):  # at the minimum, and only there, the gradient is null
            x = np.concatenate([terms[k] for k in L.MODELS[f.model]], 1)
            penalty = np.concatenate([np.full(problem.sizes[k], f.penalty(k)) for k in L.MODELS[f.model]])
            assert np.abs(x.T @ (1 / (1 + np.exp(-x @ theta)) - y) + penalty * theta).max() < 2e-4


def test_columns_that_do_not_cancel_are_told(spark):
    o = drawn(spark, 600)
    assert L._uses(L.packed(o, F.array("y"), F.array(F.lit(0))))[1] == {"champion", "team", "pair", "triple"}
    alone = o.withColumn("left_team", F.expr("if(match_id = 7, null, left_team)"))
    assert L._uses(L.packed(alone, F.array("y"), F.array(F.lit(0))))[1] == {"champion", "pair", "triple"}


def test_terms_and_scores_are_not_broadcast(spark, monkeypatch):
    plans, real = [], L.written

    def keep(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(L, "written", keep)
    o = drawn(spark, 600)
    problem = L.packed(o, F.array("y"), F.array(F.lit(0)))
    fit = [L.Fit("M1", 1.0)]
    scored = L.scores(problem, fit, L.solve(problem, fit)).select("match_id", F.lit(0).alias("replicate"), "p", F.lit(1).alias("y"))
    plans.append(RF.raw_variance(o, scored, 5)._jdf.queryExecution().executedPlan().toString())
    # Only numbered keys, whose count is known by then, and their first numbers are.
    assert not [p for p in plans if "BroadcastExchange HashedRelationBroadcastMode(List(input[0, bigint" in p]
    assert all(p.count("SortMergeJoin") == 1 for p in plans[1:])
