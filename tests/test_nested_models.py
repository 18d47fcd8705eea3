"""Held-out errors of the nested least-squares models, margins and in-sample likelihoods against dense solves."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import estimates as O
from tallyforge.operators import experiments as X
from tallyforge.operators import logit as L
from tallyforge.plans import experiments as P
from tallyforge.plans import inputs as I
from tallyforge.plans import registry
from tests.test_holdout import dense, newton

MODELS = {
    "j8_output_models": {"P0": (), "P1": ("TEAM",), "P2": ("TEAM", "FOE"), "P3": ("TEAM", "MATE"), "P4": ("TEAM", "MATE", "FOE")},
    "j9_role_ladder": {"R0": (), "R1": ("TEAM",), "R2": ("TEAM", "MATE_ROLE", "FOE_ROLE"), "R3": ("TEAM", "MATE_ROLE", "FOE_ROLE", "MATE"), "R4": ("TEAM", "MATE_ROLE", "FOE_ROLE", "MATE", "FOE")},
}


def held_out(x, y, w, fold, penalty):
    """Squared error of every fold under a fit to the others; columns that training has not seen do not count."""
    sse = 0.0
    for f in set(fold):
        t = fold != f
        theta = np.linalg.solve(x[t].T @ (x[t] * w[t][:, None]) + np.diag(penalty), x[t].T @ (w[t] * y[t])) if x.shape[1] else np.zeros(0)
        sse += (w[~t] * (y[~t] - x[~t] @ theta) ** 2).sum()
    return sse


@pytest.mark.parametrize("name", sorted(MODELS))
def test_output_models_equal_dense_solves(spark, sf, name):
    z = O.standardised(O.unpivoted(O.observations(I.weighted(spark, sf))))
    rows = z.select("career_id", "metric", "w", "z", (X.draw("match_id", P.SEED) % 4).alias("fold"), F.transform(O.features(z), lambda f: F.concat_ws(":", f["kind"], f["subject"], f["other"])).alias("f")).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r["career_id"], r["metric"]].append(r)
    got = {(r["career_id"], r["metric"], r["model"]): r["sse"] for r in registry.queries()[name](spark, sf).collect()}
    for (career, metric), part in groups.items():
        y, w, fold = (np.array([r[c] for r in part], float) for c in ("z", "w", "fold"))
        for model, kinds in MODELS[name].items():
            names = sorted({f for r in part for f in r["f"] if f.split(":")[0] in kinds})
            at = {f: k for k, f in enumerate(names)}
            x = np.zeros((len(part), len(names)))
            for i, r in enumerate(part):
                for f in r["f"]:
                    if f in at:
                        x[i, at[f]] += 1
            want = held_out(x, y, w, fold, [P.PENALTIES[f.split(":")[0]] for f in names])
            assert got.pop((career, metric, model)) == pytest.approx(want, rel=1e-7, abs=1e-9)
    assert not got


def test_margins_equal_dense_solves(spark, sf):
    o = P.oriented(spark, sf).select("career_id", "left", "right", "margin", (X.draw("match_id", P.SEED) % 5).alias("fold")).collect()
    got = {r["career_id"]: r for r in registry.queries()["j7_margin"](spark, sf).collect()}
    assert set(got) == {r["career_id"] for r in o}
    for career, r in got.items():
        part = [x for x in o if x["career_id"] == career]
        ids = sorted({c for x in part for c in [*x["left"], *x["right"]]})
        x = np.array([[(c in p["left"]) - (c in p["right"]) for c in ids] for p in part], float)
        y, fold = np.array([p["margin"] for p in part], float), np.array([p["fold"] for p in part])
        sse = held_out(x, y, np.ones(len(y)), fold, [16.0] * len(ids))
        assert r["rmse"] == pytest.approx((sse / len(y)) ** 0.5) and r["r2"] == pytest.approx(1 - sse / (y**2).sum())


def test_likelihood_equals_newton(spark, sf):
    o = P.oriented(spark, sf).select("career_id", "match_id", "left", "right", "left_team", "right_team", "y").collect()
    x, keys = dense([tuple(r) for r in o], L.MODELS["M2"])
    y = np.array([r["y"] for r in o])
    eta = x @ newton(x, y, np.full(len(keys), 16.0))
    p = 1 / (1 + np.exp(-eta))
    ll, hit = np.log(np.where(y == 1, p, 1 - p)), (eta > 0) == (y == 1)
    for r in registry.queries()["j4_log_likelihood"](spark, sf).collect():
        own = np.array([x["career_id"] == r["career_id"] for x in o])
        assert r["contests"] == own.sum() and abs(r["log_likelihood"] - ll[own].mean()) < 1e-6 and abs(r["accuracy"] - hit[own].mean()) < 1e-9


def test_output_sums_are_formed_without_a_row_for_a_pair_of_features(spark, sf):
    """Every observation has fifteen features, which were 136 rows a metric before the first sum."""
    plan = P._outputs(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "explode(_x" not in plan
