"""Many ridge logistic fits at once against dense Newton steps, and the refitted experiments with planted effects and with none."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import logit as L
from tallyforge.operators import refits as RF
from tallyforge.plans.experiments import oriented

SCHEMA = "career_id int, match_id long, left array<long>, right array<long>, left_team int, right_team int, y int"


def contests(n, ids, chance, seed=3):
    """(career, match, left, right, teams, y) with the chance of the left side by its champions; every sixth contest has no teams."""
    rng = np.random.default_rng(seed)
    rows = []
    for m in range(n):
        c = [int(x) for x in rng.permutation(ids)[:8]]
        teams = (None, None) if m % 6 == 0 else tuple(int(x) for x in rng.permutation(5)[:2])
        rows.append((m % 2, m, c[:4], c[4:], *teams, int(rng.random() < chance(c[:4], c[4:]))))
    return rows


def dense(rows, kinds):
    """(design, keys) as a plain matrix."""
    keys, cells = {}, []
    for i, (career, _, left, right, lt, rt, _) in enumerate(rows):
        terms = []
        for side, sign in ((left, 1), (right, -1)):
            terms += [(("champion", x), sign) for x in side]
            terms += [(("pair", *p), sign) for p in combinations(sorted(side), 2)] + [(("triple", *p), sign) for p in combinations(sorted(side), 3)]
        terms += [(("team", career, t), sign) for t, sign in ((lt, 1), (rt, -1)) if t is not None]
        terms += [(("counter", min(a, b), max(a, b)), 1 if a < b else -1) for a in left for b in right]
        cells += [(i, keys.setdefault(k, len(keys)), s) for k, s in terms if k[0] in kinds]
    x = np.zeros((len(rows), len(keys)))
    for i, j, s in cells:
        x[i, j] += s
    return x, list(keys)


def newton(x, y, penalty):
    theta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ theta))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty), x.T @ (y - p) - penalty * theta)
        theta += step
    return theta


def key_of(r):
    return {"champion": lambda: ("champion", r["a"]), "team": lambda: ("team", r["a"], r["b"]), "triple": lambda: ("triple", r["a"], r["b"], r["c"])}.get(r["kind"], lambda: (r["kind"], r["a"], r["b"]))()


@pytest.fixture(scope="module")
def plain():
    strength = {}

    def chance(left, right):
        s = lambda c: strength.setdefault(c, (c * 37 % 11 - 5) / 6)
        return 1 / (1 + np.exp(-sum(map(s, left)) + sum(map(s, right))))

    return contests(160, np.array([*range(1, 10), 1 << 20, (1 << 20) + 1, 1 << 40]), chance)


@pytest.mark.parametrize("model", ["M2", "M6"])
def test_coefficients_equal_dense_newton(spark, plain, monkeypatch, model):
    """Ids above 2 ** 20 are told apart; blocks and lots of fits are cut small."""
    monkeypatch.setattr(L, "CONTESTS_PER_BLOCK", 50)
    o = spark.createDataFrame(plain, SCHEMA)
    problem = L.packed(o, F.array("y"), F.array(F.lit(0)))
    monkeypatch.setattr(L, "LOT", problem.columns(model) + 1)
    fits = [L.Fit(model, 4.0, 16.0), L.Fit(model, 1.0, 64.0)]
    x, keys = dense(plain, L.MODELS[model])
    for f, theta in zip(fits, L.solve(problem, fits), strict=True):
        want = dict(zip(keys, newton(x, np.array([r[-1] for r in plain]), np.array([f.penalty(k[0]) for k in keys])), strict=True))
        got = {key_of(r): r["theta"] for r in L.coefficients(problem, model, theta).collect()}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-5


def test_too_many_coefficients_are_refused(spark, plain, monkeypatch):
    problem = L.packed(spark.createDataFrame(plain, SCHEMA), F.array("y"), F.array(F.lit(0)))
    monkeypatch.setattr(L, "LOT", 10)
    with pytest.raises(ValueError, match="coefficients"):
        L.solve(problem, [L.Fit("M6", 1.0, 1.0)])


def test_cross_validation_equals_loops(spark, plain):
    """Scores, chosen penalties and paired comparisons by a plain loop over settings and folds; what training did not see is dropped."""
    o = spark.createDataFrame(plain, SCHEMA)
    fold = F.pmod(F.col("match_id") * 7, F.lit(3)).cast("int")
    held = L.cross_validated(o, fold, 3, [1.0, 16.0], [4.0, 64.0], ("M0", "M1", "M2", "M3", "M4", "M5", "M6")).cache()
    y, folds = np.array([r[-1] for r in plain]), np.array([r[1] * 7 % 3 for r in plain])
    ll, hits, best = {}, {}, {}
    for model, kinds in L.MODELS.items():
        x, keys = dense(plain, kinds)
        for lb in [1.0, 16.0] if kinds else [0.0]:
            for le in [4.0, 64.0] if set(kinds) - {"champion", "team"} else [0.0]:
                eta = np.zeros(len(y))
                for f in range(3) if kinds else []:
                    t = folds != f
                    seen = (x[t] != 0).any(0)
                    penalty = np.array([lb if k[0] in ("champion", "team") else le for k in keys])[seen]
                    eta[~t] = x[~t][:, seen] @ newton(x[t][:, seen], y[t], penalty)
                p = 1 / (1 + np.exp(-eta))
                ll[model, lb, le], hits[model, lb, le] = np.log(np.where(y == 1, p, 1 - p)), ((eta > 0) == (y == 1)).mean()
                if model not in best or ll[model, lb, le].mean() > ll[best[model]].mean():
                    best[model] = (model, lb, le)
    got = L.settings(held).collect()
    assert len(got) == len(ll)
    for r in got:
        k = (r["model"], r["base"], r["extra"])
        assert abs(r["log_likelihood"] - ll[k].mean()) < 1e-6 and r["chosen"] == (best[k[0]] == k) and r["contests"] == len(y)
        assert r["accuracy"] is None if k[0] == "M0" else abs(r["accuracy"] - hits[k]) < 1e-9
    for r in L.compared(held).collect():
        d = ll[best[r["full"]]] - ll[best[r["base"]]]
        se = d.std(ddof=1) / len(d) ** 0.5
        assert abs(r["gain"] - d.mean()) < 1e-6 and abs(r["se"] - se) < 1e-6 and abs(r["t"] - d.mean() / se) < 1e-2
        assert r["verdict"] == ("real" if r["t"] > 2 else "none" if r["t"] > -2 else "harmful")


def test_raw_variance_equals_loops(spark, plain):
    rng = np.random.default_rng(1)
    p = rng.uniform(0.2, 0.8, len(plain))
    o = spark.createDataFrame(plain, SCHEMA)
    chances = spark.createDataFrame([(r[1], 0, float(q), r[-1]) for r, q in zip(plain, p, strict=True)], "match_id long, replicate int, p double, y int")
    got = {r["measure"]: (r["groups"], r["raw"]) for r in RF.raw_variance(o, chances, 4).collect()}
    for measure, size in (("pair", 2), ("triple", 3), ("counter", 0)):
        stats = {}
        for (_, _, left, right, _, _, y), q in zip(plain, p, strict=True):
            if size:
                keys = [(c, q, y) for c in combinations(sorted(left), size)] + [(c, 1 - q, 1 - y) for c in combinations(sorted(right), size)]
            else:
                keys = [k for a in left for b in right for k in (((a, b), q, y), ((b, a), 1 - q, 1 - y))]
            for k, c, won in keys:
                stats.setdefault(k, []).append((c, won))
        picked = [np.array(v) for v in stats.values() if len(v) >= 4]
        if len(picked) < 2:
            assert measure not in got
            continue
        raw = np.var([v[:, 1].mean() - v[:, 0].mean() for v in picked]) - np.mean([(v[:, 0] * (1 - v[:, 0])).sum() / len(v) ** 2 for v in picked])
        assert got[measure][0] == len(picked) and abs(got[measure][1] - raw) < 1e-9


def test_bootstrap_tells_planted_pairs_from_none(spark):
    pair = lambda side: sum(((a * 31 + b * 17) % 7 - 3) * 0.6 for a, b in combinations(sorted(side), 2))
    planted = contests(700, np.arange(1, 11), lambda a, b: 1 / (1 + np.exp(pair(b) - pair(a))))
    none = contests(700, np.arange(1, 11), lambda a, b: 0.5)
    got = {k: {r["measure"]: r for r in RF.bootstrap(spark.createDataFrame(rows, SCHEMA), "M2", 19, 5, 7).collect()} for k, rows in (("planted", planted), ("none", none))}
    assert got["planted"]["pair"]["p_value"] == 1 / 20 and got["planted"]["pair"]["corrected"] > 0
    assert got["none"]["pair"]["p_value"] > 1 / 20 and got["none"]["pair"]["corrected"] < got["planted"]["pair"]["corrected"] / 4
    for r in got["planted"].values():
        assert r["replicates"] == 19 and abs(r["corrected"] - (r["seen"] - r["floor"])) < 1e-12


def test_power_rises_with_the_effect(spark):
    rows = contests(900, np.arange(1, 11), lambda a, b: 0.5)
    got = {r["spread"]: r for r in RF.power(spark.createDataFrame(rows, SCHEMA), [0.0, 0.4, 1.0], 6, 3, 5).collect()}
    assert got[0.0]["hit_rate"] <= 0.2 and got[1.0]["hit_rate"] >= 0.8
    assert got[0.0]["mean_t"] < got[0.4]["mean_t"] < got[1.0]["mean_t"] and all(r["repeats"] == 6 for r in got.values())


def test_signed_terms_of_real_contests(spark, sf):
    """Signs of a block cancel within a contest, but for counters; numbering is dense within a kind."""
    o = oriented(spark, sf)
    terms = L.signed_terms(o)
    net = terms.where("kind <> 'counter'").groupBy("match_id", "kind").agg(F.sum("sign").alias("s"), F.count("*").alias("n")).collect()
    assert all(r["s"] == 0 and r["n"] == {"champion": 8, "team": 2, "pair": 12, "triple": 8}[r["kind"]] for r in net)
    keys, sizes = L.numbered(terms)
    for kind, ids in keys.groupBy("kind").agg(F.sort_array(F.collect_list("id"))).collect():
        assert ids == [*range(sizes[kind])]
