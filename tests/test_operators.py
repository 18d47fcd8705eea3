"""Literal values, planted effects and rules of the contest operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import estimates as E
from tallyforge.operators import claims as C
from tallyforge.operators import estimates as O
from tallyforge.operators import normalize as N
from tallyforge.operators import quality as Q
from tallyforge.operators import season as S
from tallyforge.operators import serving as V
from tallyforge.plans import inputs as I
from tallyforge.plans import registry
from tallyforge.sources import ledger as L
from tallyforge.streaming import ingest


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_shrinkage_and_size(spark):
    assert value(spark, E.shrink(F.lit(24.0), F.lit(24.0), 0.5, 24)) == 0.75
    assert value(spark, E.effective_size(F.lit(3.5), F.lit(5.25))) == pytest.approx(2.3333, abs=1e-4)
    assert value(spark, E.effective_size(F.lit(0.0), F.lit(0.0))) == 0
    with pytest.raises(Exception, match="not a tally"):
        value(spark, E.shrink(F.lit(3.0), F.lit(2.0), 0.5, 24))


def test_decay(spark):
    c = E.CONFIG | {"self_decay_half_life": 2.0, "meta_decay_half_life": 12.0}
    assert value(spark, E.decay(F.lit(2), F.lit(12), c)) == 0.25
    with pytest.raises(Exception, match="negative"):
        value(spark, E.decay(F.lit(-1), F.lit(0), c))


def test_config():
    assert E.validated(E.CONFIG | {"other": 1.0}) == E.CONFIG
    for bad in ({"min_sample": 0.0}, {"synergy_max_size": 4.0}, {"self_decay_half_life": 0.0}, {"prior_strength_k0": -1.0}):
        with pytest.raises(ValueError):
            E.validated(E.CONFIG | bad)
    with pytest.raises(ValueError):
        E.validated({"min_sample": 1.0})


def test_strengths_recover_order():
    rng = np.random.default_rng(5)
    true = np.exp(rng.normal(0, 0.35, 40))
    won = np.zeros((40, 40))
    for _ in range(19200):
        a, b = rng.choice(40, 2, replace=False)
        w, l = (a, b) if rng.random() < true[a] / (true[a] + true[b]) else (b, a)
        won[w, l] += 1
    s = O.strengths_of(np.arange(40), won.sum(1), won + won.T)
    rank = lambda x: np.argsort(np.argsort(x))
    assert np.corrcoef(rank(s), rank(true))[0, 1] > 0.7
    assert np.exp(np.log(s).mean()) == pytest.approx(1)


def test_planted_pair_effect(spark):
    """Champion 1 deals half a deviation more beside champion 2, at the scale of 600 contests."""
    rng = np.random.default_rng(9)
    rows = []
    for m in range(600):
        ids = rng.choice(16, 8, replace=False) + 1
        for pos, c in enumerate(ids):
            side = ids[:4] if pos < 4 else ids[4:]
            up = 1.0 if c == 1 and 2 in side else 0.0
            rows.append((1, m, "BLUE" if pos < 4 else "RED", int(pos % 4 + 1), int(c), int((c - 1) // 8), int(pos // 4 + 1), 1.0, "OFFICIAL", *(float(100 + rng.normal(0, 20) + (20 * up if k == 0 else 0)) for k in range(6))))
    f = spark.createDataFrame(rows, "career_id int, match_id long, side string, pick_order int, champion_id long, role int, team_id long, w double, match_type string, dealing double, tanking double, healing double, kills double, deaths double, assists double")
    e = {(r["metric"], r["side"], r["subject"], r["other"]): r["effect"] for r in O.pair_effects(f).collect()}
    assert 0.5 <= e["dealing", "ALLY", 1, 2] <= 1.2
    assert abs(e["dealing", "ALLY", 2, 1]) < 0.35
    assert abs(e["deaths", "ALLY", 1, 2]) < 0.35


def test_deck_rules(spark, sf):
    counters = spark.createDataFrame([(1, c, 30 + c, 5 + c, 0.3) for c in range(1, 7)], "career_id int, champion_id long, target long, observations long, effect double")
    pool = spark.createDataFrame([(1, c, c % 5, c) for c in range(1, 41)], "career_id int, champion_id long, role int, games long")
    free = spark.createDataFrame([(1, a, b) for a in range(1, 41) for b in range(a + 1, 41)], "career_id int, a long, b long")
    d = [r.asDict() for r in V.decks(counters, pool, free).collect()]
    assert d == [r.asDict() for r in V.decks(counters, pool, free).collect()]
    assert len({r["champion_id"] for r in d}) == len(d)
    for k in {r["deck"] for r in d}:
        deck = [r for r in d if r["deck"] == k]
        assert len(deck) == 4 and len({r["champion_id"] % 5 for r in deck}) >= 2


def test_no_future_in_standings(spark):
    m = spark.createDataFrame([(1, 1, 2024, 1, 1, 2, 2, 0, 9, 3, 3, 1.0), (2, 1, 2024, 1, 3, 4, 2, 1, 5, 4, 3, 1.0), (3, 1, 2024, 2, 1, 3, 0, 2, 2, 8, 3, 1.0), (4, 1, 2024, 3, 2, 4, 0, 0, 0, 0, 3, 0.0)], "schedule_id long, competition_id int, season int, day int, blue_team_id long, red_team_id long, blue_score long, red_score long, blue_kill long, red_kill long, need_win int, progress double")
    b = {r["schedule_id"]: r for r in S.before(S.winner(m)).collect()}
    assert b[1]["blue_rank"] is None and b[3]["blue_rank"] == 1 and b[3]["red_rank"] == 2
    st = {(r["schedule_id"], r["team_id"]): r["streak"] for r in S.streaks(m).collect()}
    assert st[3, 1] == 1 and st[4, 2] == -1 and st[1, 1] == 0
    assert {r["schedule_id"]: r["remaining"] for r in S.remaining(m).collect()} == {1: 1, 2: 1, 3: 1, 4: 0}


def test_null_safe_keys_and_upsert(spark):
    a = spark.createDataFrame([(None, 1, 1), (2, 2, 1)], "k int, v int, run int")
    b = spark.createDataFrame([(None, 9, 2), (3, 3, 2)], "k int, v int, run int")
    assert {(r["k"], r["v"]) for r in L.upsert(a, b, ["k"], "run").collect()} == {(None, 9), (2, 2), (3, 3)}
    assert {r["k"] for r in N.new_only(b, a, ["k"]).collect()} == {3}


def test_files_and_ledger(spark, tmp_path):
    for name, text in (("slot_1.json", "{}"), ("slot_2.json", "{} "), ("backup_slot_1.json", "{}"), ("slot_3.txt", "{}")):
        (tmp_path / name).write_text(text)
    h = L.file_hashes(spark, str(tmp_path))
    assert {r["file"] for r in h.collect()} == {"slot_1.json", "slot_2.json"}
    sha = {r["file"]: r["sha"] for r in h.collect()}
    ledger = spark.createDataFrame([("slot_1.json", sha["slot_1.json"], None), ("slot_2.json", sha["slot_2.json"], "broken")], "file string, sha string, error string")
    assert [r["file"] for r in L.to_ingest(h, ledger).collect()] == ["slot_2.json"]
    assert L.to_ingest(h, ledger, force=True).count() == 2
    records = L.read_records(spark, str(tmp_path), spark.createDataFrame([], "a int").schema)
    assert {r["file"] for r in records.collect()} == {"slot_1.json", "slot_2.json"}


def test_ridge_equals_dense_solution(spark, sf):
    """Coefficients of every metric and career against one dense solve over the observations."""
    o = O.observations(I.weighted(spark, sf))
    z = O.standardised(O.unpivoted(o))
    rows = z.select("career_id", "metric", "w", "z", F.transform(O.features(z), lambda f: F.concat_ws(":", f["kind"], f["subject"], f["other"])).alias("f")).collect()
    got = {(r["career_id"], r["metric"], r["feature"]): r["theta"] for r in O.ridge(o).collect()}
    groups = {}
    for r in rows:
        groups.setdefault((r["career_id"], r["metric"]), []).append(r)
    seen = 0
    for (career, metric), part in groups.items():
        names = sorted({f for r in part for f in r["f"]})
        at = {f: i for i, f in enumerate(names)}
        x = np.zeros((len(part), len(names)))
        for i, r in enumerate(part):
            for f in r["f"]:
                x[i, at[f]] += 1
        w, y = np.array([r["w"] for r in part]), np.array([r["z"] for r in part])
        penalty = np.diag([O.RIDGE_TEAM if f.startswith("TEAM") else O.RIDGE_OTHER for f in names])
        theta = np.linalg.solve(x.T @ (x * w[:, None]) + penalty, x.T @ (w * y))
        assert all(abs(got[career, metric, f] - v) < 1e-9 for f, v in zip(names, theta, strict=True))
        seen += len(names)
    assert seen == len(got) > 0


def test_large_ids_stay_apart(spark):
    """Terms of different champions and teams, with ids above 2 ** 20 and 2 ** 40, keep a coefficient each; what does not fit is an error."""
    rng = np.random.default_rng(2)
    ids = [1, 2, 1 << 20, (1 << 20) + 1, 3 << 21, 1 << 41, (1 << 41) + 5, 77, 78, 79]
    rows = []
    for m in range(300):
        c = rng.permutation(len(ids))[:8]
        for k, x in enumerate(c):
            v = [float(rng.normal() + (5 if ids[x] == 1 << 20 and 5 in c[:4] and k < 4 else 0)) for _ in range(6)]
            rows.append((1, m, "OFFICIAL", "BLUE" if k < 4 else "RED", k % 4 + 1, ids[x], int(x) % 3, (1 << 33) + m % 4 if k < 4 else 7 + m % 3, 1.0, *v))
    schema = "career_id int, match_id long, match_type string, side string, pick_order int, champion_id long, role int, team_id long, w double, " + ", ".join(f"{x} double" for x in O.METRICS)
    o = O.observations(spark.createDataFrame(rows, schema))
    z = O.standardised(O.unpivoted(o)).where("metric = 'dealing'")
    part = z.select("w", "z", F.transform(O.features(z), lambda f: F.concat_ws(":", f["kind"], f["subject"], f["other"])).alias("f")).collect()
    got = {r["feature"]: r["theta"] for r in O.ridge(o).where("metric = 'dealing'").collect()}
    names = sorted({f for r in part for f in r["f"]})
    assert got.keys() == set(names) and f"MATE:{1 << 20}:{1 << 41}" in got
    x = np.array([[r["f"].count(f) for f in names] for r in part], float)
    w, y = np.array([r["w"] for r in part]), np.array([r["z"] for r in part])
    theta = np.linalg.solve(x.T @ (x * w[:, None]) + np.diag([O.RIDGE_TEAM if f.startswith("TEAM") else O.RIDGE_OTHER for f in names]), x.T @ (w * y))
    assert max(abs(got[f] - t) for f, t in zip(names, theta, strict=True)) < 1e-9
    with pytest.raises(Exception, match="more than 60 bits"):
        O.ridge(o.withColumn("team_id", F.lit(1 << 60))).collect()


def test_unexplored_pairs_of_any_catalogue(spark):
    c = spark.createDataFrame([(1, 5), (1, 1 << 40), (1, 60), (2, 9)], "career_id int, champion_id long")
    none = spark.createDataFrame([(1, 5, 60)], "career_id int, a long, b long")
    assert {tuple(r) for r in V.unexplored(c, none, none.limit(0)).collect()} == {(1, 5, 1 << 40), (1, 60, 1 << 40)}


def test_runs_are_all_or_nothing(spark, tmp_path):
    one = spark.range(3)
    L.record_run(str(tmp_path), 1, {"a": one, "b": one.where("id > 0")}, {"k0": 8.0})
    one.write.parquet(f"{tmp_path}/runs/2/a")  # broke off before its ledger rows
    assert {(r["run_id"], r["name"], r["rows"]) for r in spark.read.parquet(f"{tmp_path}/ledger").collect()} == {(1, "a", 3), (1, "b", 2)}
    assert L.run_table(spark, str(tmp_path), "b").count() == 2
    with pytest.raises(ValueError):
        L.run_table(spark, str(tmp_path), "a", run_id=2)
    with pytest.raises(ValueError, match="a has 3 rows"):
        Q.require(Q.row_counts({"a": one}, {"a": 4}))


def test_stream_restart_loads_once(spark, tmp_path):
    src, out, state = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    rows = spark.createDataFrame([(1, 5), (2, 6), (2, 6)], "k int, v int")
    rows.coalesce(1).write.parquet(str(src))
    for _ in range(2):
        ingest.catch_up(spark, str(src), rows.schema, out, state, ["k"])
    rows.unionByName(spark.createDataFrame([(3, 7)], "k int, v int")).coalesce(1).write.mode("append").parquet(str(src))
    ingest.catch_up(spark, str(src), rows.schema, out, state, ["k"])
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_text_helpers(spark):
    t = F.lit("won 11 726 and 3-1, line 5/2/10, 99999999999")
    assert value(spark, C.numbers(t)) == [11726, 3, 1, 5, 2, 10, 2147483647]
    assert value(spark, C.score_lines(t)) == ["1:3"] and value(spark, C.kda_lines(t)) == ["5/2/10"]
    d = spark.createDataFrame([('x [{"author":"a","content":"b}"},{"author":"c","con',), ("no array",), ('[{"author":"a"}] tail ]',), (None,)], "raw string")
    got = [r["items"] for r in C.lenient_array(d, "raw", "array<struct<author:string,content:string>>").collect()]
    assert [x and [(y["author"], y["content"]) for y in x] for x in got] == [[("a", "b}")], None, [("a", None)], None]


def test_invariants(spark, sf):
    f = I.facts(spark, sf)
    assert f.where("is_winner").count() * 2 == f.count()
    t = I.tiers(spark, sf).where("include_scrim").groupBy("career_id").agg(F.sum("pick_rate").alias("p")).collect()
    assert all(abs(r["p"] - 8) < 0.01 for r in t)
    assert N.unknown_entities(f, f.select("champion_id")).count() == 0


@pytest.mark.parametrize("name", ["j8_output_models", "j9_role_ladder"])
def test_output_models_cover_all_careers_and_metrics(spark, sf, name):
    z = O.standardised(O.unpivoted(O.observations(I.weighted(spark, sf))))
    want = {(r["career_id"], r["metric"]): r for r in z.groupBy("career_id", "metric").agg(F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("z") * F.col("z")).alias("sse")).collect()}
    assert len(want) == 12
    out = registry.queries()[name](spark, sf).collect()
    assert len(out) == 5 * len(want)
    for r in out:
        w = want[r["career_id"], r["metric"]]
        assert r["weight"] == pytest.approx(w["weight"])
        if r["model"] in ("P0", "R0"):
            assert r["sse"] == pytest.approx(w["sse"])
