"""Best-position search, the blob ledger and fill-in-the-middle: brute force, SQL and edge cases."""

import hashlib
import math
import random
import re
import uuid
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import common, fim, lexical, queries, secretscan
from tests.llm.test_llm import SCHEMA, by_id, edge, empty


def test_queries_match_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    for name in ("op11_best_position", "op12_blob_ledger", "op13_fill_in_middle"):
        df = queries.queries()[name](spark, sf)
        cur = con.execute(queries.oracle_sql()[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns), name
        got = sorted(tuple(r[c] for c in names) for r in df.collect())
        assert got == sorted(map(tuple, cur.fetchall())), name


# 11 search


def ranked(docs, items, k=10):
    """(query number, rank, doc_id, score) by scoring every document."""
    held = [(i, Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for q, (_, text) in enumerate(items):
        scores = []
        for i, c, length in held:
            m = 25 + (75 * length * n) // total
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in Counter(lexical.terms(text)).items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(q, r + 1, None if missing else i, -s) for r, (s, missing, i) in enumerate(sorted(scores)[:k])]
    return out


def test_search_equals_scoring_everything(spark, monkeypatch):
    """Small blocks and steps, ties by the dozen, copies, repeated terms; several lots give the same ranks as one."""
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6)) % 60}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 12, 40])))) for i in range(400)] + [(1000 + i, "w1 w2 W3 w2") for i in range(90)]
    items = [(q, " ".join(rng.choices(words, k=6)) + " w2 w2") for q in range(25)]
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 64)
    monkeypatch.setattr(lexical, "FIRST_DEPTH", 2)
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = [(items[q][0], r, i, s) for q, r, i, s in ranked(docs, items)]
    assert sorted(tuple(x) for x in lexical.search(d, b).collect()) == sorted(want)
    monkeypatch.setattr(lexical, "LOT_CHARS", 1000)
    assert sorted(tuple(x) for x in lexical.search(d, b).collect()) == sorted(want)


def test_search_stops_before_the_end():
    """With one document far ahead in every list, little more than the first step is read."""
    n = 5000
    term, size = np.arange(2), np.array([n, n])
    doc = np.tile(np.arange(n), 2)
    impact = np.r_[np.arange(n), np.arange(n)].astype(np.int64) + np.where(doc >= n - 10, 10**6, 0)
    best = lexical.Best(10)
    read = lexical.best_positions(lexical.Lists(term, size, doc, impact, n), {0: 3, 1: 2}, best, list(range(n)))
    assert read < 200 and [i for _, i in best.rows] == [*range(n - 1, n - 11, -1)]


def test_search_reads_on_through_ties():
    """An equal score with a smaller id may stand anywhere among equal impacts."""
    n = 300
    doc = np.arange(n)
    best = lexical.Best(10)
    lexical.best_positions(lexical.Lists(np.arange(1), np.array([n]), doc, np.ones(n, np.int64), n), {0: 1}, best, list(range(n, 0, -1)))
    assert [i for _, i in best.rows] == [*range(1, 11)]


def test_search_edges(spark):
    docs = edge(spark).withColumns({"rank": F.lit(1), "query": F.lit(2), "item_id": F.lit(3)})
    items = spark.createDataFrame([(1, "some w1 A"), (1, "some w1 A"), (2, None), (3, ""), (4, "unknown"), (None, "some")], "item_id long, text string")
    out = lexical.search(docs, items).collect()
    want = ranked([(r["doc_id"], r["text"]) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert sorted((r["rank"], r["score"], str(r["doc_id"])) for r in out) == sorted((r, s, str(i)) for _, r, i, s in want)
    assert sum(r["item_id"] == 1 for r in out) == 2 * len([x for x in want if x[0] == 0])
    assert lexical.search(empty(spark), items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0


# 12 secrets


def found(text):
    """(start, kind number, stop) by the re module."""
    spans = []
    for k, r in enumerate(secretscan.RULES):
        spans += [(m.start(), k, m.end()) for m in re.finditer(r.pattern, text or "") if len(m.group(r.group)) >= r.least]
    return sorted(spans)


def written(spans, kinds=secretscan.RULES):
    return ",".join(f"{secretscan.RULES[k].name}:{a}:{b}" for a, k, b in spans if k < len(kinds))


SECRETS = [
    'PassWord: "hunter2hunter2"', "token=api_key: abcdefgh12", "token==abcdefg", "secret = 'short'", "é token = 0123456789abcdef0123456789abcdef", "AKIA" + "Z" * 12, "AKIAAKIA" + "Q" * 8, "AKIA" + "1" * 11,
    "f" * 31 + "g" + "0" * 32, "-----BEGIN RSA PRIVATE KEY-----", "Bearer abcdefghijklmnopqrstuvwxyz", "bearer short", "🙂 apikey:/etc/passwd_file token:\n secret:x", "", None, "Kpassword=kkkkkkkkkk",
]


def test_secret_spans(spark):
    rows = [(k, t) for k, t in enumerate(SECRETS)] + [(100 + k, " ".join(filter(None, random.Random(k).sample(SECRETS, 5)))) for k in range(60)]
    out = by_id(secretscan.report(spark.createDataFrame(rows, "doc_id long, text string")))
    for k, t in rows:
        spans = found(t)
        assert out[k]["spans"] == written(spans), t
        assert out[k]["base_sha256"] == hashlib.sha256(written(spans, secretscan.BASE).encode()).hexdigest()
        assert [out[k][f"n_{r.name}"] for r in secretscan.BASE] == [sum(s[1] == j for s in spans) for j in range(3)]


def test_ledger_scans_each_pair_once(spark):
    ledger = f"{common.shared_dir(spark)}/ledgers/{uuid.uuid4().hex}"
    one = spark.createDataFrame([("a", 1, "token = abcdefgh"), ("b", 1, "token = abcdefgh"), ("c", 1, "plain")], "path string, version int, text string")
    assert secretscan.scan(one, ledger, secretscan.BASE).count() == 2 * 3
    assert secretscan.scan(one, ledger, secretscan.BASE).count() == 0
    two = one.unionByName(spark.createDataFrame([("a", 2, "AKIA" + "X" * 16), ("a", 3, "plain")], one.schema))
    assert {(r["rule"], r["version"]) for r in secretscan.scan(two, ledger, secretscan.BASE).collect()} == {(r.name, 1) for r in secretscan.BASE}
    newer = (secretscan.Rule("assign", 2, secretscan.BASE[0].pattern, 1, 4), *secretscan.BASE[1:], secretscan.Rule("pin", 1, r"pl(ai)n", 1))
    again = secretscan.scan(two, ledger, newer)
    assert again.count() == 3 * 2 and {r["rule"] for r in again.collect()} == {"assign", "pin"}
    got = {(r["path"], r["version"]): [(f["rule"], f["start"], f["stop"]) for f in r["findings"]] for r in secretscan.findings(two, ledger, newer).collect()}
    assert got == {("a", 1): [("assign", 0, 16)], ("b", 1): [("assign", 0, 16)], ("c", 1): [("pin", 0, 5)], ("a", 2): [("access", 0, 20)], ("a", 3): [("pin", 0, 5)]}
    secretscan.read_ledger(spark, ledger).coalesce(1).write.mode("append").parquet(f"{ledger}-twice")  # rows that were appended twice count once
    for _ in range(2):
        secretscan.read_ledger(spark, ledger).write.mode("append").parquet(f"{ledger}-both")
    assert sorted(map(str, secretscan.findings(two, f"{ledger}-both", newer).collect())) == sorted(map(str, secretscan.findings(two, ledger, newer).collect()))


def test_secret_edges(spark):
    docs = edge(spark).withColumns({"blob": F.lit(1), "findings": F.lit("x")})
    ledger = f"{common.shared_dir(spark)}/ledgers/{uuid.uuid4().hex}"
    secretscan.scan(docs, ledger)
    out = secretscan.findings(docs, ledger)
    assert out.columns == [*docs.columns, "findings_"] and out.count() == docs.count()
    assert secretscan.report(docs).count() == docs.count() and secretscan.report(empty(spark)).count() == 0
    many = " ".join(f"token=abcdefgh{i}" for i in range(20000))
    row = secretscan.report(spark.createDataFrame([(1, many)], "doc_id long, text string")).first()
    assert row["n_assign"] == 20000 and row["spans"] == written(found(many))


def test_secret_plan_is_native(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = secretscan.report(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 13 fill in the middle


def test_unit_ends():
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choices("ab\n🙂", k=rng.randint(0, 9)))
        ends, at = [], 0
        for m in re.findall(r"[^\n]*\n|[^\n]+", text):
            ends.append(at := at + len(m))
        assert fim.unit_ends(text).tolist() == ends, text


@pytest.mark.parametrize("piece", [1, 3, 1 << 15])
def test_outputs_restore(spark, monkeypatch, piece):
    """Markers that straddle pieces, texts that end like the start of a marker, multi-byte text, plain texts."""
    monkeypatch.setattr(fim, "PIECE", piece)
    rng = random.Random(piece)
    rows = [(i, "".join(rng.choices(["a", "\n", "<", "<S", "P>", "é", "🙂", "<M", ">"], k=rng.randint(0, 14)))) for i in range(150)] + [(500, "x<P>y"), (501, ""), (502, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {r["doc_id"]: (r["form"], r["output"]) for r in fim.outputs(df).collect()}
    got = by_id(fim.digests(df))
    for i, t in rows:
        form, output = texts[i]
        assert fim.restored(output, form) == (t or "")
        assert got[i]["output_sha256"] == hashlib.sha256(output.encode()).hexdigest() and got[i]["restored_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        assert (form == "plain") == (not t or any(m in t for m in ("<P>", "<S>", "<M>"))) == (got[i]["prefix_chars"] is None)


def test_rates(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    forms = Counter(r["form"] for r in fim.digests(docs, fim.Settings(rate=40, spm=100)).collect())
    assert set(forms) == {"plain", "spm"} and 0.2 < forms["spm"] / sum(forms.values()) < 0.6


def test_middle_edges(spark):
    docs = edge(spark).withColumns({"n": F.lit(1), "form": F.lit("x"), "piece": F.lit(1)})
    out = fim.digests(docs).collect()
    assert sorted((str(r["doc_id"]), r["restored_sha256"]) for r in out) == sorted((str(r["doc_id"]), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in docs.collect())
    assert fim.digests(empty(spark)).count() == 0
    same = fim.digests(spark.createDataFrame([(7, "a\nb\nc")] * 5, "doc_id long, text string")).collect()
    assert len(same) == 5 and len(set(same)) == 1
