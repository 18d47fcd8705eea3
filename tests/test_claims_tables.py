"""Mentions by a dictionary table, two-level parsing of answers, manifests, exact elements and random windows, against plain loops."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import claims as C
from tallyforge.operators import experiments as X
from tallyforge.operators import quality as Q


def says(text, name):
    """A name counts where no letter or digit below U+1100 stands next to it."""
    word = lambda c: c.isalnum() and ord(c) < 0x1100 and (c.isascii() or c in "ªµº" or "À" <= c <= "ჿ" and c not in "×÷")
    at = text.find(name)
    while at >= 0:
        if not (at and word(text[at - 1])) and not (at + len(name) < len(text) and word(text[at + len(name)])):
            return True
        at = text.find(name, at + 1)
    return False


NAMES = [(1, "Ana"), (1, "Queen Ana"), (2, "Monk"), (3, "Monkey"), (4, "a.b*"), (5, "바드"), (5, "Bard"), (6, "!?"), (7, "St. Ana's"), (8, "é"), (9, ""), (9, None), (10, "Lee-Sin"), (11, "가 나"), (12, "x-"), (3, "Monkey King")]


def test_mentions_equal_scans(spark):
    rng = random.Random(4)
    parts = [n for _, n in NAMES if n] + [" ", ".", "-", "가", "s", "é", "Queen", " ", " ", "\n", "!"]
    texts = [(i, "".join(rng.choices(parts, k=rng.randint(0, 9)))) for i in range(400)] + [(900, None), (901, "Monk"), (901, "Monkey"), (902, "Ana가 왔다, 바드가")]
    got = {tuple(r) for r in C.mentioned(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(NAMES, "entity int, name string"), ["id"]).collect()}
    assert got == {(i, e) for i, t in texts for e, n in NAMES if n and t and says(t, n)}


def test_large_dictionary(spark):
    """Thousands of names, of one to three words; none of them is a pattern."""
    names = [(k, f"n{k}") for k in range(4000)] + [(k, f"n{k} n{k + 1} n{k + 2}") for k in range(5000, 7000)]
    texts = [(i, f"n{i} (n{i * 3}) n{5000 + i} n{5001 + i} n{5002 + i}") for i in range(300)]
    got = {tuple(r) for r in C.mentioned(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(names, "entity int, name string"), ["id"]).collect()}
    assert got == {(i, e) for i in range(300) for e in (i, i * 3, 5000 + i)}
    none = spark.createDataFrame([], "entity int, name string")
    assert C.mentioned(spark.createDataFrame(texts, "id int, text string"), none, ["id"]).count() == 0


def test_relations(spark):
    names = spark.createDataFrame([(1, "first", "Ana"), (1, "first", "Anna"), (2, "first", "Bob"), (10, "second", "Monk"), (11, "second", "Bard")], "entity int, kind string, name string")
    pairs = spark.createDataFrame([(1, 10), (2, 11)], "first int, second int")
    texts = spark.createDataFrame([(1, "Ana took Monk. Anna and Ana took Bard! Bob took Bard"), (2, "Ana and Bob took Monk. Ana rested. Monk."), (3, "nobody")], "id int, text string")
    assert {tuple(r) for r in C.related(texts, names, pairs, ["id"]).collect()} == {(1, 1, 0), (2, 0, 1)}


# answers


def comment(text, *replies):
    return {"author": "a", "content": text, "sub_comments": [{"author": "b", "content": r} for r in replies]}


def flat(tree, replies, limit):
    out = []
    for c in tree or []:
        if not (c.get("content") or "").strip() or (limit and len(out) >= limit):
            continue
        parent, added = len(out) + 1, 0
        out.append((c["content"].strip(), None))
        for r in c.get("sub_comments") or []:
            if (r.get("content") or "").strip() and added < replies and not (limit and len(out) >= limit):
                out.append((r["content"].strip(), parent))
                added += 1
    return out


def test_posts(spark):
    rng = random.Random(8)
    tree = lambda n: [comment(rng.choice(["", " ", "text", "more text"]), *(rng.choice(["", "r"]) + str(k) * rng.randint(0, 1) for k in range(rng.randint(0, 12)))) for _ in range(n)]
    post = lambda **x: {"title": "t", "content": "c", "kind": "fun", "comments": tree(rng.randint(0, 30))} | x
    posts = {1: [post(), post(title=" "), post(content=None), post(kind=" dAta "), post(kind="odd"), post(kind=None, likes="31"), post(comments=None, is_concept=True)], 2: [post(), post()], 3: []}
    raw = [(k, "Sure! " + json.dumps(v) + " bye") for k, v in posts.items()] + [(4, "no"), (5, None), (6, "x " + json.dumps([post(title="whole"), post(title="cut")])[:-9])]
    quota = spark.createDataFrame([(k, kind, n) for k in range(1, 7) for kind, n in (("DATA", 3), ("FUN", 3), ("DAILY", 1))], "id int, kind string, amount int")
    got = C.parsed_posts(spark.createDataFrame(raw, "id int, raw string"), "raw", quota, ["id"], ("FUN", "DATA", "DAILY")).collect()
    rows = sorted((r["id"], r["ordinal"], r["kind"], r["title"], r["concept"]) for r in got)
    assert rows == [(1, 1, "FUN", "t", False), (1, 2, "DATA", "t", False), (1, 3, "FUN", "t", False), (1, 4, "FUN", "t", True), (1, 5, "FUN", "t", True), (2, 1, "FUN", "t", False), (2, 2, "FUN", "t", False), (6, 1, "FUN", "whole", False)]
    kept = [p for p in posts[1] if (p["title"] or "").strip() and (p["content"] or "").strip()] + posts[2]
    for p, r in zip(kept, sorted((r for r in got if r["id"] < 3), key=lambda r: (r["id"], r["ordinal"])), strict=True):
        assert [(c["content"], c["parent"]) for c in r["comments"]] == flat(p["comments"], 7, 40)
    assert max(len(r["comments"]) for r in got) == 40


def test_comments(spark):
    tree = [comment("one", "a", "b", "", "c", "d"), comment(" ", "lost"), comment("two")]
    raw = [(1, json.dumps(tree)), (2, '- first\n\n 2) "second"\r\n• " third "\n"\n7.\nplain'), (3, None), (4, "  "), (5, json.dumps([comment("")])), (6, "[broken")]
    got = {r["id"]: [(c["author"], c["content"], c["parent"]) for c in r["comments"]] for r in C.parsed_comments(spark.createDataFrame(raw, "id int, raw string"), "raw").collect()}
    assert [(c, p) for _, c, p in got[1]] == [("one", None), ("a", 1), ("b", 1), ("c", 1), ("two", None)] == flat(tree, 3, None)
    assert got[2] == [(None, "first", None), (None, "second", None), (None, "third", None), (None, '"', None), (None, "plain", None)]
    assert got[3] == got[4] == [] and [x[1] for x in got[5]] == [raw[4][1]] and [x[1] for x in got[6]] == ["[broken"]


# manifests and order statistics


def test_reconciled(spark):
    schema = "a string, b int, rows long, digest string"
    actual = spark.createDataFrame([("x", 1, 5, "d"), ("x", 2, 5, "d"), (None, 1, 5, "d"), (None, None, 1, "d"), ("y", 1, 1, None)], schema)
    manifest = spark.createDataFrame([("x", 1, 5, "d"), ("x", 2, 6, "e"), (None, 1, 5, "d"), (None, 7, 1, "d"), ("y", 1, 1, None)], schema)
    assert {tuple(r) for r in Q.reconciled(actual, manifest, ["a", "b"]).collect()} == {("x", 2, "changed", 5, 6), (None, None, "extra", 1, None), (None, 7, "missing", None, 1)}
    assert Q.reconciled(actual, actual, ["a", "b"]).count() == 0 and Q.reconciled(actual.limit(0), manifest, ["a", "b"]).count() == 5


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_elements(spark, buckets):
    rng = random.Random(buckets)
    values = {g: [rng.choice([0.0, 1.0, 0.25, rng.random()]) for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 501))}
    df = spark.createDataFrame([(g, v, 1) for g, vs in values.items() for v in vs], "g string, v double, n int")
    got = X.elements(df, "v", ["g"], {"median": F.floor(F.col("n") / 2), "p90": F.floor(F.col("n") * 9 / 10), "low": F.lit(0)}, buckets).collect()
    assert {r["g"]: (r["n"], r["median"], r["p90"], r["low"]) for r in got} == {g: (len(v), sorted(v)[len(v) // 2], sorted(v)[len(v) * 9 // 10], min(v)) for g, v in values.items()}


def test_places_by_draw_are_a_permutation(spark):
    df = spark.range(700).select((F.col("id") % 3).alias("g"), F.col("id").alias("m"))
    rows = X.ranked_by_draw(df, ["g"], "m", 5, 16).withColumn("d", X.draw("m", 5)).collect()
    for g in range(3):
        own = [r for r in rows if r["g"] == g]
        assert [r["place"] for r in sorted(own, key=lambda r: (r["d"], r["m"]))] == [*range(len(own))]
    assert Counter(r["g"] for r in rows) == {0: 234, 1: 233, 2: 233}
