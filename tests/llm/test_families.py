"""Dense families: rows of one template, unlike each other, each with a true near copy. Every pair has to be found without comparing all rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import linedup, neardup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]


def jaccard(a, b):
    return len(a & b) / len(a | b)


def chars(x):
    return {x[i : i + 6] for i in range(len(x) - 5)}


def words(x):
    w = x.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def family(rng, n, template, own, changed):
    """2 n token lists: a template with a slot of own tokens, and a copy of each with a run of ``changed`` other tokens somewhere in the template."""
    base = [rng.choice(WORDS) + str(rng.randrange(10**6)) for _ in range(template)]
    at, out = template // 3, []
    for _ in range(n):
        row = base[:at] + [f"u{rng.randrange(10**9)}" for _ in range(own)] + base[at:]
        copy = list(row)
        k = rng.randrange(at + own, len(row) - changed)
        copy[k : k + changed] = [f"v{rng.randrange(10**9)}" for _ in range(changed)]
        out += [row, copy]
    return out


@pytest.mark.parametrize(("kind", "n", "shape"), [("lines", 400, (40, 5, 2)), ("texts", 300, (150, 25, 9))])
def test_template_families(spark, kind, n, shape):
    rng = random.Random(n)
    rows = [" ".join(x) for x in family(rng, n, *shape)]
    sets = [chars(x) if kind == "lines" else words(x) for x in rows]
    true = [jaccard(sets[2 * i], sets[2 * i + 1]) for i in range(n)]
    siblings = [jaccard(sets[2 * rng.randrange(n)], sets[2 * rng.randrange(n)]) for _ in range(300)]
    siblings = [x for x in siblings if x < 1]
    assert 0.68 < sum(siblings) / len(siblings) < 0.78 and max(siblings) < 0.8 and 0.8 <= min(true) and max(true) < 0.92
    df = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in enumerate(rows)], SCHEMA)
    left = {r["doc_id"] for r in (linedup.remove(df) if kind == "lines" else neardup.keep_first(df)).collect()}
    both = sum(2 * i in left and 2 * i + 1 in left for i in range(n))
    assert both <= 0.05 * n, f"{both} of {n} pairs stay"
    assert sum(2 * i in left or 2 * i + 1 in left for i in range(n)) >= 0.98 * n  # siblings are not merged


def test_contained_rows_of_a_template(spark):
    """Rows that are parts of their hub have no residue of their own; they are told apart by what they lack."""
    rng = random.Random(2)
    base = [rng.choice(WORDS) + str(rng.randrange(10**6)) for _ in range(200)]
    rows = [" ".join(base)]
    for k in range(40):
        part = base[k * 4 : k * 4 + 40]
        rows += [" ".join(part), " ".join(part[:-1])]
    df = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in enumerate(rows)], SCHEMA)
    left = Counter(r["doc_id"] for r in neardup.keep_first(df).collect())
    assert 0 in left and sum((1 + 2 * k in left) and (2 + 2 * k in left) for k in range(40)) <= 2
