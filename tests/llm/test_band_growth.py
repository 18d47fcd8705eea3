"""Near copies of one original: what is compared grows with the rows, and no similar pair among rows far from the original is lost."""

import random

from pyspark.sql import functions as F

from tallyforge.llm import linedup
from tests.llm.test_families import SCHEMA, WORDS, chars, jaccard


def test_near_copies_of_one_line(spark, monkeypatch):
    rng = random.Random(5)
    base = [rng.choice(WORDS) + str(rng.randrange(10**4)) for _ in range(40)]
    rows = [" ".join(base)]
    for _ in range(500):
        copy = list(base)
        for k in rng.sample(range(40), rng.choice([1, 2, 3, 4, 5])):
            copy[k] = f"v{rng.randrange(10**6)}"
        rows.append(" ".join(copy))
    seen: list[int] = []
    cut = linedup.residue

    def counted(banded, texts):
        seen.append(banded.count())
        return cut(banded, texts)

    monkeypatch.setattr(linedup, "residue", counted)
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in enumerate(rows)], SCHEMA)
    found = linedup.components_of_lines(docs)
    names = {r["line"]: r["k"] for r in linedup.lines(docs).select("line", "k").collect()}
    component = {r["node"]: r["component"] for r in found.collect()}
    # Rows in bands that are cut, over all levels: the loop before had many times the rows, as each level multiplied the bands of a row.
    assert sum(seen) <= 3 * len(rows), seen
    sets = [chars(x) for x in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= linedup.SIMILARITY]
    parted = sum(component.get(names[rows[i]]) is None or component.get(names[rows[i]]) != component.get(names[rows[j]]) for i, j in pairs)
    assert len(pairs) > 1000 and parted <= 0.01 * len(pairs), f"{parted} of {len(pairs)}"


def test_bands_of_the_same_rows_are_one(spark):
    """Rows of two bands with equal members are handed on once, and rows outside the hub's component meet all others."""
    from tallyforge.llm.common import OUTSIDERS, clusters

    n = 4 * OUTSIDERS
    members = spark.createDataFrame([(b, k) for b in (1, 2, 3) for k in range(n)], "band long, k long")
    given = []

    def residue(rows):
        given.append(rows.count())
        return rows.where("k < 8").selectExpr("explode(array(10L, 11L, 12L)) as band", "k").distinct()

    # 2 and 5 are similar; the hub is like the upper half only.
    found = clusters(members, lambda pairs: pairs.where(f"(a = {n - 1} and b >= {n // 2}) or (a = 5 and b = 2)"), residue)
    component = {r["node"]: r["component"] for r in found.collect()}
    assert component[2] == component[5] == 2 and component[n - 1] == n // 2
    assert given == [n - 1]
