"""Quality rules: statistics of a text, and an isolation forest over them calibrated from labelled rows.

The statistics of all documents are computed in one pass without a shuffle and stored. A forest of
random splits is grown on a sample of them that is bounded by parameters; a document whose mean path to
a leaf is short is anomalous. The path length below which documents are rejected is set from all
labelled rows: the one that best separates the labels while at most ``max_loss`` of the good rows go.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, hash_bound, stored, with_columns

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("mean_chars", "symbols", "dup_lines", "repeats", "upper", "marks", "bare", "digits")
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: What the forest sees; the other ratios are for reports and for the fixed rules.
SEEN = ("mean_chars", "symbols", "upper", "marks", "bare")
TREES, SUBSAMPLE = 100, 64
#: At most so many rows grow the forest: each tree has its own subsample.
FIT_ROWS = TREES * SUBSAMPLE
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_MARKS = str.maketrans("", "", "!?;:#*$%&|<>=+~^_/\\@[]{}()\"")
_SYMBOLS = str.maketrans("", "", SYMBOLS)


def repeated_words(words: list[str]) -> int:
    """Words inside 3-word windows that occur twice or more in ``words``, each word once."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, inverse, counts = np.unique(pair[:-1].astype(np.int64) * len(number) + ids[2:], return_inverse=True, return_counts=True)
    hit = counts[inverse] > 1
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k : n - 2 + k] |= hit
    return int(cover.sum())


def statistics(text: str | None) -> tuple:
    """COUNTS, then RATIOS, of a text; a null text has no words."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    body = "".join(words)
    seen: set[str] = set()
    dup = full = 0
    for line in text.split("\n"):
        if WORD.search(line):
            full += 1
            if line in seen:
                dup += 1
            seen.add(line)
    repeat = repeated_words(words)
    chars = len(body)
    symbols = chars - len(body.translate(_SYMBOLS))
    lower = body.lower()
    upper = sum(map(str.__ne__, body, lower)) if len(lower) == chars else sum(c.isupper() for c in body)
    marks = chars - len(body.translate(_MARKS))
    bare = sum(not w[:1].isalnum() for w in words)
    digits = sum(map(str.isdigit, body)) if any(d in body for d in "0123456789") else 0
    m, c = max(n, 1), max(chars, 1)
    return n, chars, symbols, dup, repeat, chars / m, symbols / m, dup / max(full, 1), repeat / m, upper / c, marks / m, bare / m, digits / c


def document_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the statistics of each text appended (``_s_`` and a name); no shuffle. A null text has no words. Columns of
    ``docs`` must not have these names: ``judge`` sees to it."""
    at = docs.columns.index(text_col)
    fields = [*(T.StructField(f"_s_{c}", T.LongType()) for c in COUNTS), *(T.StructField(f"_s_{c}", T.DoubleType()) for c in RATIOS)]
    schema = T.StructType([*docs.schema.fields, *fields])
    return docs.mapInArrow(with_columns(docs.schema, fields, lambda b: [*zip(*map(statistics, b.column(at).to_pylist()), strict=True)]), schema)


@dataclass
class Tree:
    feature: np.ndarray  # -1 in a leaf
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray  # of a leaf, with the mean depth that its rows would still need


def mean_depth(n: float) -> float:
    """Mean depth of an unsuccessful search in a random tree of n rows."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(rows: np.ndarray, rng: np.random.Generator, limit: int) -> Tree:
    nodes: list[list[float]] = []

    def add(part: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, depth + mean_depth(len(part))])
        low, high = part.min(0), part.max(0)
        can = np.flatnonzero(high > low)
        if depth < limit and len(part) > 1 and len(can):
            f = int(rng.choice(can))
            cut = rng.uniform(low[f], high[f])
            below = part[:, f] <= cut
            if below.any() and not below.all():
                nodes[at][:2] = f, cut
                nodes[at][2] = add(part[below], depth + 1)
                nodes[at][3] = add(part[~below], depth + 1)
        return at

    add(rows, 0)
    a = np.array(nodes)
    return Tree(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4])


def forest(rows: np.ndarray, seed: int = 7, trees: int = TREES, subsample: int = SUBSAMPLE) -> list[Tree]:
    rng = np.random.default_rng(seed)
    size = min(subsample, len(rows))
    limit = int(np.ceil(np.log2(max(size, 2)))) + 2
    return [grow(rows[rng.choice(len(rows), size, replace=False)], rng, limit) for _ in range(trees)] if len(rows) else []


def anomaly(trees: list[Tree], rows: np.ndarray, subsample: int = SUBSAMPLE) -> np.ndarray:
    """2 ** -(mean path / expected path): above one half is more anomalous than usual."""
    if not trees:
        return np.zeros(len(rows))
    total = np.zeros(len(rows))
    every = np.arange(len(rows))
    for t in trees:
        at = np.zeros(len(rows), int)
        while True:
            f = t.feature[at]
            go = f >= 0
            if not go.any():
                break
            i = every[go]
            at[i] = np.where(rows[i, f[i]] <= t.cut[at[i]], t.left[at[i]], t.right[at[i]])
        total += t.depth[at]
    return 2.0 ** -(total / len(trees) / max(mean_depth(subsample), 1e-9))


BINS = 2000


def fit(stats: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", max_loss: float = 0.001) -> tuple[list[Tree], float]:
    """The forest and the anomaly from which on documents are rejected.

    The forest is grown from the FIT_ROWS documents with the smallest hashes among those that pass the fixed
    rules. The threshold comes from the anomalies of all labelled rows, counted in BINS bins: the middle
    of the best cut by caught bad rows minus lost good rows, with at most ``max_loss`` of the good rows lost.
    Without labelled rows of both kinds nothing is rejected.
    """
    passed = stats.where(~base_failed())
    seen = [f"_s_{c}" for c in SEEN]
    draw = F.xxhash64(F.col(id_col).cast("string"), *seen, F.lit("forest"))
    # Twice as many rows as needed pass the bound; only those are sorted, so no partition sends FIT_ROWS of its own.
    share = min(1.0, 2 * FIT_ROWS / max(1, passed.count()))
    near = passed.where(draw <= F.lit(hash_bound(share)))
    sample = near.orderBy(draw, *seen).limit(FIT_ROWS).select(*seen).toPandas().to_numpy(float)
    trees = forest(sample)
    if labels is None or not trees:
        return trees, float("inf")
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rated = score(passed.select(F.col(id_col).alias("doc_id"), *seen).join(known.hint("merge"), "doc_id"), trees)
    bins = {(r["quality"], r["bin"]): r["n"] for r in rated.groupBy("quality", F.floor(F.col("_s_anomaly") * BINS).cast("int").alias("bin")).agg(F.count("*").alias("n")).collect()}
    good, bad = (np.array([bins.get((q, k), 0) for k in range(BINS + 1)], float) for q in (1, 0))
    if not good.sum() or not bad.sum():
        return trees, float("inf")
    lost, caught = good[::-1].cumsum()[::-1] / good.sum(), bad[::-1].cumsum()[::-1] / bad.sum()
    gain = np.where(lost <= max_loss, caught - lost, -1.0)
    best = np.flatnonzero(gain == gain.max())
    return trees, float((best[0] + best[-1]) / 2 / BINS) if gain.max() > 0 else float("inf")


def base_failed(prefix: str = "_s_"):
    words, repeats = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (words < MIN_WORDS) | (repeats * 100 > words * MAX_REPEAT_PERCENT)


def score(stats: DataFrame, trees: list[Tree]) -> DataFrame:
    """Appends the anomaly of each row, 0 to 1."""
    at = [stats.columns.index(f"_s_{c}") for c in SEEN]
    field = T.StructField("_s_anomaly", T.DoubleType())
    compute = with_columns(stats.schema, [field], lambda b: [anomaly(trees, np.stack([b.column(k).to_numpy() for k in at], 1))])
    return stats.mapInArrow(compute, T.StructType([*stats.schema.fields, field]))


def judge(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Per row of ``docs``: row (all its columns as a struct), _s_<statistic>, _s_anomaly, _s_base_failed and _s_kept.

    Base rules fail texts of under MIN_WORDS words and those with over MAX_REPEAT_PERCENT percent of words in
    repeated 3-word windows; the forest decides on the rest. Null and empty texts have no words and fail.
    Repeated rows get equal verdicts; an empty table stays empty. Rows are never shuffled, and columns may have any name.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text")
    stats = stored(document_statistics(rows).drop("text"), "rule-statistics")
    trees, most = fit(stats, labels)
    scored = score(stats, trees).withColumn("_s_base_failed", base_failed())
    return scored.withColumn("_s_kept", ~F.col("_s_base_failed") & (F.col("_s_anomaly") < F.lit(most)))


def verdicts(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Per document: doc_id, the counts, base_failed, kept, anomaly. The texts are read once and not stored."""
    rows = docs.select("doc_id", "text")
    stats = stored(document_statistics(rows).drop("text"), "rule-statistics")
    trees, most = fit(stats, labels)
    failed = base_failed()
    scored = score(stats, trees).withColumn("_s_base_failed", failed).withColumn("_s_kept", ~failed & (F.col("_s_anomaly") < F.lit(most)))
    return scored.select("doc_id", *(F.col(f"_s_{c}").alias(c) for c in (*COUNTS, "base_failed", "kept", "anomaly")))


def keep_good(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns unchanged."""
    return judge(docs, labels).where("_s_kept").select("row.*")
