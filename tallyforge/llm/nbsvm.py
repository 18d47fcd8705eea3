"""Quality classifier: Naive Bayes support vectors over hashed n-gram indicators.

Document counts of every n-gram per class, over all labelled training rows, give log-count ratios. The
indicators of a text are scaled by the ratios and brought to unit length, and a linear hinge loss is
fitted on them by dual coordinate descent, over a sample of at most ``fit_rows`` labelled
rows. A part of the sample that the fit does not see sets the slope and offset of the
score, a logistic function of the margin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, hash_bound, with_columns
from .rlz import word_hashes

BITS = 17
SIZE = 1 << BITS
ORDERS = (1, 2, 3, 4)
REPEAT_ORDERS = range(1, 9)
#: Bound of the labelled rows on which the hinge loss is fitted; the counts cover all labelled rows.
FIT_ROWS = 4000
BLOCK = 4096
_SPREAD = np.uint32(2654435761)


def indicators(text: str | None, flags: np.ndarray) -> np.ndarray:
    """Sorted hash buckets of the n-grams of a text; ``flags`` is scratch of SIZE zeros.

    There are n-grams of its bytes, and n-grams of the sequence that says of each word whether it repeats the one before.
    """
    raw = np.frombuffer((text or "").encode(), np.uint8).astype(np.uint32)
    code = np.zeros(len(raw), np.uint32)
    for n in ORDERS:
        if len(raw) < n:
            break
        code = (code[: len(raw) - n + 1] << np.uint32(8)) | raw[n - 1 :]
        flags[((code + np.uint32(n * 0x9E37)) * _SPREAD) >> np.uint32(32 - BITS)] = 1
    words = word_hashes(text)
    again = (words[1:] == words[:-1]).astype(np.uint32)
    code = np.zeros(len(again), np.uint32)
    for n in REPEAT_ORDERS:
        if len(again) < n:
            break
        code = (code[: len(again) - n + 1] << np.uint32(1)) | again[n - 1 :]
        flags[((code + np.uint32(n * 0x85EB51)) * _SPREAD) >> np.uint32(32 - BITS)] = 1
    found = np.flatnonzero(flags).astype(np.int32)
    flags[found] = 0
    return found


def class_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(counts[2, SIZE], rows[2]) of training rows (text, y). Partitions count for themselves; the sums
    are combined by block, so what reaches the driver has a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, counts, n = np.zeros(SIZE, np.uint8), np.zeros((2, SIZE), np.int64), [0, 0]
        for b in batches:
            for k in range(b.num_rows):
                y = b.column(1)[k].as_py()
                counts[y, indicators(b.column(0)[k].as_py(), flags)] += 1
                n[y] += 1
        for y in (0, 1):
            if n[y]:
                parts = [*counts[y].reshape(-1, BLOCK), np.array([n[y]])]
                yield pa.RecordBatch.from_arrays([pa.array([y] * len(parts), pa.int32()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.list_(pa.int64()))], names=["y", "block", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"y": rows["y"][:1], "block": rows["block"][:1], "counts": [np.sum(rows["counts"].tolist(), axis=0)]})

    schema = "y int, block int, counts array<long>"
    summed = rows.select("text", "y").mapInArrow(run, schema).groupBy("y", "block").applyInPandas(add, schema).collect()
    counts, n = np.zeros((2, SIZE)), np.zeros(2)
    for r in summed:
        if r["block"] == SIZE // BLOCK:
            n[r["y"]] = r["counts"][0]
        else:
            counts[r["y"], r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = r["counts"]
    return counts, n


def log_ratios(counts: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p = counts + alpha
    return np.log(p[1] / p[1].sum()) - np.log(p[0] / p[0].sum())


def descend(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: float = 10.0, epochs: int = 25, seed: int = 3) -> np.ndarray:
    """Weights of a linear hinge loss with a bias (last weight), by dual coordinate descent over rows of (index, value)."""
    w, a = np.zeros(SIZE + 1), np.zeros(len(x))
    rng = np.random.default_rng(seed)
    norm = np.array([v @ v + 1.0 for _, v in x])
    for _ in range(epochs):
        moved = 0.0
        for k in rng.permutation(len(x)):
            i, v = x[k]
            gradient = y[k] * (w[i] @ v + w[-1]) - 1.0
            new = min(max(a[k] - gradient / norm[k], 0.0), c)
            step = (new - a[k]) * y[k]
            if step:
                w[i] += step * v
                w[-1] += step
                moved = max(moved, abs(step))
                a[k] = new
        if moved < 1e-3:
            break
    return w


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y = 1) by Newton steps with smoothed targets."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    t = np.where(y == 1, hi, lo)
    ab = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones(len(margin))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        g = x.T @ (p - t) + 1e-3 * ab
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), g)
        ab = ab - np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return float(max(ab[0], 1e-6)), float(ab[1])


@dataclass
class Model:
    scaled: np.ndarray  # ratio times weight of each bucket
    square: np.ndarray  # ratio squared, for unit length
    bias: float
    slope: float
    offset: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        flags = np.zeros(SIZE, np.uint8)
        out = np.empty(len(texts))
        for k, t in enumerate(texts):
            i = indicators(t, flags)
            out[k] = self.bias + float(self.scaled[i].sum() / np.sqrt(max(self.square[i].sum(), 1e-12)))
        return 1 / (1 + np.exp(-np.clip(self.slope * out + self.offset, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learns from the rows of ``labels`` (doc_id, y in 0 and 1; one row per id) and the texts of ``docs``."""
    # Labels grow with the corpus, so the texts are always joined by sorting; they cross the network once.
    rows = docs.select("doc_id", "text").join(labels.select("doc_id", "y").hint("merge"), "doc_id").select("text", "y")
    counts, n = class_counts(rows)
    if not n.all():
        return Model(np.zeros(SIZE, np.float32), np.ones(SIZE, np.float32), 0.0, 1.0, 0.0)
    ratio = log_ratios(counts)
    # The sample is drawn from the labels alone: its size is proven, so it may be broadcast.
    # Twice as many labels as needed pass a bound on the hash; only those are sorted, so no partition sends fit_rows of its own.
    draw = F.xxhash64(F.col("doc_id").cast("string"), F.lit("fit"))
    share = min(1.0, 2 * fit_rows / max(1.0, min(n.sum(), labels.count())))  # rows may repeat an id
    drawn = labels.where(draw <= F.lit(hash_bound(share))).orderBy(draw, "doc_id").limit(fit_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", F.col("y").cast("int").alias("y"), F.col("doc_id").cast("string").alias("k"))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(SIZE, np.uint8)
        for b in batches:
            found = [indicators(x.as_py(), flags) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([0] * len(found), pa.int32()), pa.array([x.tobytes() for x in found], pa.binary())], names=["y", "k", "one", "marks"])

    # What meets in one task are at most fit_rows rows of at most SIZE indicators, however long the texts are and however often rows repeat an id.
    distinct = texts.mapInArrow(marks, "y int, k string, one int, marks binary").dropDuplicates(["k", "marks"])
    sample = distinct.orderBy(F.xxhash64("k", "marks"), "k", "marks").limit(fit_rows)

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["k", "marks", "y"], ignore_index=True)
        x = []
        for m in rows["marks"]:
            i = np.frombuffer(bytes(m), np.int32)
            v = ratio[i]
            x.append((i, v / np.sqrt(max(v @ v, 1e-12))))
        y = rows["y"].to_numpy()
        rest = np.arange(len(x)) % 4 == 0
        if len({*y[rest]}) < 2 or len({*y[~rest]}) < 2:
            rest[:] = True
            w = descend(x, 2.0 * y - 1)
        else:
            w = descend([r for r, z in zip(x, rest, strict=True) if not z], 2.0 * y[~rest] - 1)
        margin = np.array([w[i] @ v + w[-1] for (i, v), z in zip(x, rest, strict=True) if z])
        slope, offset = logistic(margin, y[rest])
        return pd.DataFrame({"scaled": [(ratio * w[:-1]).astype("<f4").tobytes()], "bias": [w[-1]], "slope": [slope], "offset": [offset]})

    m = sample.groupBy("one").applyInPandas(learn, "scaled binary, bias double, slope double, offset double").first()
    return Model(np.frombuffer(bytes(m["scaled"]), "<f4"), (ratio**2).astype(np.float32), m["bias"], m["slope"], m["offset"])


def with_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score appended; texts only, no shuffle. Null and empty texts get the score of the bias, equal texts equal scores, an empty table stays empty.
    A column of that name that is there already stays, and the new one gets an underscore."""
    at, name = docs.columns.index(text_col), fresh(name, docs.columns)
    field = [T.StructField(name, T.DoubleType())]
    return docs.mapInArrow(with_columns(docs.schema, field, lambda b: [model.scores(b.column(at).to_pylist())]), T.StructType([*docs.schema.fields, *field]))


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5; the rows with 0 are held out."""
    return F.crc32(F.col(id_col).cast("string")) % 5


def held_out_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learned from the other folds only.

    Labels with null id or quality are not used; of several labels of one id the largest counts.
    Rows with a null id are scored and not held out.
    """
    train = labels.where("doc_id is not null and quality in (0, 1)").where(fold() != 0).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    scored = with_score(docs.select("doc_id", "text"), fit(docs, train))
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
