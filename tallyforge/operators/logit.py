"""Ridge logistic regression on sparse signed features: many fits over the same contests at once.

A contest is a handful of signed terms (champions, teams, pairs and triples of a side, counters), so its chance is a logistic function of sums of coefficients,
each block of which has a penalty of its own. Models, penalties, folds and redrawn labels differ between fits, the terms do not. The terms are
numbered and packed once into blocks of contests, which stay with the executors; every pass over them takes the coefficients of all open fits to the blocks and sums
losses and gradients back in a tree. So a grid of penalties and folds takes as many passes as its slowest fit, not as many as all fits together.

Coefficients live on the driver, as in any linear model of Spark: they are as many as there are entities, pairs and triples, whatever the number of contests. Fits are taken in lots
whose coefficients stay below ``LOT``, and a model with more than that alone is refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ledger import work_dir

KINDS = ("champion", "team", "pair", "triple", "counter")
#: Blocks of each nested model.
MODELS = {
    "M0": (),
    "M1": ("champion",),
    "M2": ("champion", "team"),
    "M3": ("champion", "team", "pair"),
    "M4": ("champion", "team", "pair", "triple"),
    "M5": ("champion", "team", "counter"),
    "M6": KINDS,
}
BASE_KINDS = ("champion", "team")
CONTESTS_PER_BLOCK = 4096
#: Coefficients that travel at once, in doubles.
LOT = 1 << 22
PASSES = 2000
#: A fit ends when no coefficient would move by more than TOLERANCE and no slope is steeper than SLOPE.
TOLERANCE, SLOPE = 1e-7, 1e-4
#: Steps remembered by a fit, and the most columns of the dense part of its scaling.
MEMORY, CORE = 6, 1024


@dataclass(frozen=True)
class Fit:
    """One fit: its model, the penalties of champions and teams (base) and of all combos (extra), which label of a contest it
    explains, and which of the contest's folds it leaves out (fold < 0: none)."""

    model: str
    base: float
    extra: float = 0.0
    label: int = 0
    folding: int = 0
    fold: int = -1

    def penalty(self, kind: str) -> float:
        return self.base if kind in BASE_KINDS else self.extra


def signed_terms(o: DataFrame) -> DataFrame:
    """(match_id, kind, a, b, c, sign) of oriented contests: one signed key for an unordered pair of opponents. Teams are named by career and team."""

    def combos(side: str, sign: int) -> str:
        pairs = f"flatten(transform({side}, x -> transform(filter({side}, y -> y > x), y -> struct('pair' as kind, x as a, y as b, 0L as c, {sign} as sign))))"
        triples = f"flatten(flatten(transform({side}, x -> transform(filter({side}, y -> y > x), y -> transform(filter({side}, z -> z > y), z -> struct('triple' as kind, x as a, y as b, z as c, {sign} as sign))))))"
        return f"{pairs}, {triples}"

    def one(side: str, team: str, sign: int) -> str:
        return f"""transform({side}, x -> struct('champion' as kind, x as a, 0L as b, 0L as c, {sign} as sign)),
            if({team} is null, array(), array(struct('team' as kind, cast(career_id as bigint) as a, cast({team} as bigint) as b, 0L as c, {sign} as sign))), {combos(side, sign)}"""

    every = F.expr(
        f"""concat({one('left', 'left_team', 1)}, {one('right', 'right_team', -1)},
        flatten(transform(left, x -> transform(right, y -> struct('counter' as kind, least(x, y) as a, greatest(x, y) as b, 0L as c, if(x < y, 1, -1) as sign)))))"""
    )
    return o.select("match_id", F.explode(every).alias("t")).select("match_id", "t.*")


def numbered(terms: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """((kind, a, b, c, id), how many of each kind): ids are dense within a kind. Numbers are given within hash buckets, so no task sorts all keys."""
    spark = terms.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = terms.select("kind", "a", "b", "c").distinct().withColumn("bucket", F.pmod(F.xxhash64("kind", "a", "b", "c"), F.lit(buckets)))
    keys = written(keys, "logit-keys")
    counts: dict[tuple[str, int], int] = {(r[0], r[1]): r[2] for r in keys.groupBy("kind", "bucket").count().collect()}
    sizes, offsets = dict.fromkeys(KINDS, 0), []
    for (kind, bucket), n in sorted(counts.items()):
        offsets.append((kind, bucket, sizes[kind]))
        sizes[kind] += n
    place = F.row_number().over(Window.partitionBy("kind", "bucket").orderBy("a", "b", "c")) - 1
    first = F.broadcast(spark.createDataFrame(offsets, "kind string, bucket long, first long"))  # a row for each kind and bucket
    return keys.withColumn("place", place).join(first, ["kind", "bucket"]).select("kind", "a", "b", "c", (F.col("first") + F.col("place")).cast("int").alias("id")), sizes


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the folder that driver and executors share, read back: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, work_dir(df.sparkSession, f"{name}-{uuid.uuid4().hex[:8]}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Up to so many keys, by their count, are taken to the terms; more are met by sorting.
FEW = 1 << 17


def by_contest(left: DataFrame, right: DataFrame, on: str = "match_id") -> DataFrame:
    """A join of tables that grow with the contests. Spark takes exploded terms and scored blocks for as small as their file, and would collect them on the driver to broadcast them."""
    return left.join(right.hint("merge"), on)


@dataclass
class Problem:
    """Packed contests: blocks (a row each), the numbered keys, and how many keys each kind has."""

    blocks: DataFrame
    keys: DataFrame
    sizes: dict[str, int]

    def columns(self, model: str) -> int:
        return sum(self.sizes[k] for k in MODELS[model])


BLOCK = "n int, match_id binary, labels binary, folds binary, row binary, kind binary, id binary, sign binary"


def packed(o: DataFrame, labels: Column, folds: Column, keys: tuple[DataFrame, dict[str, int]] | None = None) -> Problem:
    """Oriented contests as blocks. ``labels`` is an array of 0 and 1 of a contest, ``folds`` one of fold numbers; fits choose one of each."""
    terms = signed_terms(o)
    names, sizes = keys or numbered(terms)
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    few = sum(sizes.values()) <= FEW
    listed = terms.join(names.hint("broadcast" if few else "merge"), ["kind", "a", "b", "c"]).groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct(kind.alias("kind"), "id", "sign"))).alias("t"))
    rows = by_contest(o.select("match_id", labels.cast("array<int>").alias("labels"), folds.cast("array<int>").alias("folds")), listed)
    flat = rows.select("match_id", "labels", "folds", *(F.col(f"t.{c}").alias(c) for c in ("kind", "id", "sign")))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(k, CONTESTS_PER_BLOCK) for x in batches for k in range(0, x.num_rows, CONTESTS_PER_BLOCK)):
            wide = lambda name: np.array(b.column(name).flatten(), np.int32).reshape(b.num_rows, -1)
            each = np.diff(b.column("id").offsets.to_numpy())
            made = [b.column("match_id").to_numpy().astype(np.int64), wide("labels").astype(np.int8), wide("folds").astype(np.int8), np.repeat(np.arange(b.num_rows, dtype=np.int32), each)]
            made += [np.array(b.column(c).flatten(), t) for c, t in (("kind", np.int8), ("id", np.int32), ("sign", np.int8))]
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32()), *(pa.array([x.tobytes()]) for x in made)], names=[x.split()[0] for x in BLOCK.split(", ")])

    return Problem(written(flat.mapInArrow(pack, BLOCK), "logit-blocks"), names, sizes)


class Block:
    """A block of contests in memory, and its terms as a model numbers them."""

    def __init__(self, n: int, match_id: bytes, labels: bytes, folds: bytes, row: bytes, kind: bytes, ident: bytes, sign: bytes):
        self.n, self.match_id = n, np.frombuffer(match_id, np.int64)
        self.labels, self.folds = (np.frombuffer(x, np.int8).reshape(n, -1) for x in (labels, folds))
        self.row, self.kind, self.id, self.sign = np.frombuffer(row, np.int32), np.frombuffer(kind, np.int8), np.frombuffer(ident, np.int32), np.frombuffer(sign, np.int8).astype(float)

    def terms(self, model: str, sizes: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, sign) of the model's terms."""
        first = np.full(len(KINDS), -1, np.int64)
        at = 0
        for k in MODELS[model]:
            first[KINDS.index(k)] = at
            at += sizes[k]
        use = first[self.kind] >= 0
        return self.row[use], first[self.kind[use]] + self.id[use], self.sign[use]


def _pass(blocks: Iterable[Block], at: list[tuple[int, Fit, np.ndarray]], sizes: dict[str, int]) -> dict[int, np.ndarray]:
    """Of each fit: the loss and its gradient over the contests it trains on, as one vector."""
    total = {number: np.zeros(len(theta) + 1) for number, _, theta in at}
    for b in blocks:
        terms = {m: b.terms(m, sizes) for m in {f.model for _, f, _ in at}}
        for number, f, theta in at:
            row, column, sign = terms[f.model]
            eta = np.bincount(row, sign * theta[column], b.n)
            y = b.labels[:, f.label]
            train = b.folds[:, f.folding] != f.fold if f.fold >= 0 else np.ones(b.n, bool)
            total[number][0] += (np.logaddexp(0, eta) - y * eta)[train].sum()
            slope = np.where(train, 1 / (1 + np.exp(-np.clip(eta, -500, 500))) - y, 0.0)
            total[number][1:] += np.bincount(column, sign * slope[row], len(theta))
    return total


def _added(x: dict[int, np.ndarray], y: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    return {k: x[k] + y[k] for k in x}


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b without BLAS, whose threads can stand still on a driver beside Spark."""
    return np.einsum("...i,i->..." if b.ndim == 1 else "ki,ij->kj", a, b)


def _inverse(a: np.ndarray) -> np.ndarray:
    """The inverse of a positive definite matrix by Gauss-Jordan steps, without BLAS as well."""
    a = a.copy()
    for k in range(len(a)):
        pivot, column, row = a[k, k], a[:, k].copy(), a[k] / a[k, k]
        column[k] = 0
        a -= np.multiply.outer(column, row)
        a[:, k] = -column / pivot
        a[k] = row
        a[k, k] = 1 / pivot
    return (a + a.T) / 2


@dataclass
class Nesting:
    """How the columns of a block are sums of those of a finer one: champions and pairs of triples, champions of pairs and of counters. With sides of m champions a champion's
    column is the sum of its counters' by 1 / m, of its pairs' by 1 / (m - 1), and a pair's that of its triples by 1 / (m - 2). ``parts[fine]`` holds (coarse kind, ids of the coarse
    keys of each fine key, factor)."""

    sizes: dict[str, int]
    uses: dict[str, np.ndarray]
    parts: dict[str, list[tuple[str, np.ndarray, float]]]
    careers: np.ndarray
    cancel: set[str]

    @staticmethod
    def of(problem: Problem, uses: dict[str, np.ndarray], cancel: set[str]) -> Nesting:
        sizes, parts = problem.sizes, {k: [] for k in KINDS}
        total = {k: v.sum() for k, v in uses.items()}
        careers = np.zeros(sizes["team"], int)
        if not total["champion"] or sizes["champion"] > CORE:
            return Nesting(sizes, uses, parts, careers, cancel)
        side = max(1 + 2 * total["pair"] / total["champion"], 2 * total["counter"] / total["champion"])
        wanted = [k for k in KINDS if k in BASE_KINDS or (k in ("triple", "counter", "pair") and sizes[k])]
        keys = {k: p.sort_values("id")[["a", "b", "c"]].to_numpy() for k, p in problem.keys.where(F.col("kind").isin(*wanted)).toPandas().groupby("kind")}  # as many as coefficients
        names = keys["champion"][:, 0]
        if sizes["team"]:
            careers = keys["team"][:, 0]
        order = np.argsort(names)
        place = lambda c: order[np.searchsorted(names[order], c)]
        if "pair" in keys and side > 1:
            parts["pair"].append(("champion", np.stack([place(keys["pair"][:, j]) for j in (0, 1)], 1), 1 / (side - 1)))
        if "counter" in keys:
            parts["counter"].append(("champion", np.stack([place(keys["counter"][:, j]) for j in (0, 1)], 1), 1 / side))
        if "triple" in keys and side > 2:
            three = np.stack([place(keys["triple"][:, j]) for j in range(3)], 1)
            parts["triple"].append(("champion", three, 2 / ((side - 1) * (side - 2))))
            if sizes["champion"] + sizes["pair"] <= CORE:
                number = np.zeros((len(names), len(names)), np.int64)
                two = np.sort(parts["pair"][0][1], 1)
                number[two[:, 0], two[:, 1]] = np.arange(len(two))
                low = np.sort(three, 1)
                parts["triple"].append(("pair", np.stack([number[low[:, i], low[:, j]] for i, j in ((0, 1), (0, 2), (1, 2))], 1), 1 / (side - 2)))
        return Nesting(sizes, uses, parts, careers, cancel)


class Scaling:
    """The inverse of a bound of a model's Hessian, as first guess of its curvature.

    A champion's column is a sum of its pairs' columns, and so on: what one block gains another can lose at no more than the penalty, so the Hessian's diagonal says nothing about
    these directions, and the more contests there are the more passes it takes. So columns of coarse blocks are written as sums of those of the finest block, whose square is close to a multiple of its
    diagonal whatever their number; then the finest block is eliminated by itself and a small dense system is left. Where counters stand beside triples, each spans the champions, and the
    directions in which these cancel are taken out, as are those in which the columns of a block do.
    """

    def __init__(self, nesting: Nesting, model: str, penalty: dict[str, float], cores: dict):
        sizes, at = nesting.sizes, 0
        self.span: dict[str, slice] = {}
        for k in MODELS[model]:
            self.span[k] = slice(at, at := at + sizes[k])
        self.n = at
        # Twice the uses for combos: the squares of their blocks lie between one and four times the diagonal.
        half = {k: nesting.uses[k] / (4 if k in BASE_KINDS else 2) for k in MODELS[model]}
        self.diagonal = np.concatenate([np.zeros(0), *(1 / np.maximum(penalty[k] + half[k], 1e-9) for k in MODELS[model])])
        top = next((k for k in ("triple", "pair", "counter") if k in self.span and sizes[k] and nesting.parts[k]), None)
        self.top, self.core, self.correction = None, [], None
        if top is None:
            self._cancel(nesting, half, None)
            return
        self.top, self.d = self.span[top], half[top]
        self.w = self.diagonal[self.top]
        ids, factors = [], []
        width = 0
        for kind, index, factor in nesting.parts[top]:
            signs = (1, -1) if top == "counter" else (1,) * index.shape[1]
            if kind in self.span:
                ids.append(index + width)
                factors += [factor * s for s in signs]
                self.core.append(self.span[kind])
                width += sizes[kind]
        self.index, self.factor, self.width = np.concatenate(ids, 1), np.array(factors), width
        key = (top, width, *(penalty[k] for k in MODELS[model] if k in (top, "champion", "pair")))
        if key not in cores:
            s = self._square(self.d * penalty[top] * self.w)
            own = np.concatenate([np.full(sizes[k], penalty[k]) for k, _, _ in nesting.parts[top] if k in self.span])
            s[np.diag_indices(width)] += np.maximum(own, 1e-9)
            cores[key] = _inverse(s)
        self.inverse = cores[key]
        self._cancel(nesting, half, top)

    def _square(self, weight: np.ndarray) -> np.ndarray:
        m = len(self.factor)
        out = np.zeros(self.width * self.width)
        for i in range(m):
            for j in range(m):
                out += np.bincount(self.index[:, i] * self.width + self.index[:, j], self.factor[i] * self.factor[j] * weight, self.width * self.width)
        return out.reshape(self.width, self.width)

    def _down(self, t: np.ndarray) -> np.ndarray:
        return np.bincount(self.index.ravel(), (t[:, None] * self.factor).ravel(), self.width)

    def _plain(self, g: np.ndarray) -> np.ndarray:
        x = self.diagonal * g
        if self.top is not None:
            t, dw = g[self.top], self.d * self.w
            c = _times(self.inverse, np.concatenate([g[s] for s in self.core]) - self._down(dw * t))
            x[self.top] = self.w * t - dw * _times(c[self.index], self.factor)
            at = 0
            for s in self.core:
                x[s] = c[at : (at := at + s.stop - s.start)]
        return x

    def _cancel(self, nesting: Nesting, half: dict[str, np.ndarray], top: str | None) -> None:
        """Takes out the directions of the fine blocks in which columns cancel: teams of a career, champions, pairs and triples sum to nothing, as both sides have as many, and
        with triples and counters each champion is there twice."""
        sizes, columns, n = nesting.sizes, [], nesting.sizes["champion"]
        twice = top == "triple" and "triple" in nesting.cancel and "counter" in self.span and len(nesting.parts["counter"]) > 0 and n <= 256
        if twice:
            of, by = nesting.parts["counter"][0][1:]
            for a in range(n):  # the champions come first in the core
                x = np.zeros(self.n)
                x[self.top] = self.factor[0] * (self.index[:, :3] == a).sum(1)
                x[self.span["counter"]] = -by * ((of[:, 0] == a).astype(float) - (of[:, 1] == a))
                columns.append(x)
        fine = [k for k in self.span if k == top or (k in BASE_KINDS and self.span[k] not in self.core)]
        for k in fine:
            if sizes[k] and k in nesting.cancel and k != "counter" and not (k == top and twice):
                groups = nesting.careers if k == "team" else np.zeros(sizes[k], int)
                for g in np.unique(groups):
                    x = np.zeros(self.n)
                    x[self.span[k]] = groups == g
                    columns.append(x)
        if columns:
            fine_weight = np.concatenate([half[k] for k in self.span])
            v, w = [], np.stack(columns, 1)
            w = _times(w.T, fine_weight[:, None] * w)
            for x in columns:
                x = fine_weight * x
                if self.top is not None:
                    down, at = self._down(x[self.top]), 0
                    for s in self.core:
                        x[s] = down[at : (at := at + s.stop - s.start)]
                v.append(x)
            k = np.stack([self._plain(x) for x in v], 1)
            self.correction = (k, _inverse(w - _times(np.stack(v), k)))

    def __call__(self, g: np.ndarray) -> np.ndarray:
        x = self._plain(g)
        if self.correction is not None:
            k, w = self.correction
            x += _times(k, _times(w, _times(k.T, g)))
        return x


class Descent:
    """Limited-memory BFGS of one fit, fed with one evaluation a step. Steps start from ``scaling``, a guess of the inverse Hessian."""

    def __init__(self, penalty: np.ndarray, scaling: Scaling):
        self.penalty, self.scaling = penalty, scaling
        self.x = self.trial = np.zeros(len(penalty))
        self.f, self.g, self.kept, self.d, self.t, self.done = np.inf, None, [], None, 1.0, False

    def feed(self, loss: float, gradient: np.ndarray) -> None:
        f, g = loss + 0.5 * (self.penalty * self.trial**2).sum(), gradient + self.penalty * self.trial
        if self.g is None or f <= self.f + 1e-4 * self.t * _times(self.g, self.d) + 1e-13 * abs(self.f):
            if self.g is not None:
                s, y = self.trial - self.x, g - self.g
                if _times(s, y) > 1e-14 * np.sqrt(_times(s, s) * _times(y, y)):
                    self.kept = [*self.kept[1 - MEMORY :], (s, y, 1 / _times(s, y))]
            self.x, self.f, self.g, self.t = self.trial, f, g, 1.0
            self.done = not len(g) or (np.abs(self.scaling(g)).max() < TOLERANCE and np.abs(g).max() < SLOPE)
            q, used = g.copy(), []
            for s, y, r in reversed(self.kept):
                used.append(a := r * _times(s, q))
                q -= a * y
            q = self.scaling(q)
            for (s, y, r), a in zip(self.kept, reversed(used), strict=True):
                q += s * (a - r * _times(y, q))
            self.d = -q
        else:
            self.t /= 2
            self.done = self.t < 1e-9  # the loss can't be told apart from the best any more
        self.trial = self.x + self.t * self.d


def solve(problem: Problem, fits: list[Fit]) -> list[np.ndarray]:
    """The coefficients of each fit, in the order of its model's blocks."""
    largest = max((problem.columns(f.model) for f in fits), default=0)
    if largest > LOT:
        raise ValueError(f"a model has {largest} coefficients; the driver takes {LOT}")
    spark, sizes = problem.blocks.sparkSession, problem.sizes
    nesting, cores, scalings = Nesting.of(problem, *_uses(problem)), {}, {}
    for f in fits:
        if (f.model, f.base, f.extra) not in scalings:
            scalings[f.model, f.base, f.extra] = Scaling(nesting, f.model, {k: f.penalty(k) for k in MODELS[f.model]}, cores)
    blocks: RDD = problem.blocks.rdd.map(lambda r: Block(*(bytes(x) if isinstance(x, (bytes, bytearray)) else x for x in r))).persist(StorageLevel.MEMORY_AND_DISK)
    found: list[np.ndarray] = []
    try:
        for lot in lots(problem, fits):
            runs = [Descent(np.concatenate([np.zeros(0), *(np.full(sizes[k], f.penalty(k)) for k in MODELS[f.model])]), scalings[f.model, f.base, f.extra]) for f in lot]
            for _ in range(PASSES):
                at = [(k, f, r.trial) for k, (f, r) in enumerate(zip(lot, runs, strict=True)) if not r.done]
                if not at:
                    break
                sent = spark.sparkContext.broadcast(at)  # below LOT
                sums = blocks.mapPartitions(lambda it, sent=sent: [_pass(it, sent.value, sizes)]).treeReduce(_added)
                sent.destroy()
                for k, v in sums.items():
                    runs[k].feed(float(v[0]), v[1:])
            else:
                raise RuntimeError(f"a fit did not converge in {PASSES} passes")
            found += [r.x for r in runs]
    finally:
        blocks.unpersist()
    return found


def lots(problem: Problem, fits: list[Fit]) -> Iterator[list[Fit]]:
    """``fits`` in order, cut where their coefficients would exceed LOT."""
    lot, held = [], 0
    for f in fits:
        n = problem.columns(f.model)
        if lot and held + n > LOT:
            yield lot
            lot, held = [], 0
        lot.append(f)
        held += n
    if lot:
        yield lot


def _uses(problem: Problem) -> tuple[dict[str, np.ndarray], set[str]]:
    """How many contests hold each key (the diagonal of the design's square), and the kinds whose signs sum to nothing in every contest."""
    sizes = problem.sizes

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(sizes[k] + 1) for k in KINDS}  # the last: contests whose signs do not cancel
        for b in batches:
            for kind, ident, row, sign in zip(*(b.column(c).to_pylist() for c in ("kind", "id", "row", "sign")), strict=True):
                kind, ident, row, sign = np.frombuffer(kind, np.int8), np.frombuffer(ident, np.int32), np.frombuffer(row, np.int32), np.frombuffer(sign, np.int8)
                for j, k in enumerate(KINDS):
                    of = kind == j
                    total[k][: sizes[k]] += np.bincount(ident[of], minlength=sizes[k])
                    total[k][sizes[k]] += np.count_nonzero(np.bincount(row[of], sign[of]))
        held = [(k, np.flatnonzero(v)) for k, v in total.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([k for k, _ in held], [len(i) for _, i in held]).astype(str), pa.string()), pa.array(np.concatenate([i for _, i in held]), pa.int64()), pa.array(np.concatenate([total[k][i] for k, i in held]))],
            names=["kind", "id", "n"],
        )

    n = problem.blocks.select("kind", "id", "row", "sign").mapInArrow(count, "kind string, id long, n double").groupBy("kind", "id").agg(F.sum("n").alias("n")).toPandas()  # as many as coefficients
    out = {k: np.zeros(v + 1) for k, v in sizes.items()}
    for k, part in n.groupby("kind"):
        out[k][part["id"]] = part["n"]
    return {k: v[:-1] for k, v in out.items()}, {k for k, v in out.items() if not v[-1]}


SCORES = "match_id long, fit int, p double, log_likelihood double, hit int"


def scores(problem: Problem, fits: list[Fit], thetas: list[np.ndarray]) -> DataFrame:
    """(match_id, fit, p, log_likelihood, hit) of every contest that a fit left out, or of all if it left out none; ``fit`` is its place in the list.

    Terms that training did not see have coefficient 0, so they say nothing. A coin (no blocks) has no hits.
    """
    spark, sizes = problem.blocks.sparkSession, problem.sizes
    names = [x.split()[0] for x in BLOCK.split(", ")]
    made, done = [], 0
    for lot in lots(problem, fits):
        at = [(done + k, f, thetas[done + k]) for k, f in enumerate(lot)]
        done += len(lot)
        sent = spark.sparkContext.broadcast(at)

        def score(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for block in (Block(*(batch.column(c)[r].as_py() for c in names)) for batch in batches for r in range(batch.num_rows)):
                terms = {m: block.terms(m, sizes) for m in {f.model for _, f, _ in sent.value}}
                for number, f, theta in sent.value:
                    row, column, sign = terms[f.model]
                    eta = np.clip(np.bincount(row, sign * theta[column], block.n), -30, 30)
                    held = np.flatnonzero(block.folds[:, f.folding] == f.fold) if f.fold >= 0 else np.arange(block.n)
                    y, p = block.labels[held, f.label], 1 / (1 + np.exp(-eta[held]))
                    hit = pa.array(((eta[held] > 0) == (y == 1)).astype(np.int32), mask=np.full(len(held), not MODELS[f.model]))
                    chance = np.log(np.maximum(np.where(y == 1, p, 1 - p), 1e-12))
                    yield pa.RecordBatch.from_arrays([pa.array(block.match_id[held]), pa.array(np.full(len(held), number, np.int32)), pa.array(p), pa.array(chance), hit], names=["match_id", "fit", "p", "log_likelihood", "hit"])

        made.append(problem.blocks.mapInArrow(score, SCORES))
    return reduce(DataFrame.unionByName, made) if made else spark.createDataFrame([], SCORES)


def coefficients(problem: Problem, model: str, theta: np.ndarray) -> DataFrame:
    """(kind, a, b, c, theta) of one fit."""
    spark, rows, at = problem.blocks.sparkSession, [], 0
    for k in MODELS[model]:
        rows += [(k, j, float(t)) for j, t in enumerate(theta[at : at + problem.sizes[k]])]
        at += problem.sizes[k]
    return problem.keys.join(spark.createDataFrame(rows, "kind string, id int, theta double"), ["kind", "id"]).select("kind", "a", "b", "c", "theta")


def grid(models: Iterable[str], base: list[float], extra: list[float], folds: int) -> tuple[list[Fit], list[tuple]]:
    """Every fold of every model under every pair of penalties, and (fit, setting, model, base, extra) of each; models without combos have no extra penalty."""
    fits, about, setting = [], [], 0
    for m in models:
        combos = set(MODELS[m]) - set(BASE_KINDS)
        for lb in base if MODELS[m] else [0.0]:
            for le in extra if combos else [0.0]:
                about += [(len(fits) + k, setting, m, lb, le) for k in range(folds)]
                fits += [Fit(m, lb, le, fold=k) for k in range(folds)]
                setting += 1
    return fits, about


def cross_validated(o: DataFrame, fold: Column, folds: int, base: list[float], extra: list[float], models: Iterable[str] = tuple(MODELS)) -> DataFrame:
    """(setting, model, base, extra, match_id, log_likelihood, hit): the held-out score of every contest under every model and pair of penalties."""
    fits, about = grid(models, base, extra, folds)
    problem = packed(o, F.array("y"), F.array(fold))
    held = scores(problem, fits, solve(problem, fits))
    names = o.sparkSession.createDataFrame(about, "fit int, setting int, model string, base double, extra double")  # a row for each fit
    return written(held.join(F.broadcast(names), "fit").drop("fit", "p"), "logit-scores")


def settings(held: DataFrame) -> DataFrame:
    """(setting, model, base, extra, contests, log_likelihood, accuracy, chosen): the best penalties of each model by held-out log-likelihood, the first of equal ones."""
    each = held.groupBy("setting", "model", "base", "extra").agg(F.count("*").alias("contests"), F.avg("log_likelihood").alias("log_likelihood"), F.avg("hit").alias("accuracy"))
    best = Window.partitionBy("model").orderBy(F.desc("log_likelihood"), "setting")
    return each.withColumn("chosen", F.row_number().over(best) == 1)


#: What each comparison of nested models measures.
COMPARED = (("champions", "M0", "M1"), ("teams", "M1", "M2"), ("pairs", "M2", "M3"), ("triples", "M3", "M4"), ("counters", "M2", "M5"), ("all", "M2", "M6"))


def compared(held: DataFrame) -> DataFrame:
    """(component, base, full, contests, gain, se, t, verdict): paired differences of held-out log-likelihood under each model's chosen penalties."""
    chosen = settings(held).where("chosen").select("setting")
    wide = held.join(F.broadcast(chosen), "setting").groupBy("match_id").pivot("model", list(MODELS)).agg(F.first("log_likelihood"))  # a row for each model
    each = wide.select(F.explode(F.array(*(F.struct(F.lit(k).alias("order"), F.lit(c).alias("component"), F.lit(b).alias("base"), F.lit(f).alias("full"), (F.col(f) - F.col(b)).alias("d")) for k, (c, b, f) in enumerate(COMPARED)))).alias("x")).select("x.*")
    return paired(each.groupBy("order", "component", "base", "full")).orderBy("order").drop("order")


def paired(groups) -> DataFrame:
    """contests, gain, se, t and verdict of the differences ``d`` of each group; t is 0 where they don't scatter."""
    out = groups.agg(F.count("*").alias("contests"), F.avg("d").alias("gain"), F.coalesce(F.stddev_samp("d") / F.sqrt(F.count("*").cast("double")), F.lit(0.0)).alias("se"))
    t = F.when(F.col("se") > 0, F.col("gain") / F.col("se")).otherwise(0.0)
    return out.withColumn("t", t).withColumn("verdict", F.when(F.col("t") > 2, "real").when(F.col("t") > -2, "none").otherwise("harmful"))
