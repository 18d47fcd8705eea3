"""Ranked lexical search by the Best Position Algorithm over impact lists.

Documents are indexed in blocks of bounded size, a stored row each: for every term of the queries the documents that hold it and how often.
Once the counts of all documents are known, a block's postings become impact lists, each sorted by falling impact. A query reads its lists in parallel from the top (sorted access);
what it meets is looked up in its other lists at once (direct access), and every position met either way is marked as seen. The best position of a list is
the last before its first unseen one. No unseen document can score more than the impacts at the best positions together, a bound that is
tighter than the one by the positions last read. Reading stops once that bound lies strictly below the kth score, since an equal
score may still win by its id. A task keeps the k best of each query over all its blocks, so later blocks stop sooner;
each task sends k rows a query to the merge, and lists and texts are never shuffled.

Queries are taken in lots of about ``LOT_CHARS`` characters, whose terms go to every task; any number of lots is served, each by one more reading of the documents.

Nulls: a null text has no terms; a document without a term is not counted. A null id is ranked after others of its score. Every row is a document, repeated rows too, and every
query row is a query. An empty table on either side gives no rows. Only the columns named are read, whatever others there are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import groups_for, stored

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
K = 10
#: Documents and postings of a block, and characters of a lot of queries.
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 14, 1 << 21
LOT_CHARS = 1 << 24
#: Positions that are read between two tests of the bound, doubled after each.
FIRST_DEPTH = 16


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(_LOWER))


BLOCK = "docs_counted long, terms_counted long, doc_ids array<long>, lengths array<int>, term array<int>, size array<int>, doc array<int>, tf array<int>"
_INTS = pa.list_(pa.int32())
_BLOCK = pa.schema([("docs_counted", pa.int64()), ("terms_counted", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((n, _INTS) for n in ("lengths", "term", "size", "doc", "tf"))])


def _block(ids: list, lengths: list[int], term: list[int], doc: list[int], tf: list[int]) -> pa.RecordBatch:
    """A block as one row: postings grouped by term; documents without a term of the queries count, but are not listed."""
    t, d, f = (np.array(x, np.int32) for x in (term, doc, tf))
    held, at = np.unique(d, return_inverse=True)
    order = np.lexsort((at, t))
    names, size = np.unique(t, return_counts=True)
    n = np.array(lengths, np.int64)
    some = np.array(lengths, np.int32)[held]
    listed = pa.array([ids[k] for k in held.tolist()], pa.int64())
    one = lambda x, kind=pa.int32(): pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind) if not isinstance(x, pa.Array) else x)
    columns = [pa.array([int((n > 0).sum())]), pa.array([int(n.sum())]), one(listed), one(some), one(names.astype(np.int32)), one(size.astype(np.int32)), one(at[order].astype(np.int32)), one(f[order])]
    return pa.RecordBatch.from_arrays(columns, schema=_BLOCK)


def _indexer(vocabulary: dict[str, int]) -> Callable:
    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, term, doc, tf = [], [], [], [], []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms(text)
                hits = Counter(map(vocabulary.get, words))
                hits.pop(None, None)
                doc.extend([len(ids)] * len(hits))
                term.extend(hits.keys())
                tf.extend(hits.values())
                ids.append(doc_id)
                lengths.append(len(words))
                if len(ids) >= BLOCK_DOCS or len(term) >= BLOCK_POSTINGS:
                    yield _block(ids, lengths, term, doc, tf)
                    ids, lengths, term, doc, tf = [], [], [], [], []
        if ids:
            yield _block(ids, lengths, term, doc, tf)

    return index


class Best:
    """The k best (score, document) so far: the highest score first, equal ones by ascending id, missing ids last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def kth(self) -> int:
        return self.rows[-1][0] if len(self.rows) == self.k else 0

    def add(self, scores: np.ndarray, ids: list) -> None:
        floor = self.kth
        new = [(s, i) for s, i in zip(scores.tolist(), ids, strict=True) if s > 0 and s >= floor]
        if new:
            self.rows = sorted(self.rows + new, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[: self.k]


class Lists:
    """Impact lists of a block of ``n_docs`` documents: positions run through all lists, one after the other."""

    def __init__(self, term: np.ndarray, size: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int):
        self.of = {t: k for k, t in enumerate(term.tolist())}
        self.first = np.r_[0, np.cumsum(size)].astype(np.int64)
        list_of = np.repeat(np.arange(len(term), dtype=np.int64), size)
        order = np.lexsort((doc, -impact, list_of))
        self.doc, self.impact = doc[order].astype(np.int64), impact[order]
        keys = list_of * n_docs + self.doc  # list_of is sorted, so it is the same in either order
        self.direct = np.argsort(keys, kind="stable")
        self.keys, self.n_docs = keys[self.direct], n_docs

    def look_up(self, lists: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Direct access: the position of each document in each list (a row a list), or -1."""
        keys = lists[:, None] * self.n_docs + docs[None, :]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.direct[at], -1)


def best_positions(lists: Lists, query: dict[int, int], best: Best, ids: list) -> int:
    """Adds to ``best`` every document of the block that may belong there. ``query``: weight of each term. Returns how many positions were read by sorted access."""
    held = [(lists.of[t], w) for t, w in query.items() if t in lists.of and w > 0]
    if not held:
        return 0
    which, weight = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)
    start, stop = lists.first[which], lists.first[which + 1]
    seen = [np.zeros(n, bool) for n in (stop - start).tolist()]
    met = np.zeros(lists.n_docs, bool)
    bound_at = np.zeros(len(which), np.int64)  # of each list: how many positions from its top are all seen
    depth, step, read = 0, FIRST_DEPTH, 0
    while True:
        now = np.concatenate([np.arange(a + depth, min(a + depth + step, b)) for a, b in zip(start.tolist(), stop.tolist(), strict=True)])
        read += len(now)
        docs = np.unique(lists.doc[now])
        docs = docs[~met[docs]]
        met[docs] = True
        at = lists.look_up(which, docs)
        scores = (np.where(at >= 0, lists.impact[at], 0) * weight[:, None]).sum(0)
        best.add(scores, [ids[k] for k in docs.tolist()])
        bound = 0
        for j, row in enumerate(at):
            flags = seen[j]
            flags[row[row >= 0] - start[j]] = True
            unseen = np.flatnonzero(~flags[bound_at[j] :])
            bound_at[j] = bound_at[j] + unseen[0] if len(unseen) else len(flags)
            if len(unseen):
                # What is unseen stands below the best position, whose impact it can't exceed; with none seen, the top of the list bounds it.
                bound += int(weight[j] * lists.impact[start[j] + bound_at[j] - (bound_at[j] > 0)])
        if bound == 0 or bound < best.kth:
            return read
        depth, step = depth + step, 2 * step
        if (start + depth >= stop).all():
            return read


def _searcher(queries: list[tuple[int, dict[int, int]]], n: int, total: int, k: int) -> Callable:
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries]
        for batch in batches:
            for r in range(batch.num_rows):
                ids, lengths, term, size, doc, tf = (batch.column(c)[r].values for c in ("doc_ids", "lengths", "term", "size", "doc", "tf"))
                term, size, doc, lengths = (x.to_numpy(zero_copy_only=False) for x in (term, size, doc, lengths))
                if not len(doc):
                    continue
                tf = tf.to_numpy(zero_copy_only=False).astype(np.int64)
                m = 25 + (75 * lengths.astype(np.int64) * n) // total
                lists = Lists(term, size, doc, (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]), len(lengths))
                names = ids.to_pylist()
                for (_, query), b in zip(queries, best, strict=True):
                    best_positions(lists, query, b, names)
        rows = [(q, i, s) for (q, _), b in zip(queries, best, strict=True) for s, i in b.rows]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["query", "doc_id", "score"])

    return search


def _lot(docs: DataFrame, lot: list[tuple], id_type: str, k: int) -> DataFrame:
    """Ranks for one lot of queries (id, text)."""
    spark = docs.sparkSession
    counted = [(item, Counter(terms(text))) for item, text in lot]
    vocabulary = {t: j for j, t in enumerate(dict.fromkeys(t for _, c in counted for t in c))}
    blocks = stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_indexer(vocabulary), BLOCK), "impact-blocks")
    n, total = blocks.agg(F.coalesce(F.sum("docs_counted"), F.lit(0)), F.coalesce(F.sum("terms_counted"), F.lit(0))).first()
    zipped = blocks.select(F.explode(F.arrays_zip("term", "size")).alias("p"))
    df = {r[0]: r[1] for r in zipped.groupBy("p.term").agg(F.sum(F.col("p.size").cast("long"))).collect()}  # no more rows than terms of the lot
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    queries = [(q, {vocabulary[t]: times * weight[vocabulary[t]] for t, times in c.items() if vocabulary[t] in weight}) for q, (_, c) in enumerate(counted)]
    found = blocks.mapInArrow(_searcher(queries, n, max(1, total), k), "query long, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(counted)], f"query long, item_id {id_type}")
    return ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")  # a row for each query of the lot


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """The ``k`` documents (doc_id, text) of the highest score above 0 for each row of ``items`` (item_id, text): item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    items = items.select("item_id", "text")
    id_type = items.schema["item_id"].dataType.simpleString()
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)) + 64 * F.count("*")).first()[0]
    lots = groups_for(chars, LOT_CHARS)
    made = []
    for j in range(lots):
        lot = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(lots)) == j).collect()]
        if lot:
            made.append(_lot(docs, lot, id_type, k))
    return reduce(DataFrame.unionByName, made) if made else spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")


SEARCH_SQL = r"""
with t as (select doc_id, rowid as r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select *, row_number() over () as rowid from documents)),
tf as (select r, any_value(doc_id) as doc_id, term, count(*) as tf from t group by r, term),
n as (select r, sum(tf)::bigint as n from tf group by r),
g as (select count(*) as big_n, sum(n)::bigint as l from n),
w as (select term, floor(1000 * ln((2 * big_n + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, g group by term, big_n),
q as (select i, any_value(item_id) as item_id, term, count(*) as times from (select item_id, row_number() over () as i, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by i, term),
s as (select i, any_value(item_id) as item_id, r, any_value(doc_id) as doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // l))))::bigint as score
  from q join w using (term) join tf using (term) join n using (r), g group by i, r),
k as (select *, row_number() over (partition by i order by score desc, doc_id nulls last) as rank from s where score > 0)
select item_id, rank::int as rank, doc_id, score from k where rank <= 10
"""
