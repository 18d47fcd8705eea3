"""Token ids as compressed binary blocks: an adaptive context-mixing range coder.

A block holds up to BLOCK_IDS consecutive ids of whole or cut documents, starts from a fresh model and has
its own checksums, so each can be read alone. Models of order 2 and 1 remember for each context the id
that followed it and how sure that is; order 0 knows the id that the block has had most often. The highest order that is
sure predicts the next id. Whether it is right is one binary decision, whose probability mixes what each of the three orders
and the recent hits say (logistic mixing with integer weights that learn). A missed id is coded as two bytes
by adaptive frequencies; ids from 65535 on follow an escape as four plain bytes. All blocks of a batch advance
together, one array lane each.

Block layout, little-endian: magic, ids u32, documents u32, words u32, crc32 of the ids u32, crc32 of
the rest u32; per document its number in the part u64, id i64 with a null flag u8, ids u32; then 16-bit words of
the coder. Blocks are rows of a Parquet table, since tasks reach a cluster's store through Spark's writers only.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import groups_for, stored
from .tokens import default_path, library_encoder

MAGIC = b"TFCM"
BLOCK_IDS = 8192
LANES = 512
DOCS_PER_PART = 8192
_HEAD = struct.Struct("<4sIIIII")
_DOC = np.dtype([("number", "<u8"), ("doc_id", "<i8"), ("null", "u1"), ("n", "<u4")])
_SLOTS1, _SLOTS2 = 2048, 4096
_REBUILD = 512
_TOTAL_BITS = 13
#: Ids from here on are coded as this one, and then plainly.
_ESCAPE = 65535
_U = np.uint64
_stretch = np.round(256 * np.log((np.arange(4096) + 0.5) / (4095.5 - np.arange(4096)))).astype(np.int64).clip(-2047, 2047)
_squash = np.round(4096 / (1 + np.exp(-np.arange(-2048, 2048) / 256))).astype(np.int64).clip(1, 4095)


class Model:
    """The state of all lanes, in flat arrays. Lanes are ordered by falling length, so the first n are those still running."""

    def __init__(self, lanes: int):
        self.lane = np.arange(lanes)
        self.base = [self.lane * s for s in (_SLOTS1, _SLOTS2)]
        self.guess = [np.zeros(lanes * s, np.uint32) for s in (_SLOTS1, _SLOTS2)]
        self.sure = [np.zeros(lanes * s, np.int8) for s in (_SLOTS1, _SLOTS2)]
        self.seen, self.most, self.often = np.zeros(lanes * _SLOTS1, np.int16), np.zeros(lanes, np.int64), np.zeros(lanes, np.int16)
        self.right0 = np.zeros(lanes, np.int64)
        self.last = np.zeros((2, lanes), np.int64)
        self.hits = np.zeros(lanes, np.int64)
        self.chance = [np.full(lanes * 16, 512, np.int64) for _ in range(4)]
        self.cells = self.lane * 16
        self.weight = np.full((4, lanes), 17000, np.int64)
        self.count = [np.ones((lanes, 256), np.int64) for _ in range(2)]
        self.rebuild()

    def rebuild(self) -> None:
        """Frequencies of the two bytes of missed ids, out of 2 ** _TOTAL_BITS, and the symbol of each slot."""
        self.start, self.slot = [], []
        for count in self.count:
            total = count.sum(1, keepdims=True)
            freq = 1 + count * ((1 << _TOTAL_BITS) - 256) // total
            freq[self.lane, count.argmax(1)] += (1 << _TOTAL_BITS) - freq.sum(1)
            edge = np.zeros((len(count), 257), np.int64)
            np.cumsum(freq, axis=1, out=edge[:, 1:])
            self.start.append(edge)
            self.slot.append(np.repeat(np.tile(np.arange(256, dtype=np.uint8), len(count)), freq.ravel()).reshape(len(count), -1))
            count >>= (total > 6000).astype(np.int64)
            np.maximum(count, 1, out=count)

    def predict(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(predicted id, 15-bit probability that it is right) of the first n lanes."""
        one, two = self.last[0, :n] * 40503, self.last[1, :n] * 30011
        two += one
        one >>= 4
        two >>= 4
        one &= _SLOTS1 - 1
        two &= _SLOTS2 - 1
        self.at = [self.base[0][:n] + one, self.base[1][:n] + two]
        self.said = [self.guess[o].take(self.at[o]).astype(np.int64) for o in (0, 1)]
        self.trust = [self.sure[o].take(self.at[o]).astype(np.int64) for o in (0, 1)]
        zero = self.most[:n]
        pick = np.where(self.trust[1] > 0, self.said[1], np.where(self.trust[0] > 0, self.said[0], zero))
        agree = (self.said[0] == self.said[1]).astype(np.int64) << 3
        cells = self.cells[:n]
        self.cell = [cells + self.trust[0] + agree, cells + self.trust[1] + agree, cells + self.hits[:n], cells + self.right0[:n] + ((zero == pick).astype(np.int64) << 3)]
        self.old = [self.chance[j].take(self.cell[j]) for j in range(4)]
        self.input = [_stretch.take(x) for x in self.old]
        w, x = self.weight, self.input
        dot = w[0, :n] * x[0]
        for j in range(1, 4):
            dot += w[j, :n] * x[j]
        dot >>= 16
        self.p = _squash.take(np.minimum(np.maximum(dot, -2048), 2047) + 2048)
        return pick, np.minimum(np.maximum(self.p << 3, 64), 32704)

    def learn(self, n: int, ids: np.ndarray, pick: np.ndarray) -> None:
        hit = (ids == pick).astype(np.int64)
        error, goal = (hit << 12) - self.p, hit * 4095
        for j in range(4):
            self.chance[j][self.cell[j]] = self.old[j] + ((goal - self.old[j]) >> 5)
            self.weight[j, :n] += (self.input[j] * error) >> 9
        for o in (0, 1):
            right = self.said[o] == ids
            trust = np.where(right, np.minimum(self.trust[o] + 1, 7), self.trust[o] >> 1)
            new = trust == 0
            new &= ~right
            self.sure[o][self.at[o]] = trust + new
            self.guess[o][self.at[o]] = np.where(new, ids, self.said[o])
        zero = ids == self.most[:n]
        self.right0[:n] = np.where(zero, np.minimum(self.right0[:n] + 1, 7), self.right0[:n] >> 1)
        at = self.base[0][:n] + (ids * 40503 >> 4 & _SLOTS1 - 1)
        seen = self.seen.take(at) + np.int16(1)
        self.seen[at] = seen
        more = seen > self.often[:n]
        self.often[:n] = np.where(more, seen, self.often[:n])
        self.most[:n] = np.where(more, ids, self.most[:n])
        self.hits[:n] = self.hits[:n] << 1 & 15 | hit
        self.last[1, :n] = self.last[0, :n]
        self.last[0, :n] = ids
        miss = np.flatnonzero(hit == 0)
        small = np.minimum(ids[miss], _ESCAPE)
        self.count[0][miss, small >> 8] += 24
        self.count[1][miss, small & 255] += 24


def _order(sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Lanes by falling length, and for each step how many still run."""
    lanes = np.argsort(-np.asarray(sizes), kind="stable")
    running = np.searchsorted(-np.asarray(sizes)[lanes], -np.arange(1, max(sizes, default=0) + 1), side="right")
    return lanes, running


def encode_blocks(blocks: list[np.ndarray]) -> list[np.ndarray]:
    """The 16-bit words of each block of ids (unsigned 32-bit)."""
    lanes, running = _order([*map(len, blocks)])
    if not len(running):
        return [np.zeros(0, np.uint16) for _ in blocks]
    ids = np.zeros((len(running), len(blocks)), np.uint32)
    for c, b in enumerate(lanes):
        ids[: len(blocks[b]), c] = blocks[b]
    m = Model(len(blocks))
    low, wide = np.zeros(len(blocks), np.uint64), np.full(len(blocks), (1 << 48) - 1, np.uint64)
    out, at = np.zeros((len(blocks), 5 * len(running) + 4), np.uint16), np.zeros(len(blocks), np.int64)

    def emit(k: np.ndarray) -> None:
        carried = k[low[k] >> _U(48) > 0]
        if len(carried):
            low[carried] &= _U((1 << 48) - 1)
            back, p = carried, at[carried] - 1
            while len(back):
                out[back, p] += np.uint16(1)
                over = out[back, p] == 0
                back, p = back[over], p[over] - 1
        small = k[wide[k] < _U(1 << 32)]
        out[small, at[small]] = (low[small] >> _U(32)).astype(np.uint16)
        at[small] += 1
        low[small] = (low[small] & _U(0xFFFFFFFF)) << _U(16)
        wide[small] <<= _U(16)

    for t, n in enumerate(running):
        if t and t % _REBUILD == 0:
            m.rebuild()
        now = ids[t, :n].astype(np.int64)
        pick, p = m.predict(n)
        hit = now == pick
        part = wide[:n] >> _U(15)
        cut = part * p.astype(np.uint64)
        low[:n] += np.where(hit, _U(0), cut)
        wide[:n] = np.where(hit, cut, part * _U(32768) - cut)
        emit(m.lane[:n])
        miss = np.flatnonzero(~hit)
        if len(miss):
            small = np.minimum(now[miss], _ESCAPE)
            for j, s in enumerate((small >> 8, small & 255)):
                part = wide[miss] >> _U(_TOTAL_BITS)
                a = m.start[j][miss, s].astype(np.uint64)
                low[miss] += part * a
                wide[miss] = part * (m.start[j][miss, s + 1].astype(np.uint64) - a)
                emit(miss)
            large = miss[small == _ESCAPE]
            for shift in (16, 0) if len(large) else ():
                wide[large] >>= _U(16)
                low[large] += wide[large] * ((now[large] >> shift) & 65535).astype(np.uint64)
                emit(large)
        m.learn(n, now, pick)
    for _ in range(3):
        wide[:] = 0
        emit(m.lane)
    result: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(blocks)
    for c, b in enumerate(lanes):
        result[b] = out[c, : at[c]]
    return result


def decode_blocks(words: list[np.ndarray], sizes: list[int]) -> list[np.ndarray]:
    """The ids of each block from its words and number of ids."""
    lanes, running = _order(sizes)
    if not len(running):
        return [np.zeros(0, np.int64) for _ in words]
    given = np.zeros((len(words), max(map(len, words)) + 4), np.uint16)
    for c, b in enumerate(lanes):
        given[c, : len(words[b])] = words[b]
    ids = np.zeros((len(running), len(words)), np.uint32)
    m = Model(len(words))
    head = given[:, :3].astype(np.uint64)
    code = (head[:, 0] << _U(32)) | (head[:, 1] << _U(16)) | head[:, 2]
    wide, at = np.full(len(words), (1 << 48) - 1, np.uint64), np.full(len(words), 3)

    def take(k: np.ndarray) -> None:
        small = k[wide[k] < _U(1 << 32)]
        code[small] = (code[small] << _U(16)) | given[small, at[small]].astype(np.uint64)
        at[small] += 1
        wide[small] <<= _U(16)

    for t, n in enumerate(running):
        if t and t % _REBUILD == 0:
            m.rebuild()
        pick, p = m.predict(n)
        part = wide[:n] >> _U(15)
        cut = part * p.astype(np.uint64)
        hit = code[:n] < cut
        code[:n] -= np.where(hit, _U(0), cut)
        wide[:n] = np.where(hit, cut, part * _U(32768) - cut)
        take(m.lane[:n])
        now = pick.astype(np.int64)
        miss = np.flatnonzero(~hit)
        if len(miss):
            value = np.zeros(len(miss), np.int64)
            for j in (0, 1):
                part = wide[miss] >> _U(_TOTAL_BITS)
                v = np.minimum(code[miss] // part, _U((1 << _TOTAL_BITS) - 1)).astype(np.int64)
                s = m.slot[j][miss, v].astype(np.int64)
                a = m.start[j][miss, s].astype(np.uint64)
                code[miss] -= part * a
                wide[miss] = part * (m.start[j][miss, s + 1].astype(np.uint64) - a)
                take(miss)
                value = value << 8 | s
            now[miss] = value
            large = miss[value == _ESCAPE]
            if len(large):
                now[large] = 0
            for _ in (16, 0) if len(large) else ():
                wide[large] >>= _U(16)
                v = np.minimum(code[large] // wide[large], _U(65535))
                code[large] -= wide[large] * v
                now[large] = now[large] << 16 | v.astype(np.int64)
                take(large)
        ids[t, :n] = now
        m.learn(n, now, pick)
    result: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
    for c, b in enumerate(lanes):
        result[b] = ids[: sizes[b], c].astype(np.int64)
    return result


def write_block(ids: np.ndarray, docs: np.ndarray, words: np.ndarray) -> bytes:
    body = docs.tobytes() + words.astype("<u2").tobytes()
    return _HEAD.pack(MAGIC, len(ids), len(docs), len(words), crc32(ids.astype("<u4").tobytes()), crc32(body)) + body


def open_block(block: bytes) -> tuple[int, np.ndarray, np.ndarray, int]:
    """(number of ids, documents, words, checksum of the ids); a damaged block is an error."""
    magic, n, docs, words, check, sound = _HEAD.unpack_from(block)
    if magic != MAGIC or crc32(block[_HEAD.size :]) != sound or len(block) != _HEAD.size + docs * _DOC.itemsize + 2 * words:
        raise ValueError("the block is damaged")
    return n, np.frombuffer(block, _DOC, docs, _HEAD.size), np.frombuffer(block, "<u2", words, _HEAD.size + docs * _DOC.itemsize), check


def read_blocks(blocks: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(documents, ids) of each block; ids that do not match their checksum are an error."""
    heads = [open_block(b) for b in blocks]
    out = []
    for (_, docs, _, check), ids in zip(heads, decode_blocks([h[2] for h in heads], [h[0] for h in heads]), strict=True):
        if crc32(ids.astype("<u4").tobytes()) != check:
            raise ValueError("the ids of a block do not match their checksum")
        out.append((docs, ids))
    return out


def write_documents(docs: DataFrame, path: str | None = None, end_id: int = 0) -> DataFrame:
    """The blocks (part, seq, block) of all documents in ascending doc_id order, each with ``end_id`` after its ids.

    Parts are ranges of doc_id of about DOCS_PER_PART rows, so order holds within and across parts. Null texts
    are empty; null ids come first; rows that share an id keep a place each, by text. doc_id is an integer.
    """
    path = path or default_path()
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(groups_for(docs.count(), DOCS_PER_PART), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    schema = "part int, seq int, block binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder = TaskContext.get().partitionId(), library_encoder(path)
        end = end_id.to_bytes(4, "little")
        number = seq = 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        ids, table, size = [], [], 0  # of the block that is being filled

        def close() -> None:
            nonlocal ids, table, size
            held.append((np.concatenate(ids), np.array(table, _DOC)))
            ids, table, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq
            made = [write_block(i, d, w) for (i, d), w in zip(held, encode_blocks([i for i, _ in held]), strict=True)]
            out = pa.RecordBatch.from_arrays([pa.array([part] * len(made), pa.int32()), pa.array(range(seq, seq + len(made)), pa.int32()), pa.array(made, pa.binary())], names=["part", "seq", "block"])
            seq += len(made)
            held.clear()
            return out

        for b in batches:
            keys = b.column(0).to_pylist()
            for k, raw in zip(keys, encoder.many(b.column(1).to_pylist()), strict=True):
                got = np.frombuffer(raw + end, "<u4").astype(np.int64)
                while len(got):
                    take = got[: BLOCK_IDS - size]
                    ids.append(take)
                    table.append((number, k or 0, k is None, len(take)))
                    size += len(take)
                    got = got[len(take) :]
                    if size == BLOCK_IDS:
                        close()
                number += 1
                if len(held) >= LANES:
                    yield flush()
        if size:
            close()
        if held:
            yield flush()

    return stored(ranged.mapInArrow(run, schema), "id-blocks")


def _combine(a: int, b: int, n: int) -> int:
    """crc32 of two joined byte strings from their crc32s and the length of the second: a moves over n zero bytes."""
    square = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit

    def times(m: list[int], v: int) -> int:
        x = 0
        for row in m:
            if v & 1:
                x ^= row
            v >>= 1
        return x

    bits = 8 * n
    while bits:
        if bits & 1:
            a = times(square, a)
        square = [times(square, row) for row in square]
        bits >>= 1
    return a ^ b


def read_documents(blocks: DataFrame) -> DataFrame:
    """Per document, from blocks (part, seq, block): doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows(lot: list[tuple[int, int, bytes]]) -> pd.DataFrame:
            out = []
            for (part, seq, _), (docs, ids) in zip(lot, read_blocks([x for _, _, x in lot]), strict=True):
                raw, at = ids.astype("<u4").tobytes(), 0
                for d in docs.tolist():
                    out.append((part, d[0], None if d[2] else d[1], seq, d[3], crc32(raw[at : at + 4 * d[3]])))
                    at += 4 * d[3]
            return pd.DataFrame(out, columns=["part", "number", "doc_id", "seq", "n", "crc"]).astype({"doc_id": "Int64"})

        lot: list[tuple[int, int, bytes]] = []
        for b in batches:
            for part, seq, block in zip(b["part"].tolist(), b["seq"].tolist(), b["block"], strict=True):
                lot.append((part, seq, bytes(block)))
                if len(lot) >= LANES:
                    yield rows(lot)
                    lot = []
        if lot:
            yield rows(lot)

    pieces = blocks.mapInPandas(run, "part int, number long, doc_id long, seq int, n long, crc long")

    @F.pandas_udf("long")
    def joined(parts: pd.Series) -> pd.Series:
        def one(x: list[dict]) -> int:
            crc = x[0]["crc"]
            for y in x[1:]:
                crc = _combine(crc, y["crc"], 4 * y["n"])
            return crc

        return parts.map(one)

    docs = pieces.groupBy("part", "number").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("seq", "n", "crc"))).alias("p"))
    docs = stored(docs.select("part", "number", "doc_id", "n_tokens", joined("p").alias("ids_crc32")), "read-documents")
    # One row a part: the offset of each part in the whole. Within a part, a running sum over its bounded number of documents.
    parts = docs.groupBy("part").agg(F.sum("n_tokens").alias("total")).withColumn("before", F.sum("total").over(Window.orderBy("part")) - F.col("total"))
    start = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("number")) - F.col("n_tokens")
    return docs.withColumn("inside", start).join(parts, "part").select("doc_id", (F.col("inside") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
