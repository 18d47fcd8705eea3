"""Vector bin packing of training examples into sequences.

Every sequence has three limits at once: tokens, segments and loss-bearing tokens. Pieces are dealt
to groups of bounded size at random; each group fills one sequence at a time and always
takes the fitting piece whose demand vector has the largest dot product with what the sequence has
left (each dimension weighted by its mean demand). Pieces with equal vectors are one class, so a
step looks at classes and not at pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, groups_for, stored
from .tokens import default_path, library_encoder

LIMITS = (1024, 256, 1024)
PIECES_PER_GROUP = 16_384


def fill(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, by the dot-product heuristic; every piece must fit alone."""
    n = len(tokens)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return sequence, offset
    cap = np.array(limits, float)
    if (tokens > limits[0]).any() or (loss > limits[2]).any() or limits[1] < 1:
        raise ValueError("a piece exceeds the limits of a sequence")
    alone = np.flatnonzero(tokens == limits[0])
    sequence[alone] = np.arange(len(alone))
    rest = np.flatnonzero(tokens != limits[0])
    rest = rest[np.lexsort((rest, loss[rest], tokens[rest]))]
    pairs = np.stack([tokens[rest], loss[rest]], 1)
    first = np.flatnonzero(np.r_[True, (pairs[1:] != pairs[:-1]).any(1)]) if len(rest) else np.zeros(0, int)
    stop = np.r_[first[1:], len(rest)]
    demand = np.stack([pairs[first, 0], np.ones(len(first)), pairs[first, 1]], 1).astype(float)
    left = (stop - first).astype(np.int64)
    share = demand / cap
    weight = (share * left[:, None]).sum(0) / max(1, left.sum())
    at, now = len(alone), first.copy()
    remaining = int(left.sum())
    while remaining:
        free, start = cap.copy(), 0
        while True:
            fits = (left > 0) & (demand <= free).all(1)
            if not fits.any():
                break
            k = int(np.where(fits, share @ (weight * free / cap), -1.0).argmax())
            piece = rest[now[k]]
            sequence[piece], offset[piece] = at, start
            now[k] += 1
            left[k] -= 1
            remaining -= 1
            start += int(demand[k, 0])
            free -= demand[k]
        at += 1
    return sequence, offset


def pack(pieces: DataFrame, tokens: str, loss: str, limits: tuple[int, int, int] = LIMITS) -> DataFrame:
    """Adds sequence_id and offset (longs) to rows of at most ``limits`` each.

    Rows are numbered and stored, and dealt by a hash of their numbers to groups of about PIECES_PER_GROUP rows, as a group is what
    one task holds; equal rows go to different groups like any others. Columns of ``pieces`` may have any name but those two.
    """
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    number, group = fresh("number", pieces.columns), fresh("group", pieces.columns)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(number, ignore_index=True).drop(columns=[group, number])
        sequence, offset = fill(rows[tokens].to_numpy(np.int64), rows[loss].to_numpy(np.int64), limits)
        return rows.assign(sequence_id=(int(key[0]) << 32) + sequence, offset=offset)

    numbered = stored(pieces.withColumn(number, F.monotonically_increasing_id()), "pieces")
    groups = groups_for(numbered.count(), PIECES_PER_GROUP)
    return numbered.withColumn(group, F.pmod(F.xxhash64(number), F.lit(groups))).groupBy(group).applyInPandas(run, schema)


def cut_documents(docs: DataFrame, path: str, length: int, end_id: int = 0) -> DataFrame:
    """Token pieces of whole documents: ids by the tokenizer, then the end id, cut every ``length`` ids.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens. Null text is empty: one end id.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = library_encoder(path)
        for b in batches:
            out: list[tuple] = []
            for i, ids in zip(b["doc_id"], encoder.many([*b["text"]]), strict=True):
                ids += end
                n = len(ids) // 4
                out += [(i, s, min(length, n - s), crc32(ids[4 * s : 4 * (s + length)]), n) for s in range(0, n, length)]
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack_documents(docs: DataFrame, path: str | None = None, limits: tuple[int, int, int] = LIMITS) -> DataFrame:
    """Sequences of whole documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    All tokens of a document bear loss. An empty table gives no rows. Rows with the same doc_id are
    packed as documents of their own.
    """
    cut = cut_documents(docs, path or default_path(), min(limits[0], limits[2]))
    return pack(cut, "length", "length", limits)
