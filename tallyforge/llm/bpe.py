"""Byte-level BPE by a deterministic automaton compiled from the merges.

The automaton starts with one state that loops on every byte. The merges are then applied in order,
each by a gadget: for merge (u, v) the state reached by u is split off and loses its arc v, and every
state that has an arc u (and whose u-state had v) gets an arc uv to the state reached by v. In
that construction all arcs with the same label end in the same state, so a state is named by the last
label, a copied state differs from its origin by one dropped arc, and a new arc follows the arc it
extends. ``MergeAutomaton`` stores exactly that: origin state, extended arc and time of each gadget,
and the dropped arcs; a transition is looked up by following them back, and kept in a table.

Exactly one path of the automaton spells a word, and it is the word's encoding.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import CACHE_PIECES, CachedEncoder, default_path

START = -1


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others follow from code point 256 in byte order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        symbol = byte_symbols()
        size = max([*vocab.values(), *special.values()]) + 1
        self.special = special
        self.labels: list[bytes] = [b""] * size
        for token, i in vocab.items():
            if token not in special:
                self.labels[i] = bytes(symbol[c] for c in token)
        for token, i in special.items():
            self.labels[i] = token.encode()
        self.origin, self.extends, self.time = [-1] * size, [-1] * size, [0] * size
        self.dropped: dict[tuple[int, int], int] = {}
        for when, (u, v) in enumerate(merges, 1):
            self._gadget(vocab[u], vocab[v], vocab[u + v], when)
        self.trie: dict = {}
        for token, i in vocab.items():
            if token not in special and (self.time[i] or len(self.labels[i]) == 1):
                node = self.trie
                for b in self.labels[i]:
                    node = node.setdefault(b, {})
                node[-1] = i
        self.table: dict[int, bool] = {}

    def _gadget(self, u: int, v: int, uv: int, when: int) -> None:
        self.dropped[u, v] = when  # the split-off state after u has no arc v from now on
        self.extends[uv] = u  # states with arc u get arc uv ...
        self.origin[uv] = v  # ... which ends where v ended until now
        self.time[uv] = when

    def arc(self, state: int, label: int) -> bool:
        """Whether the compiled automaton has this transition (it then ends in state ``label``)."""
        if state == START:
            return True
        key = state << 32 | label
        known = self.table.get(key)
        if known is None:
            if len(self.table) > 2_000_000:
                self.table.clear()
            known = self.table[key] = self._follow(state, label)
        return known

    def _follow(self, p: int, t: int) -> bool:
        limit = 1 << 60
        while True:
            when = self.dropped.get((p, t))
            if when is not None and 2 * when < limit:
                return False
            if self.time[p] > self.time[t]:  # the state is newer: go to what it was copied from, before its gadget's drop
                limit, p = 2 * self.time[p], self.origin[p]
            elif self.time[t]:  # the arc is newer: go to the arc it extends, after its gadget's drop
                limit, t = 2 * self.time[t] + 1, self.extends[t]
            else:
                return True

    def encode_word(self, word: bytes) -> list[int]:
        """The labels of the one path that spells ``word``: depth first, longest label first. A prefix has one path
        only, so a place once left is never reached again and the walk is linear in the length."""
        n, trie, arc, labels = len(word), self.trie, self.arc, self.labels
        path: list[int] = []
        options: list[list[int]] = []
        i, p = 0, START
        while i < n:
            node, found = trie, []
            for j in range(i, n):
                node = node.get(word[j])
                if node is None:
                    break
                t = node.get(-1)
                if t is not None:
                    found.append(t)
            while True:
                while found and not arc(p, found[-1]):
                    found.pop()
                if found:
                    break
                found = options.pop()
                i -= len(labels[path.pop()])
                p = path[-1] if path else START
            p = found.pop()
            path.append(p)
            options.append(found)
            i += len(labels[p])
        return path

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def compiled(path: str) -> tuple[MergeAutomaton, CachedEncoder]:
    """The automaton of a tokenizers file and its encoder, one per worker process."""
    import regex
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    machine = MergeAutomaton(spec["model"]["vocab"], merges, special)
    words = regex.compile(PATTERN)
    known: dict[str, list[int]] = {}

    def encode(new: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        if len(known) > CACHE_PIECES:
            known.clear()
        ids: list[int] = []
        size = []
        for piece in new:
            before = len(ids)
            for w in words.findall(piece):
                path = known.get(w)
                if path is None:
                    path = known[w] = machine.encode_word(w.encode())
                ids += path
            size.append(len(ids) - before)
        return new, np.array(ids, np.uint32), np.array(size, np.int64)

    return machine, CachedEncoder(encode, special)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary little-endian unsigned 32-bit, decoded string) per row. Null text: no ids, ''.

    Rows are independent: no shuffle. Repeated rows give repeated results; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, encoder = compiled(path)
        for b in batches:
            # Small frames, so that ids and decoded texts of few documents are held at once.
            for part in np.array_split(np.arange(len(b)), -(-len(b) // 500)):
                rows = b.iloc[part]
                ids = [*encoder.many([*rows["t"]])]
                decoded = [machine.decode(np.frombuffer(x, "<u4")).decode("utf-8", "replace") for x in ids]
                yield pd.DataFrame({id_col: rows["i"].to_numpy(), "ids": ids, "decoded": decoded})

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInPandas(run, f"{id_col} {kind}, ids binary, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The digests of ``encode_documents`` per document: n_tokens, ids_sha256, decoded_sha256."""
    path = path or default_path()
    return encode_documents(docs, path).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    )
