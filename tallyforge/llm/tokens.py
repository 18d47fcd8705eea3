"""Cutting text where a byte-level BPE pre-splitter always cuts, and encoding with a cache of pieces."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of the pre-splitter (Unicode White_Space); Python's own class has four more.
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
_PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_RARE = [c for c in SPACE if c not in " \n"] + ["\0", "  ", " \n", "\n ", "\n\n"]
#: A piece with no white space but one leading blank; between line breaks it is cut and encoded as it is alone.
_PLAIN = re.compile(f" ?[^{SPACE}]+")
CACHE_PIECES = 800_000
LOT_CHARS = 6_000_000
JOINED = 2048


def pieces(text: str) -> list[str]:
    """Pieces whose encodings concatenate to the encoding of ``text``.

    The pre-splitter has no look-behind and no match of it runs from a non-space into white space,
    so every cut before a run of white space is one that it makes itself; a lone line break
    before a non-space is a match of its own. Texts with only single blanks and line breaks are
    cut by plain string splitting.
    """
    if any(c in text for c in _RARE):
        return _PIECE.findall(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


Encoded = tuple[list[str], np.ndarray, np.ndarray]


class CachedEncoder:
    """ids of whole texts as little-endian unsigned 32-bit bytes; each new piece is encoded once.

    ``encode`` maps a list of pieces to the pieces in any order, their ids in a row, and how many each has. Texts are cut and their pieces numbered by Arrow, so a lot of
    texts costs one look-up for each distinct piece. At ``limit`` pieces the half that was not used for longest
    is forgotten, so memory is bounded. Special tokens found in a text become their own ids.
    """

    def __init__(self, encode: Callable[[list[str]], Encoded], special: dict[str, int], limit: int = CACHE_PIECES):
        self.encode, self.special, self.limit = encode, special, limit
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.slot: dict[str, int] = {}  # of each piece: its place in first, size and used
        self.first, self.size, self.used = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self.ids, self.filled, self.now = np.zeros(1 << 14, np.uint32), 0, 0
        self._add(["", *special], np.array([*special.values()], np.uint32), np.array([0, *(1 for _ in special)]))

    def _add(self, new: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        n = len(self.slot)
        while n + len(new) > len(self.first):
            self.first, self.size, self.used = (np.r_[x, np.zeros_like(x)] for x in (self.first, self.size, self.used))
        while self.filled + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros(len(self.ids) + 1, np.uint32)]
        at = slice(n, n + len(new))
        self.size[at], self.used[at] = size, self.now
        self.first[at] = self.filled + np.cumsum(size) - size
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.filled += len(ids)
        self.slot.update(zip(new, range(n, n + len(new)), strict=True))

    def _forget(self) -> None:
        """Keep the special tokens and the half of the other pieces that was used last."""
        n = len(self.slot)
        keep = self.used[:n] > np.median(self.used[:n])
        keep[: 1 + len(self.special)] = True
        kept = [p for p, k in zip(self.slot, keep.tolist(), strict=True) if k]
        first, size = self.first[:n][keep], self.size[:n][keep]
        ids = self.ids[_runs(first, size)]
        self.slot, self.filled = dict(zip(kept, range(len(kept)), strict=True)), len(ids)
        self.ids, self.first, self.size, self.used = ids, np.cumsum(size) - size, size, self.used[:n][keep]

    def _cut(self, text: str) -> list[str]:
        if self.split is None or not any(k in text for k in self.special):
            return pieces(text)
        return [p for x in self.split.split(text) for p in ([x] if x in self.special else pieces(x))]

    def many(self, texts: list[str | None]) -> Iterator[bytes]:
        """ids of each text in order; texts are cut in lots of about LOT_CHARS characters."""
        lot: list[str] = []
        chars = 0
        for t in texts:
            lot.append(t or "")
            chars += len(t or "")
            if chars >= LOT_CHARS:
                yield from self._lot(lot)
                lot, chars = [], 0
        yield from self._lot(lot)

    def _lot(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        odd = [any(c in t for c in _RARE) or any(k in t for k in self.special) for t in texts]
        # Texts with only single blanks and line breaks are cut as ``pieces`` does it.
        plain = pc.split_pattern(pa.array([t.replace(" ", "\0 ").replace("\n", "\0\n\0") for t, o in zip(texts, odd, strict=True) if not o], pa.large_string()), "\0")
        cut = [self._cut(t) for t, o in zip(texts, odd, strict=True) if o]
        each = pa.chunked_array([plain.flatten(), pa.array([p for x in cut for p in x], pa.large_string())]).combine_chunks().dictionary_encode()
        if len(self.slot) > self.limit:
            self._forget()
        names = each.dictionary.to_pylist()
        slots = np.fromiter(map(self.slot.get, names, repeat(-1)), np.int64, len(names))
        missed = np.flatnonzero(slots < 0)
        if len(missed):
            new = [names[k] for k in missed.tolist()]
            self._add(*self.encode(new))
            slots[missed] = [*map(self.slot.__getitem__, new)]
        self.now += 1
        self.used[slots] = self.now
        of = slots[each.indices.to_numpy()]
        size = self.size[of]
        raw = self.ids[_runs(self.first[of], size)].astype("<u4", copy=False).tobytes()
        end = np.r_[0, np.cumsum(size)]
        counts = np.zeros(len(texts), np.int64)
        is_odd = np.array(odd)
        counts[~is_odd], counts[is_odd] = pc.list_value_length(plain).to_numpy(zero_copy_only=False), [*map(len, cut)]
        order = np.r_[np.flatnonzero(~is_odd), np.flatnonzero(is_odd)]
        edge = 4 * end[np.r_[0, np.cumsum(counts[order])]]
        out = [b""] * len(texts)
        for k, a, b in zip(order.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            out[k] = raw[a:b]
        return out

    def ids_of(self, text: str | None) -> bytes:
        return next(self.many([text]))


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices first, first + 1, ... of each run, one run after the other."""
    at = np.repeat(first - (np.cumsum(size) - size), size)
    at += np.arange(len(at))
    return at


@lru_cache(maxsize=2)
def library_encoder(path: str) -> CachedEncoder:
    """An encoder backed by the tokenizers library, one per worker process and file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    special = {x.content: i for i, x in t.get_added_tokens_decoder().items()}
    wide = np.zeros(1 + max(t.get_vocab(with_added_tokens=True).values()), np.int64)  # bytes of a token: its stand-in has a character for each
    for token, i in t.get_vocab(with_added_tokens=False).items():
        wide[i] = len(token)

    def each(part: list[str]) -> Encoded:
        ids = [x.ids for x in t.encode_batch_fast(part, add_special_tokens=False)]
        return part, np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def joined(part: list[str]) -> Encoded:
        """Plain pieces in one call, a line break after each, which is then a token of its own."""
        text = "\n".join(part) + "\n"
        ids = np.array(t.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        end = np.cumsum(wide[ids])
        stop = np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 10) + 1
        last = np.searchsorted(end, stop)
        if not len(ids) or len(stop) != len(part) or end[-1] != stop[-1] or (end[last] != stop).any() or (wide[ids[last]] != 1).any():
            return each(part)
        return part, np.delete(ids, last), np.diff(last, prepend=-1) - 1

    def encode(new: list[str]) -> Encoded:
        text = "\n".join(new)
        if all(p not in (" ", "\n", "") for p in new) and not any(c in text for c in SPACE if c not in " \n") and text.count("\n") == len(new) - 1 and text.count(" ") == sum(p[0] == " " for p in new):
            plain = [True] * len(new)
        else:
            plain = [bool(_PLAIN.fullmatch(p)) for p in new]
        one, rest = [*compress(new, plain)], [p for p, x in zip(new, plain, strict=True) if not x]
        made = [joined(one[k : k + JOINED]) for k in range(0, len(one), JOINED)] + ([each(rest)] if rest else [])
        return [p for m in made for p in m[0]], np.concatenate([m[1] for m in made]), np.concatenate([m[2] for m in made])

    return CachedEncoder(encode, special)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
