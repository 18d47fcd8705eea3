"""ISO media containers as a column: writing raw frames, walking boxes, sample tables, keyframes.

``probe`` stores codec, duration and the byte ranges of keyframes from the sample tables alone;
no payload is decoded. ``mux`` writes bytes losslessly as 8-bit grey frames of 8 by 8 samples.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FRAME = 64
KEY_EVERY = 8
PER_CHUNK = 16
TIMESCALE = 25
#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}
_MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    n = len(body) + 8
    return struct.pack(">I4s", n, kind) + body if n < 1 << 32 else struct.pack(">I4sQ", 1, kind, n + 8) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def mux(payload: bytes) -> bytes:
    """A file with one video track whose samples are the 64-byte frames of ``payload``, every eighth a keyframe."""
    frames = len(payload) // FRAME
    if frames * FRAME != len(payload) or not frames:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    chunks = -(-frames // PER_CHUNK)
    keys = np.arange(1, frames + 1, KEY_EVERY, dtype=">u4")
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
    runs = [(1, PER_CHUNK, 1)] + ([(chunks, frames % PER_CHUNK, 1)] if frames % PER_CHUNK else [])
    if chunks == 1 and frames % PER_CHUNK:
        runs = runs[1:]

    def moov(base: int) -> bytes:
        at = base + np.arange(chunks, dtype=np.uint64) * np.uint64(PER_CHUNK * FRAME)
        wide = base + len(payload) >= 1 << 32
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, frames, 1)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", FRAME, frames)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), at.astype(">u8" if wide else ">u4").tobytes()),
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), dinf, stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, frames, 0x55C4, 0)), full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, frames), bytes(8), struct.pack(">hhhh", 0, 0, 0, 0), _MATRIX, struct.pack(">II", 8 << 16, 8 << 16), flags=3)
        mvhd = full(b"mvhd", struct.pack(">IIII", 0, 0, TIMESCALE, frames), struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    mdat_head = 8 if len(payload) + 8 < 1 << 32 else 16
    size = len(moov(0))
    size = len(moov(len(head) + size + mdat_head))
    return head + moov(len(head) + size + mdat_head) + box(b"mdat", payload)


def walk(data: bytes, start: int = 0, stop: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start of body, end) of each box, containers before what they hold. A box that overruns its parent is an error."""
    stop = len(data) if stop is None else stop
    while start < stop:
        if stop - start < 8:
            raise ValueError("a box is cut short")
        n, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if n == 1:
            if stop - start < 16:
                raise ValueError("a box is cut short")
            (n,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif n == 0:
            n = stop - start
        if n < body - start or start + n > stop:
            raise ValueError(f"box {kind!r} overruns its parent")
        yield (*path, kind), body, start + n
        if kind in CONTAINERS:
            yield from walk(data, body, start + n, (*path, kind))
        start += n


def _entries(data: bytes, body: int, end: int, kind: str, width: int, skip: int = 4) -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, body + skip)
    if body + skip + 4 + n * width * np.dtype(kind).itemsize > end:
        raise ValueError("a sample table is cut short")
    return np.frombuffer(data, kind, n * width, body + skip + 4).astype(np.int64).reshape(n, width)


def tracks(data: bytes) -> list[dict]:
    """The tracks of a file: codec, handler, timescale, duration, and offset, size, time, key of every sample."""
    found: list[dict] = []
    for path, body, end in walk(data):
        if path[-1] == b"trak":
            found.append({"codec": None, "handler": None, "timescale": 0, "duration": 0})
        if b"trak" not in path or not found:
            continue
        t, kind = found[-1], path[-1]
        if kind == b"mdhd":
            v = data[body]
            t["timescale"], t["duration"] = struct.unpack_from(">IQ" if v else ">II", data, body + (20 if v else 12))
        elif kind == b"hdlr":
            t["handler"] = data[body + 8 : body + 12].decode("latin-1")
        elif kind == b"stsd":
            t["codec"] = data[body + 12 : body + 16].decode("latin-1")
        elif kind in (b"stts", b"ctts"):
            t[kind.decode()] = _entries(data, body, end, ">u4", 2)
        elif kind == b"stss":
            t["stss"] = _entries(data, body, end, ">u4", 1)[:, 0]
        elif kind == b"stsc":
            t["stsc"] = _entries(data, body, end, ">u4", 3)
        elif kind in (b"stco", b"co64"):
            t["chunks"] = _entries(data, body, end, ">u4" if kind == b"stco" else ">u8", 1)[:, 0]
        elif kind == b"stsz":
            one, n = struct.unpack_from(">II", data, body + 4)
            t["sizes"] = np.full(n, one, np.int64) if one else _entries(data, body, end, ">u4", 1, 8)[:, 0]
    for t in found:
        sizes, chunks, runs = t.get("sizes", np.zeros(0, np.int64)), t.get("chunks", np.zeros(0, np.int64)), t.get("stsc", np.zeros((0, 3), np.int64))
        per = np.zeros(len(chunks), np.int64)
        for k, (first, n, _) in enumerate(runs):
            per[first - 1 : runs[k + 1][0] - 1 if k + 1 < len(runs) else None] = n
        if per.sum() != len(sizes):
            raise ValueError("chunks and sample sizes disagree")
        before = np.r_[0, np.cumsum(sizes)][:-1] if len(sizes) else sizes
        start = np.r_[0, np.cumsum(per)][:-1] if len(per) else per
        which = np.repeat(np.arange(len(chunks)), per)
        t["offsets"] = chunks[which] + before - before[start[which]] if len(sizes) else sizes
        stts = t.get("stts", np.zeros((0, 2), np.int64))
        t["times"] = np.r_[0, np.cumsum(np.repeat(stts[:, 1], stts[:, 0]))][: len(sizes)]
        t["keys"] = t["stss"] - 1 if "stss" in t else np.arange(len(sizes))
        t["sizes"] = sizes
    return found


def samples(data: bytes, track: dict) -> bytes:
    """The stored bytes of all samples of a track in order; neighbours are read as one run."""
    at, n = track["offsets"], track["sizes"]
    if not len(at):
        return b""
    cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + n[:-1]])
    stop = np.r_[cut[1:], len(at)] - 1
    return b"".join(data[at[a] : at[b] + n[b]] for a, b in zip(cut, stop, strict=True))


_PROBE = "codec string, timescale long, duration long, n_samples long, keyframes array<struct<offset:long,size:long>>, error string"


def probe(media: DataFrame, id_col: str, bytes_col: str) -> DataFrame:
    """Codec, duration and keyframe byte ranges of the first track of each container.

    Rows are independent: no shuffle. A null or broken container gives null fields and the reason in ``error``.
    """
    kind = media.schema[id_col].dataType.simpleString()

    def one(data: bytes | None) -> tuple:
        try:
            if data is None:
                raise ValueError("no bytes")
            t = tracks(bytes(data))[0]
            return t["codec"], t["timescale"], t["duration"], len(t["sizes"]), [{"offset": int(t["offsets"][k]), "size": int(t["sizes"][k])} for k in t["keys"]], None
        except (ValueError, IndexError, struct.error) as e:
            return None, None, None, None, None, str(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([one(x) for x in b["m"]], columns=["codec", "timescale", "duration", "n_samples", "keyframes", "error"], dtype=object)
            yield pd.concat([b[["i"]].rename(columns={"i": id_col}).reset_index(drop=True), out], axis=1)

    return media.selectExpr(f"`{id_col}` as i", f"`{bytes_col}` as m").mapInPandas(run, f"`{id_col}` {kind}, {_PROBE}")


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the UTF-8 bytes of each text, null as empty, with zero bytes up to a positive
    multiple of 64, as a container."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [(t or "").encode() for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": [len(x) for x in raw], "media": [mux(x + bytes(-len(x) % FRAME or (0 if x else FRAME))) for x in raw]})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_bytes long, media binary")


def read_features(media: DataFrame) -> DataFrame:
    """Digests of what the containers of ``store_texts`` hold, read back through their sample tables, and the byte ranges of keyframes.

    Rows are independent and repeated rows stay; an empty table gives no rows. A null text was stored as an empty one.
    """
    kind = media.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, n, data in zip(b["doc_id"], b["n_bytes"], b["media"], strict=True):
                data = bytes(data)
                t = tracks(data)[0]
                payload = samples(data, t)
                at, size = t["offsets"][t["keys"]], t["sizes"][t["keys"]]
                ranges = np.stack([at, size], 1).astype("<i8").tobytes()
                feature = f"{t['codec'].strip()}:{t['duration']}/{t['timescale']}:{len(t['keys'])} keys:{crc32(ranges):08x}"
                out.append((i, n, len(payload), sha256(payload).hexdigest(), crc32(payload[-FRAME:]), len(data), sha256(data).hexdigest(), feature, at, size))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "key_offsets", "key_sizes"])

    return media.mapInPandas(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, key_offsets array<long>, key_sizes array<long>")
