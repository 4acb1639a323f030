"""ISO media containers as a column: boxes walked, sample tables decoded, payloads never decoded.

The writer stores a payload of 8-bit samples as a track of raw 24 x 24 frames (576 bytes each). The
walker takes any container of this family: it descends through nested boxes with 32-bit, 64-bit and
open-ended sizes, decodes stts, stsc, stsz, stco, co64 and stss, and the runs of movie fragments
(trex, tfhd, trun), and gives codec, duration and the byte ranges of keyframes of every track.

Defined results: a null text is an empty one, stored as one frame of padding; null, empty or broken
containers give no tracks and an error instead of a failure; a track without samples has none; samples
of a track come in the order of their tables, then of the fragments; texts and containers of any length
are taken whole; an empty table gives an empty one; repeated rows get equal results; media_columns()
keeps other columns, the query ignores them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import beside, free, map_rows, plain
from .common import table

FRAME, SIDE, RATE = 576, 24, 25
#: Frames of a chunk; its first one is marked as a sync sample.
GROUP = 12
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta"}


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


MATRIX = struct.pack(">9i", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)


def write(payload: bytes) -> bytes:
    """A container with one video track of uncompressed frames; the payload is a positive multiple of FRAME."""
    n = len(payload) // FRAME
    chunks, rest = -(-n // GROUP), n % GROUP
    runs = [(1, GROUP, 1)] if n >= GROUP else []
    if rest:
        runs.append((chunks, rest, 1))
    entry = struct.pack(">6xH16xHHIII H32xHh", 1, SIDE, SIDE, 72 << 16, 72 << 16, 0, 1, 8, -1)
    wide = len(payload) > 1 << 31

    def moov(first: int) -> bytes:
        at = first + np.arange(chunks, dtype=np.int64) * GROUP * FRAME
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), box(b"raw ", entry)),
            full(b"stts", struct.pack(">III", 1, n, 1)),
            full(b"stss", struct.pack(">I", chunks), (np.arange(chunks) * GROUP + 1).astype(">u4").tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), at.astype(">u8" if wide else ">u4").tobytes()),
        )
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"frames\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII8xhhhH", 0, 0, 1, 0, n, 0, 0, 0, 0), MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, n, 1 << 16, 1 << 8), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    data = box(b"mdat", payload)
    first = len(ftyp) + len(moov(0)) + len(data) - len(payload)
    return ftyp + moov(first) + data


def boxes(buf: bytes, start: int = 0, end: int | None = None):
    """(kind, start and end of the body) of each box, one level."""
    end = len(buf) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", buf, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("a box is cut short")
            size, head = struct.unpack_from(">Q", buf, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} has size {size}")
        yield kind, start + head, start + size
        start += size


def tracks(buf: bytes) -> list[dict[bytes, tuple[int, int]]]:
    """For each track the bodies of the boxes within it, however deep, in the order of the tracks."""
    out: list[dict] = []
    level = [(0, len(buf), None)]
    while level:
        a, b, track = level.pop()
        for kind, x, y in boxes(buf, a, b):
            own = track
            if kind == b"trak":
                own = {}
                out.append(own)
            if kind in NESTED:
                level.append((x, y, own))
            elif track is not None:
                track.setdefault(kind, (x, y))
    return out


def _optional(buf: bytes, at: int, flags: int, kinds: tuple[tuple[int, str], ...]) -> tuple[dict[int, int], int]:
    """The fields that the flags say are there, by their flag, and the place after them."""
    out = {}
    for bit, kind in kinds:
        if flags & bit:
            out[bit] = struct.unpack_from(kind, buf, at)[0]
            at += struct.calcsize(kind)
    return out, at


def fragments(buf: bytes) -> dict[int, list[np.ndarray]]:
    """For each track id the samples of its fragments: rows of offset, size, duration and whether it is a sync sample."""
    defaults, out, at = {}, {}, 0
    for kind, x, y in boxes(buf):
        if kind == b"moov":
            for k, a, b in boxes(buf, x, y):
                if k == b"mvex":
                    for k2, c, _ in boxes(buf, a, b):
                        if k2 == b"trex":
                            track, _, *own = struct.unpack_from(">5I", buf, c + 4)
                            defaults[track] = own
        elif kind == b"moof":
            end = at  # of what the fragment's runs have named so far
            for k, a, b in boxes(buf, x, y):
                if k == b"traf":
                    track, rows, end = _run(buf, a, b, at, end, defaults)
                    out.setdefault(track, []).append(rows)
        at = y
    return out


def _run(buf: bytes, a: int, b: int, moof: int, end: int, defaults: dict) -> tuple[int, np.ndarray, int]:
    """The samples of one track's part of a fragment: track id, rows, and where they end."""
    inner = list(boxes(buf, a, b))
    head = next(x for k, x, _ in inner if k == b"tfhd")
    flags, track = struct.unpack_from(">II", buf, head)
    own, _ = _optional(buf, head + 8, flags & 0xFFFFFF, ((1, ">Q"), (2, ">I"), (8, ">I"), (16, ">I"), (32, ">I")))
    base = own.get(1, moof if flags & 0x20000 else end)
    duration, size, marks = (own.get(bit, x) for bit, x in zip((8, 16, 32), defaults.get(track, (0, 0, 0))))
    at, rows = base, [np.zeros((0, 4), np.int64)]
    for kind, x, y in inner:
        if kind != b"trun":
            continue
        flags, n = struct.unpack_from(">II", buf, x)
        lead, x = _optional(buf, x + 8, flags, ((1, ">i"), (4, ">I")))
        fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
        if x + 4 * n * len(fields) > y:
            raise ValueError("a run is cut short")
        if not fields and not size and n:
            raise ValueError("a run names no sizes")
        if n * max(size, 1) > len(buf) and 0x200 not in fields:
            raise ValueError("samples lie outside")
        table = dict(zip(fields, np.frombuffer(buf, ">u4", n * len(fields), x).astype(np.int64).reshape(n, len(fields)).T))
        sizes = table.get(0x200, np.full(n, size, np.int64))
        kinds = table.get(0x400, np.full(n, marks, np.int64)).copy()
        if 4 in lead and n:
            kinds[0] = lead[4]
        at = base + lead[1] if 1 in lead else at
        offset = at + np.concatenate([[0], np.cumsum(sizes)])
        at = int(offset[-1])
        rows.append(np.stack([offset[:-1], sizes, table.get(0x100, np.full(n, duration, np.int64)), kinds >> 16 & 1 ^ 1], 1))
    return track, np.concatenate(rows), at


def _numbers(buf: bytes, at: tuple[int, int], kind: str, columns: int = 1) -> np.ndarray:
    """The rows of a table box after its version, flags and count."""
    n = struct.unpack_from(">I", buf, at[0] + 4)[0]
    item = np.dtype(kind).itemsize * columns
    if at[0] + 8 + n * item > at[1]:
        raise ValueError("a table is cut short")
    return np.frombuffer(buf, kind, n * columns, at[0] + 8).astype(np.int64).reshape(n, columns)


def sample_table(buf: bytes, t: dict, more: dict[int, list[np.ndarray]] | None = None) -> dict:
    """id, codec, timescale, duration, and for each sample its offset, size and whether it is a sync sample; more are the samples of fragments."""
    version = buf[t[b"mdhd"][0]]
    scale, duration = struct.unpack_from(">IQ" if version == 1 else ">II", buf, t[b"mdhd"][0] + (20 if version == 1 else 12))
    track = struct.unpack_from(">I", buf, t[b"tkhd"][0] + (20 if buf[t[b"tkhd"][0]] == 1 else 12))[0] if b"tkhd" in t else None
    codec = "+".join(k.decode("latin-1") for k, _, _ in boxes(buf, t[b"stsd"][0] + 8, t[b"stsd"][1]))
    same, n = struct.unpack_from(">II", buf, t[b"stsz"][0] + 4)
    if same:
        if n * same > len(buf):
            raise ValueError("samples lie outside")
        sizes = np.full(n, same, np.int64)
    else:
        if t[b"stsz"][0] + 12 + 4 * n > t[b"stsz"][1]:
            raise ValueError("a table is cut short")
        sizes = np.frombuffer(buf, ">u4", n, t[b"stsz"][0] + 12).astype(np.int64)
    chunk = _numbers(buf, t[b"co64"], ">u8")[:, 0] if b"co64" in t else _numbers(buf, t[b"stco"], ">u4")[:, 0]
    runs = _numbers(buf, t[b"stsc"], ">u4", 3)
    if len(runs) and (runs[0, 0] != 1 or (np.diff(runs[:, 0]) < 1).any() or runs[-1, 0] > len(chunk) or runs[:, 1].max() > n):
        raise ValueError("chunks and samples differ")
    per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0] - 1, len(chunk))))
    if len(per) != len(chunk) or per.sum() != n:
        raise ValueError("chunks and samples differ")
    first = np.cumsum(per) - per  # sample number at each chunk's start
    total = np.concatenate([[0], np.cumsum(sizes)])
    offset = np.repeat(chunk - total[first], per) + total[:-1]
    sync = np.ones(n, bool)
    if b"stss" in t:
        keys = _numbers(buf, t[b"stss"], ">u4")[:, 0]
        if len(keys) and (keys.min() < 1 or keys.max() > n):
            raise ValueError("a sync sample doesn't exist")
        sync[:] = False
        sync[keys - 1] = True
    steps = _numbers(buf, t[b"stts"], ">u4", 2)
    ticks = int((steps[:, 0] * steps[:, 1]).sum())
    for rows in (more or {}).get(track, ()):
        offset, sizes, sync = np.append(offset, rows[:, 0]), np.append(sizes, rows[:, 1]), np.append(sync, rows[:, 3] == 1)
        ticks += int(rows[:, 2].sum())
    if len(offset) and (offset.min() < 0 or (offset + sizes).max() > len(buf)):
        raise ValueError("samples lie outside")
    return {"id": track, "codec": codec, "timescale": scale, "duration": duration or ticks, "ticks": ticks, "offset": offset, "size": sizes, "sync": sync}


def read_back(buf: bytes, s: dict) -> bytes:
    """The samples' bytes in order; neighbours are taken together."""
    end = s["offset"] + s["size"]
    cut = np.flatnonzero(s["offset"][1:] != end[:-1]) + 1
    starts, ends = s["offset"][np.r_[0, cut]], end[np.r_[cut - 1, len(end) - 1]]
    return b"".join(buf[a:b] for a, b in zip(starts.tolist(), ends.tolist()))


SUMMARY = "tracks array<struct<track: bigint, codec: string, timescale: bigint, duration: bigint, n_samples: bigint, keyframes: array<struct<offset: bigint, size: bigint>>>>, error string"


def summary(buf: bytes | None) -> list:
    """[tracks, error] of a container, as SUMMARY has them."""
    try:
        out, more = [], fragments(buf or b"")
        for t in tracks(buf or b""):
            s = sample_table(buf, t, more)
            k = np.flatnonzero(s["sync"])
            keys = [{"offset": a, "size": b} for a, b in zip(s["offset"][k].tolist(), s["size"][k].tolist())]
            out.append({"track": s["id"], "codec": s["codec"], "timescale": s["timescale"], "duration": s["duration"], "n_samples": len(s["size"]), "keyframes": keys})
        if not out:
            raise ValueError("no tracks")
        return [out, None]
    except (ValueError, KeyError, IndexError, struct.error, StopIteration) as e:
        return [[], f"{type(e).__name__}: {e}"]


def media_columns(df: DataFrame, content: str = "media") -> DataFrame:
    """df without the container, with the columns of SUMMARY: all its tracks, or an error."""
    out = beside(df, [content], lambda: lambda cols: list(map(list, zip(*map(summary, cols[content])))), SUMMARY, (content,))
    kept = [(a, b) for a, b in zip(plain(df.columns), df.columns) if b != content]
    names, new = [], ["tracks", "error"]
    for _, b in kept:
        names.append(free(b, names + new))
    return out.select(*[a for a, _ in kept], *new).toDF(*names, *new)


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the text as a container."""

    def f(cols):
        raw = [(t or "").encode() for t in cols["text"]]
        return [cols["doc_id"], list(map(len, raw)), [write(padded(r)) for r in raw]]

    return map_rows(docs.select("doc_id", "text"), lambda: f, "doc_id bigint, n_bytes bigint, media binary")


def op7_media_boxes(spark, sf_dir: str) -> DataFrame:
    def row(media: bytes) -> tuple:
        s = sample_table(media, tracks(media)[0])
        p = read_back(media, s)
        keys = np.flatnonzero(s["sync"])
        ranges = np.stack([s["offset"][keys], s["size"][keys]], 1)
        feature = f"{s['codec'].strip()};{s['duration']}/{s['timescale']};samples={len(s['size'])};keyframes={len(keys)};first={ranges[0, 0]}+{ranges[0, 1]};last={ranges[-1, 0]}+{ranges[-1, 1]};ranges={zlib.crc32(ranges.astype('<i8').tobytes()):08x}"
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return len(p), sha(p), zlib.crc32(p[-32:]), len(media), sha(media), feature, [{"offset": a, "size": b} for a, b in ranges.tolist()]

    def f(cols):
        return [cols["doc_id"], cols["n_bytes"], *map(list, zip(*map(row, cols["media"])))]

    kinds = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, keyframes array<struct<offset: bigint, size: bigint>>"
    return map_rows(stored(table(spark, sf_dir, "documents")), lambda: f, kinds).select(F.col("*"))
