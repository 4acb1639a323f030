"""Raw rasters and images as files of the shared folder: a windowed reader as a Spark data source, and writers.

Files are opened by pyarrow, so any store that it knows will do. A task reads a band of rows and no more
than the window's samples of each.
"""

from __future__ import annotations

import struct
import zlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS_A_TASK = 512
PIXELS = "band int, y int, x int, dn double"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Band(InputPartition):
    def __init__(self, band: int, first: int, last: int):
        self.band, self.first, self.last = band, first, last


class RawReader(DataSourceReader):
    def __init__(self, o: dict):
        get = lambda k, d=0: int(o.get(k, d))
        self.path, self.dtype = o["path"], np.dtype(o.get("dtype", "u1"))
        self.width, self.height, self.bands = get("width"), get("height"), get("bands", 1)
        self.offset, self.prefix, self.suffix = get("offset"), get("prefix"), get("suffix")
        self.x, self.y = get("x"), get("y")
        self.w, self.h = get("w", self.width - self.x), get("h", self.height - self.y)
        if not (0 <= self.x and 0 <= self.y and 0 < self.w <= self.width - self.x and 0 < self.h <= self.height - self.y):
            raise ValueError("the window lies outside of the raster")
        self.stride = self.width * self.dtype.itemsize + self.prefix + self.suffix
        self.bytes_read = self.seeks = 0

    def partitions(self):
        return [Band(b, i, min(i + ROWS_A_TASK, self.y + self.h)) for b in range(self.bands) for i in range(self.y, self.y + self.h, ROWS_A_TASK)]

    def read(self, part: Band):
        fs, path = _open(self.path)
        with fs.open_input_file(path) as f:
            for y in range(part.first, part.last):
                f.seek(self.offset + (part.band * self.height + y) * self.stride + self.prefix + self.x * self.dtype.itemsize)
                raw = f.read(self.w * self.dtype.itemsize)
                self.seeks, self.bytes_read = self.seeks + 1, self.bytes_read + len(raw)
                if len(raw) != self.w * self.dtype.itemsize:
                    raise ValueError(f"the raster ends within row {y}")
                dn = np.frombuffer(raw, self.dtype).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(self.w, part.band, np.int32)), pa.array(np.full(self.w, y, np.int32)), pa.array(np.arange(self.x, self.x + self.w, dtype=np.int32)), pa.array(dn)], names=["band", "y", "x", "dn"])


class RawRaster(DataSource):
    """Options: path, dtype, width, height, bands, offset, prefix, suffix, and the window x, y, w, h."""

    @classmethod
    def name(cls):
        return "rawraster"

    def schema(self):
        return PIXELS

    def reader(self, schema):
        return RawReader(dict(self.options))


def read_raw(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(RawRaster)
    r = spark.read.format("rawraster").option("path", path)
    for k, v in options.items():
        r = r.option(k, str(v))
    return r.load()


# PNG, and what a file is -----------------------------------------------------------------------


def png_bytes(a: np.ndarray) -> bytes:
    """A gray 8-bit PNG."""
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + r.tobytes() for r in a.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def png_window(b: bytes, x: int = 0, y: int = 0, w: int | None = None, h: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Samples and validity of a window of an 8-bit PNG: colours are averaged, what is wholly transparent is invalid."""
    if b[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, parts, head = 8, [], None
    while at + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, at)
        if kind == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", b, at + 8)
        elif kind == b"IDAT":
            parts.append(b[at + 8 : at + 8 + n])
        at += n + 12
    width, height, bits, colour, _, _, laced = head
    count = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if bits != 8 or count is None or laced:
        raise ValueError("only plain 8-bit PNGs are read")
    w, h = w or width - x, h or height - y
    if x < 0 or y < 0 or x + w > width or y + h > height:
        raise ValueError("the window lies outside of the image")
    z, line = zlib.decompressobj(), width * count + 1
    raw = z.decompress(b"".join(parts), line * (y + h))  # rows below the window stay packed
    last, out = np.zeros(width * count, np.uint8), []
    for k in range(y + h):
        kind, v = raw[k * line], np.frombuffer(raw, np.uint8, line - 1, k * line + 1).copy()
        if kind == 1:
            v = np.cumsum(v.reshape(width, count), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            v = v + last
        elif kind in (3, 4):
            for i in range(len(v)):
                left, up, corner = (int(v[i - count]), int(last[i]), int(last[i - count])) if i >= count else (0, int(last[i]), 0)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                v[i] = (int(v[i]) + guess) & 255
        last = v
        if k >= y:
            out.append(v.reshape(width, count)[x : x + w])
    a = np.stack(out)
    valid = a[..., -1] > 0 if count in (2, 4) else np.ones(a.shape[:2], bool)
    tone = a[..., 0].astype(np.float32) if count < 3 else a[..., :3].mean(2).astype(np.float32)
    return tone, valid


#: The first bytes of containers, as hexadecimal digits.
MAGIC = {"tiff": ("49492A00", "4D4D002A", "49492B00", "4D4D002B"), "png": ("89504E470D0A1A0A",), "jpeg": ("FFD8FF",), "bmp": ("424D",)}


def container(content: Column) -> Column:
    """The container that a file's first bytes name."""
    head = F.hex(F.substring(content, 1, 16))
    kind = F.when(content.isNull(), "unknown")
    for name, marks in MAGIC.items():
        kind = kind.when(reduce(lambda a, b: a | b, [head.startswith(m) for m in marks]), name)
    webp = head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")
    label = F.locate("PDS_VERSION_ID", F.decode(F.substring(content, 1, 4096), "ISO-8859-1")) > 0
    return kind.when(webp, "webp").when(label, "pds3").otherwise("unknown")


def image_array(pdf: pd.DataFrame, dtype: str) -> np.ndarray:
    a = np.zeros((int(pdf.y.max()) + 1, int(pdf.x.max()) + 1), dtype)
    a[pdf.y.to_numpy(), pdf.x.to_numpy()] = pdf.dn.to_numpy()
    return a


def write_raw(px: DataFrame, path: str, dtype: str, header: bytes = b"") -> DataFrame:
    """Pixels of one raster as a headed raw file: strips are packed on Spark, and one task appends them in order, a strip at a time."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        return pd.DataFrame({"strip": [int(pdf.strip.iloc[0])], "raw": [pdf.dn.to_numpy().astype(dtype).tobytes()]})

    strips = px.select("y", "x", "dn", F.floor(F.col("y") / ROWS_A_TASK).cast("int").alias("strip")).groupBy("strip").applyInPandas(pack, "strip int, raw binary")

    def append(batches):
        fs, at = _open(path)
        n = len(header)
        with fs.open_output_stream(at) as f:
            f.write(header)
            for b in batches:
                for raw in b.column("raw").to_pylist():
                    f.write(raw)
                    n += len(raw)
        yield pa.RecordBatch.from_pydict({"bytes": [n]})

    # a shuffle, so that strips are packed by many tasks
    return strips.repartition(1).sortWithinPartitions("strip").mapInArrow(append, "bytes bigint")
