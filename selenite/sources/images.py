"""Pictures in containers (JPEG, PNG, BMP and what else Spark's own decoder knows) as rows of samples.

Files are decoded by Spark's `image` source on the JVM; WebP is not among its formats and is reported like any file that
can't be read. Colours are averaged, and what is wholly transparent is invalid.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples of a picture at most, and of its sides; compressed pictures are decoded whole.
PIXELS, SIDE = 1 << 24, 32_767
#: What wholly transparent samples hold, so that readers without a mask see no picture there.
SAMPLES = "path string, y int, x int, dn double, valid boolean"


def headers(spark: SparkSession, folder: str, **options) -> DataFrame:
    """path, width, height, bands and violations of each file of a folder; what isn't a picture is a row with a reason."""
    files = spark.read.format("binaryFile").options(**options).load(folder).select(_plain("path").alias("path"))
    t = files.join(_decoded(spark, folder, options).select(_plain("image.origin").alias("path"), *[F.col(f"image.{c}").alias(c) for c in ("width", "height", "nChannels")]), "path", "left")
    large = (F.col("width").cast("long") * F.col("height") > PIXELS) | (F.greatest("width", "height") >= SIDE)
    unread = F.coalesce(F.col("width"), F.lit(0)) < 1
    bad = F.filter(F.array(F.when(unread, F.lit("unreadable")), F.when(~unread & large, F.lit("too large"))), lambda x: x.isNotNull())
    some = lambda c: F.when(~unread, F.col(c))
    return t.select("path", some("width").alias("width"), some("height").alias("height"), some("nChannels").alias("bands"), bad.alias("violations"))


def _plain(path: str):
    """The two sources write local addresses with one and with three slashes."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def _decoded(spark: SparkSession, folder: str, options: dict) -> DataFrame:
    return spark.read.format("image").options(**options).load(folder)


def samples(spark: SparkSession, folder: str, **options) -> DataFrame:
    """SAMPLES of every picture of a folder; options such as recursiveFileLookup or pathGlobFilter are Spark's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, h, w, n, data in zip(b["origin"], b["height"], b["width"], b["nChannels"], b["data"]):
                a = np.frombuffer(data, np.uint8).reshape(h, w, n)
                valid = a[..., 3] > 0 if n == 4 else np.ones((h, w), bool)
                tone = a[..., 0].astype(float) if n < 3 else a[..., :3].mean(2)  # the order of colours doesn't matter
                y, x = (v.ravel().astype("int32") for v in np.indices((h, w)))
                yield pd.DataFrame({"path": path, "y": y, "x": x, "dn": tone.ravel(), "valid": valid.ravel()})

    t = _decoded(spark, folder, options).select("image.*").withColumn("origin", _plain("origin")).where(f"width > 0 and cast(width as bigint) * height <= {PIXELS} and greatest(width, height) < {SIDE}")
    return t.select("origin", "height", "width", "nChannels", "data").mapInPandas(run, SAMPLES)


def bmp_bytes(a: np.ndarray) -> bytes:
    """A 24-bit BMP of (rows, columns, 3) samples in the order red, green, blue."""
    h, w = a.shape[:2]
    rows = np.zeros((h, -(-3 * w // 4) * 4), np.uint8)
    rows[:, : 3 * w] = a[::-1, :, ::-1].reshape(h, -1)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def jpeg_blocks(a: np.ndarray) -> bytes:
    """A gray JPEG whose blocks of 8 x 8 samples have one value each (a): only constant terms are stored, so it is exact.

    The code tables are its own: a fixed length for every size of a difference, and one code that ends a block.
    """
    h, w = (8 * n for n in a.shape)
    part = lambda mark, body: struct.pack(">BBH", 255, mark, len(body) + 2) + body
    sizes = bytes(range(12))
    tables = b"\0" + bytes([0, 0, 0, 12] + [0] * 12) + sizes + b"\x10" + bytes([1] + [0] * 15) + b"\0"
    bits, last = [], 0
    for v in a.ravel().tolist():
        d = 8 * (int(v) - 128) - last
        last += d
        n = abs(d).bit_length()
        bits.append(f"{n:04b}" + (f"{d if d > 0 else d + (1 << n) - 1:0{n}b}" if n else "") + "0")
    text = "".join(bits)
    text += "1" * (-len(text) % 8)
    data = int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\0") if text else b""
    frame = struct.pack(">BHHBBBB", 8, h, w, 1, 1, 0x11, 0)
    return b"\xff\xd8" + part(0xDB, b"\0" + b"\x01" * 64) + part(0xC0, frame) + part(0xC4, tables) + part(0xDA, b"\x01\x01\0\0\x3f\0") + data + b"\xff\xd9"
