"""Checksums that labels state, of what they say they cover: a whole file, or its image alone.

A digest of this kind is a chain: each step needs the state that the bytes before it left. A file's range is therefore
read by one task in blocks of bounded size, and files are spread over tasks; nothing else is held in memory.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .raster import _open

BLOCK = 1 << 20
SCOPES = ("file", "image_object")


def _digest(path: str, first: int, last: int) -> str:
    """Of the bytes from first up to last; ValueError where there are fewer."""
    fs, at = _open(path)
    md5 = hashlib.md5(usedforsecurity=False)
    with fs.open_input_file(at) as f:
        f.seek(first)
        left = last - first
        while left:
            b = f.read(min(BLOCK, left))
            if not b:
                raise ValueError("short file")
            md5.update(b)
            left -= len(b)
    return md5.hexdigest()


def verified(files: DataFrame, id_: str = "id") -> DataFrame:
    """files with status: verified, mismatch, none (no checksum), scope unknown, short file, or unreadable.

    files: id, path, file_size, offset and end_byte (of the image), md5 and md5_scope, as records has them. Files are
    dealt by size, so a few large ones don't share a task. A checksum tells of damage, not of who made a file.
    """
    scope = F.col("md5_scope")
    t = files.select(id_, "path", F.when(scope == "file", F.lit(0).cast("long")).otherwise(F.col("offset")).alias("first"), F.when(scope == "file", F.col("file_size")).otherwise(F.col("end_byte")).alias("last"), "file_size", F.lower("md5").alias("md5"))
    t = t.where(F.col("md5").isNotNull() & scope.isin(*SCOPES))

    def run(batches):
        for b in batches:
            out = []
            for path, first, last, size, md5 in zip(b["path"], b["first"], b["last"], b["file_size"], b["md5"]):
                try:
                    if not 0 <= first <= last <= size:
                        raise ValueError("short file")
                    out.append("verified" if _digest(path, int(first), int(last)) == md5 else "mismatch")
                except ValueError:
                    out.append("short file")
                except OSError:
                    out.append("unreadable")
            yield pd.DataFrame({id_: b[id_], "_status": out})

    found = t.repartition(F.col("path")).mapInPandas(run, f"{id_} {files.schema[id_].dataType.simpleString()}, _status string")
    t = files.join(found, id_, "left")
    rest = F.when(F.col("md5").isNull() & scope.isNull(), "none").otherwise("scope unknown")
    return t.withColumn("status", F.coalesce("_status", rest)).drop("_status")
