"""What several operators of this folder share: tables, the shared folder, running totals."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import cut, shared_dir, spread_join  # noqa: F401  the operators take them from here

#: Words as the contracts of this folder define them: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Tables of at most this many rows may be broadcast (a count decides, never a guess).
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables of one run: written as Parquet to the shared folder, dropped once nothing reads them any more.

    A lost executor costs no recomputation of what lies before a table. Columns keep their types; small
    files are read several to a task, so tables shrink to few tasks whatever the shuffles before them were.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.tables = spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}", []

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.tables)}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((path, out))
        return out

    def drop(self, *done: DataFrame) -> None:
        for path, df in self.tables:
            if any(df is d for d in done):
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df to be broadcast if its counted rows stay within the bound, else as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def offsets(totals: DataFrame, keys: list[str], cell: str, value: str, out: str, per: int = 1024) -> DataFrame:
    """Exclusive running total of value along cell within keys.

    totals has one row for each (keys, cell). The total runs in two levels, within ranges of
    `per` cells and then over the ranges, so that no key's cells meet in one task.
    """
    t = totals.withColumn("_range", F.floor(F.col(cell) / per))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inner = before(Window.partitionBy(*keys, "_range").orderBy(cell))
    ranges = t.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    outer = before(Window.partitionBy(*keys).orderBy("_range"))
    ranges = ranges.select(*keys, "_range", F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_base"))
    t = t.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return t.join(ranges, [*keys, "_range"]).select(*keys, cell, (F.col("_base") + F.col("_in")).alias(out))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
