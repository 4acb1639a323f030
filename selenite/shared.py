"""The folder that driver and executors share, and joins that no key can overload."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that hold at least 1 / HOT of all rows may be broadcast: there can't be more than HOT of them.
HOT = 20_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where that is unset and all tasks run on this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="selenite-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """The rows as written to the shared folder, so that a lost executor costs no recomputation of what lies before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting of the session while it lasts, for what runs within, such as a write or cut()."""
    kept = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if kept is None else spark.conf.set(name, kept)


def small_batches(spark: SparkSession, size: int = 4 << 20):
    """While it lasts, batches of rows with large contents have about so many bytes."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def small_splits(spark: SparkSession, size: int = 16 << 20):
    """While it lasts, a task reads about so many bytes of files, for ranges of a table that lie close together in its files."""
    return setting(spark, "spark.sql.files.maxPartitionBytes", str(size))


@contextmanager
def no_shuffles_left(spark: SparkSession):
    """While it lasts, files of a write's or a checkpoint's shuffles go once it is done, and don't wait for the driver's garbage collection."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, kept)


#: Rows of a round at least, rounds of a table (about), and ranges of a key that rounds are made up of.
ROUND, ROUNDS, BINS = 2_000_000, 16, 4096


def rounds(counts: DataFrame, key: str, parts: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Ranges of an integer key, one after the other: first, last, and their rows, of which counts has in n how many a key has.

    A range has so small a part of all rows, or ROUND where that is more; so what a round keeps on disk is a small share of the
    table, and the rounds stay few. Every key that isn't null is in one of them. A range of one key may have more rows.
    """
    counts = counts.where(F.col(key).isNotNull())
    low, high, total = counts.agg(F.min(key), F.max(key), F.sum("n")).first()
    if low is None:
        return []
    most, per = max(ROUND, -(-total // parts)), (high - low) // BINS + 1
    out = []
    for at, n in counts.groupBy(F.expr(f"(`{key}` - ({low})) div {per}").alias("bin")).agg(F.sum("n")).orderBy("bin").collect():
        first, last = low + at * per, low + (at + 1) * per - 1
        if out and out[-1][2] + n <= most:
            out[-1] = (out[-1][0], last, out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


#: Rows of a small table that a task gets where each of them costs much.
COSTLY = 10_000


def dealt(t: DataFrame, key: str, rows: int = COSTLY) -> DataFrame:
    """The rows of a table whose file is small for the work on them, dealt by key to tasks of about so many rows, one a core at least.

    Splits of a file and merged partitions go by bytes, which would leave labels that a table's rows stand for to a few tasks.
    """
    n = t.count()
    return t.repartition(max(t.sparkSession.sparkContext.defaultParallelism, -(-n // rows)), key)


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows with the columns of facts, which has one row for each key and in `held` the number of rows that have it.

    total is the number of rows. Facts of keys with a large share of the rows are broadcast, so those rows stay where
    they are; the rest are shuffled by keys of which none holds a large share. Rows without facts go.
    """
    large = F.col("held") * HOT >= total
    hot = facts.where(large).drop("held")
    stay = rows.join(F.broadcast(hot), keys)
    move = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(facts.where(~large).drop("held"), keys)
    return stay.unionByName(move)
