"""Order statistics and neighbours in order of groups that may hold any share of a table's rows.

Groups of at most AT_ONCE rows are left to Spark's own aggregates and windows, where a group meets in one task. Larger
ones are taken apart; results are the same either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import HOT, cut

#: Rows of a group that may meet in a task, and ranges that values are counted in at a time.
AT_ONCE, RANGES = 1_000_000, 1024


def _sizes(t: DataFrame, keys: list[str]) -> DataFrame:
    return t.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def _same(keys: list[str]) -> Column | None:
    on = None
    for k in keys:
        e = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        on = e if on is None else on & e
    return on


def _beside(t: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """t joined with a broadcast table that has a row or a few for each of its keys; null keys are keys too."""
    if not keys:
        return t.crossJoin(F.broadcast(other))  # one row for each rank
    other = F.broadcast(other.withColumnsRenamed({k: f"_k_{k}" for k in keys}))
    return t.join(other, _same(keys), how).drop(*[f"_k_{k}" for k in keys])


def _ranked(t: DataFrame, keys: list[str], ranks: DataFrame) -> DataFrame:
    """keys, rank, v: the value of each rank (from 0) of each group, by counting in ever narrower ranges.

    ranks: keys, rank, and low and high (the group's least and largest value); a few rows for each of HOT groups at most.
    A round counts the values of each range that holds a rank, and goes on within the one that the rank falls into,
    from its least to its largest value, until both are equal. Only counts leave a task.
    """
    state, done = cut(ranks.withColumn("below", F.lit(0).cast("long"))), None
    while True:
        found = state.where("low = high").select(*keys, "rank", F.col("low").alias("v"))
        done = cut(found if done is None else done.unionByName(found))
        state = cut(state.where("low < high"))
        if state.isEmpty():
            return done
        v = _beside(t, state, keys).where("v between low and high")
        # halves first, as the difference of two values may be infinite
        at = F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * RANGES), F.lit(RANGES - 1))
        counts = v.groupBy(*keys, "rank", "below", at.alias("range")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "rank").orderBy("range"))
        counts = counts.withColumn("upto", F.col("below") + upto).where("rank < upto and rank >= upto - n")
        state = cut(counts.select(*keys, "rank", "low", "high", (F.col("upto") - F.col("n")).alias("below")))


def quantiles(t: DataFrame, keys: list[str], value: str, shares: list[float], at_once: int = AT_ONCE) -> DataFrame:
    """keys and q, an array of the exact quantiles of each group (interpolated as by percentile); nulls don't count, a group of nulls has null.

    A group beyond at_once rows that also holds a good part of all rows is counted in ranges; there are HOT of them at most.
    """
    t = t.select(*keys, F.col(value).cast("double").alias("v"))
    plain = lambda x: x.groupBy(*keys).agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q"))
    # NaN and infinities aren't ranges of anything. No filter looks at v: it would have the value's whole expression
    # evaluated anew for each place that v stands in, and on long ones that costs many times the rest
    whole = F.when(F.abs("v") < float("inf"), F.col("v"))
    sizes = t.groupBy(*keys).agg(F.count(whole).alias("n"), F.min(whole).alias("low"), F.max(whole).alias("high"), F.count_if(F.isnan("v") | (F.abs("v") == float("inf"))).alias("odd"))
    total, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if most <= at_once:
        return plain(t)
    large = cut(sizes.where((F.col("n") > at_once) & (F.col("n") * HOT >= total) & (F.col("odd") == 0)).drop("odd"))
    if large.isEmpty():
        return plain(t)
    of_large = F.broadcast(large.select(*[F.col(k).alias(f"_k_{k}") for k in keys]))
    place = lambda q: F.lit(q) * (F.col("n") - 1)
    both = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(q)), F.ceil(place(q))) for q in shares])))
    # each round reads the values again, but doesn't make them again
    values = (t.join(of_large, _same(keys), "left_semi") if keys else t).persist()
    try:
        found = _ranked(values, keys, large.select(*keys, F.explode(both).alias("rank"), "low", "high"))
    finally:
        values.unpersist()
    by = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("_v"))
    by = _beside(large, by, keys)
    at = lambda r: F.col("_v")[r]
    mid = lambda q: F.when(F.floor(place(q)) == F.ceil(place(q)), at(F.floor(place(q)))).otherwise((F.ceil(place(q)) - place(q)) * at(F.floor(place(q))) + (place(q) - F.floor(place(q))) * at(F.ceil(place(q))))
    by = by.select(*keys, F.array(*map(mid, shares)).alias("q"))
    return by.unionByName(plain(t.join(of_large, _same(keys), "left_anti"))) if keys else by


def with_next(t: DataFrame, keys: list[str], order: list[str], columns: list[str], at_once: int = AT_ONCE) -> DataFrame:
    """t with next, the columns of each row's successor within its keys as a struct; null at the end. Order is total.

    Beyond at_once rows of a group, rows are dealt by ranges of (keys, order), and only the first row of each range of a
    group looks back to the range before.
    """
    row = F.struct(*columns)
    if (_sizes(t, keys).agg(F.max("_n")).first()[0] or 0) <= at_once:
        return t.withColumn("next", F.lead(row).over(Window.partitionBy(*keys).orderBy(*order)))
    # written, so that the ranges stay what they are
    t = cut(t.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    firsts = t.groupBy(*keys, "_range").agg(F.min_by(row, F.struct(*order)).alias("_first"))
    after = firsts.withColumn("_after", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_range"))).drop("_first")
    after = after.withColumnsRenamed({k: f"_k_{k}" for k in keys} | {"_range": "_of"})
    t = t.withColumn("next", F.lead(row).over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    on = (F.col("_range") == F.col("_of")) & _same(keys)
    last = F.col("next").isNull()
    return t.join(after, on, "left").withColumn("next", F.when(last, F.col("_after")).otherwise(F.col("next"))).drop("_range", "_after", "_of", *[f"_k_{k}" for k in keys])
