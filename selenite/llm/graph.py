"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Rows of a link table to a task, so that a small table takes few tasks whatever the session's shuffles are.
PER_TASK = 200_000


def _state(e: DataFrame):
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def _large_star(e: DataFrame, tasks: int) -> DataFrame:
    """Every neighbour above u moves to the least of u and its neighbours. The least is found by partial minima."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.coalesce(tasks)


def _small_star(e: DataFrame, tasks: int) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").coalesce(tasks).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every id in links (a, b); component is the smallest id reachable. Ids without a link don't appear.

    Each step keeps the components and at last leaves stars around the smallest ids; the steps needed
    grow with the logarithm of the longest path. Every step is written to the shared folder and the one
    before it dropped.
    """
    e = scratch.save(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct())
    now = _state(e)
    while now[0]:
        tasks = 1 + now[0] // PER_TASK
        after = scratch.save(_small_star(_large_star(e, tasks), tasks))
        scratch.drop(e)
        e, last, now = after, now, _state(after)
        if now == last:
            break
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return scratch.save(e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots))


def merged(comp: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """comp with more links: only the links between different components are contracted, however large these are."""

    def of(side: str) -> DataFrame:
        return comp.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))

    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    between = between.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    top = components(between, scratch)
    every = comp.unionByName(top.select("id", F.col("id").alias("component")).join(comp, "id", "left_anti"))
    top = top.select(F.col("id").alias("component"), F.col("component").alias("_top"))
    return scratch.save(every.join(top, "component", "left").select("id", F.coalesce("_top", "component").alias("component")))
