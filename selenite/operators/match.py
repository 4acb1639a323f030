"""Descriptor matching: nearest neighbours, ratio test, reciprocal pairs, one-to-one endpoints."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Distances that a task holds at a time.
CELLS = 1 << 22


def _two_best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """For each row of a the two nearest rows of b: s, r, d. The product only excludes what is farther than its
    rounding can explain; of equal references the two first are enough."""
    b = b.sort_values("id", ignore_index=True)
    y = np.stack(b.v.to_numpy()).astype(float) + 0.0  # one zero
    same = pd.Series([v.tobytes() for v in y])
    two = (same.groupby(same).cumcount() < 2).to_numpy()
    y, ids = y[two], b.id.to_numpy()[two]
    norms, out = (y * y).sum(1), []
    k, eps = min(2, len(y)), 4 * (y.shape[1] + 4) * np.finfo(float).eps
    rows = max(1, CELLS // len(y))
    for i in range(0, len(a), rows):
        x = np.stack(a.v.to_numpy()[i : i + rows]).astype(float)
        xx = (x * x).sum(1)
        high = x @ y.T  # the squared distance and its slack, eps * (xx + norms)
        high *= -2
        high += (1 + eps) * norms
        high += (1 + eps) * xx[:, None]
        at = np.arange(len(x))
        first = high.argmin(1)
        bound = high[at, first]
        if k == 2:
            high[at, first] = np.inf
            least, bound = bound, high.min(1)
            high[at, first] = least
        high -= 2 * eps * norms
        row, col = np.nonzero(high <= (bound + 2 * eps * xx)[:, None])
        del high
        step = max(1, (1 << 22) // y.shape[1])
        exact = np.sqrt(np.concatenate([((x[row[j : j + step]] - y[col[j : j + step]]) ** 2).sum(1) for j in range(0, len(row), step)]))
        order = np.lexsort((ids[col], exact, row))
        first = np.searchsorted(row, np.arange(len(x)))  # every row has k at least
        order = order[(first[:, None] + np.arange(k)).ravel()]
        out.append(pd.DataFrame({"s": a.id.to_numpy()[i : i + rows][row[order]], "r": ids[col[order]], "d": exact[order]}))
    return pd.concat(out)


def _finite(t: DataFrame):
    return F.col("id").isNotNull() & F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def usable(t: DataFrame) -> DataFrame:
    """Descriptors (id, v) that can be at a distance: with an id, and a vector of finite numbers only."""
    return t.where(_finite(t))


def unusable(t: DataFrame) -> int:
    """How many rows usable() leaves out."""
    return t.where(~_finite(t)).count()


_FOUND = "side string, s bigint, r bigint, d double"


def _best_of(found: DataFrame) -> DataFrame:
    two = found.groupBy("side", "s").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "r"))), 1, 2).alias("n"))  # two of each block
    return two.select("side", "s", F.col("n")[0]["r"].alias("r"), F.col("n")[0]["d"].alias("d1"), F.try_element_at("n", F.lit(2))["d"].alias("d2"))


def _met(key: tuple, x: pd.DataFrame, y: pd.DataFrame, sides: str) -> pd.DataFrame:
    if x.empty or y.empty:
        return pd.DataFrame({"side": pd.Series([], dtype=object), "s": pd.Series([], dtype="int64"), "r": pd.Series([], dtype="int64"), "d": pd.Series([], dtype=float)})
    return pd.concat([_two_best(*((x, y) if side == "f" else (y, x))).assign(side=side) for side in sides])[["side", "s", "r", "d"]]


def _nearest(src: DataFrame, ref: DataFrame, block_rows: int, sides: str) -> DataFrame:
    """side, s, r, d1, d2: 'f' the references of each source, 'b' the sources of each reference.

    Tables of a block's size meet in one matrix product that serves both sides. Larger ones go through an index.
    """
    src, ref = usable(src), usable(ref)
    a, b = (-(-t.count() // block_rows) for t in (src, ref))
    if max(a, b) > 1:
        pairs = {"f": (src, ref), "b": (ref, src)}
        return reduce(DataFrame.unionByName, [_indexed(*pairs[s], block_rows).withColumn("side", F.lit(s)) for s in sides])
    g = lambda t: t.select(F.col("id").alias("id"), F.col("v").alias("v"), F.lit(0).alias("_b")).groupBy("_b")
    return _best_of(g(src).cogroup(g(ref)).applyInPandas(lambda key, x, y: _met(key, x, y, sides), _FOUND))


#: Centres of the index at most, and rows that a centre stands for at least.
CENTRES, A_CENTRE = 1024, 32
#: Questions to clusters that leave a task at a time, each with its vector.
ASKS = 1 << 14


def _distances(v: pd.Series, centres: np.ndarray) -> np.ndarray:
    """From each vector to each centre, exact to a few units of rounding."""
    x = np.stack(v.to_numpy()).astype(float)
    d = (x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * x @ centres.T
    return np.sqrt(np.maximum(d, 0))


def _parts(batches, centres: int):
    """Batches of so many rows that their distances to all centres are few."""
    rows = max(1, CELLS // centres)
    for b in batches:
        for i in range(0, len(b), rows):
            yield b.iloc[i : i + rows]


def _assigned(t: DataFrame, centres: np.ndarray) -> DataFrame:
    """id, v, the nearest centre c and the distance d to it."""
    shared = t.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for b in _parts(batches, len(shared.value)):
            d = _distances(b.v, shared.value)
            c = d.argmin(1)
            yield pd.DataFrame({"id": b.id, "v": b.v, "c": c.astype("int32"), "d": d[np.arange(len(c)), c]})

    return t.select("id", "v").mapInPandas(run, "id bigint, v array<double>, c int, d double")


def _blocks(t: DataFrame, counts: dict[int, int], block_rows: int, name: str) -> DataFrame:
    """t with the number of its row's block within the cluster c, so that a block has about block_rows rows."""
    n = F.create_map(*[F.lit(x) for c, k in counts.items() for x in (c, max(1, -(-k // block_rows)))]) if counts else F.create_map().cast("map<int,int>")
    return t.withColumn(name, F.pmod(F.xxhash64("id"), F.coalesce(F.try_element_at(n, F.col("c")), F.lit(1))).cast("int"))


def _count(t: DataFrame) -> dict[int, int]:
    n = F.sum("n") if "n" in t.columns else F.count(F.lit(1))
    return {r["c"]: r["n"] for r in t.groupBy("c").agg(n.alias("n")).collect()}  # CENTRES rows at most


def _indexed(src: DataFrame, ref: DataFrame, block_rows: int) -> DataFrame:
    """s, r, d1, d2 of each source, as exact as comparing all pairs, but only with clusters that can hold one of its two nearest.

    References are dealt to the nearest of a bounded number of centres. Two of a source's own cluster give a bound for
    its second nearest; a cluster whose centre is farther than that bound and the cluster's radius holds neither. Clusters
    and their sources are cut into blocks, so one that many rows are near is many tasks. What clusters are asked is counted
    first: where that would move more rows than comparing all pairs of blocks does, as it does without clusters or in many
    dimensions, all pairs of blocks are compared.
    """
    from ..shared import cut

    n = ref.count()
    first = ref.orderBy(F.xxhash64("id"), "id").limit(max(1, min(CENTRES, n // A_CENTRE))).select("v").toPandas()
    if first.empty:
        return src.select(F.col("id").alias("s"), F.col("id").alias("r"), F.lit(0.0).alias("d1"), F.lit(0.0).alias("d2")).limit(0)
    centres = np.stack(first.v.to_numpy()).astype(float)
    refs, srcs = cut(_assigned(ref, centres)), cut(_assigned(src, centres))
    sizes = refs.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius")).toPandas()  # CENTRES rows at most
    held = dict(zip(sizes.c.tolist(), sizes.n.tolist()))
    radius = np.full(len(centres), -np.inf)
    radius[sizes.c.to_numpy()] = sizes.radius.to_numpy()
    own = lambda t, *c: t.select(*[F.col(x).alias(x) for x in ("id", "v", *c)])
    every = lambda counts: F.explode(F.sequence(F.lit(0), F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for c, k in counts.items() for x in (c, max(1, -(-k // block_rows)))]), F.col("c")), F.lit(1)) - 1))

    def bounds(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty:
            return pd.DataFrame({"id": pd.Series([], dtype="int64"), "bound": pd.Series([], dtype=float)})
        if len(y) < 2:
            return pd.DataFrame({"id": x.id, "bound": np.inf})
        two = _two_best(x, y)
        return pd.DataFrame({"id": two.s.to_numpy()[1::2], "bound": two.d.to_numpy()[1::2]})

    near = _count(srcs)
    x = _blocks(own(srcs, "c"), near, block_rows, "_b")
    # any two references bound the second nearest, so of a large cluster one block will do
    y = _blocks(own(refs, "c"), held, block_rows, "_part").where("_part = 0").withColumn("_b", every(near) if near else F.lit(0))
    g = lambda t, *k: t.groupBy(*k)
    bound = cut(g(x, "c", "_b").cogroup(g(y, "c", "_b")).applyInPandas(bounds, "id bigint, bound double")).groupBy("id").agg(F.min("bound").alias("bound"))
    shared = src.sparkSession.sparkContext.broadcast((centres, radius))

    def asked(batches):
        points, reach = shared.value
        for b in _parts(batches, len(points)):
            d = _distances(b.v, points)
            slack = 1e-9 * (d + np.abs(reach) + np.where(np.isfinite(b.bound), b.bound, 0).reshape(-1, 1)) + 1e-6 * np.sqrt(np.finfo(float).eps) * (1 + d)
            yield b, (reach >= 0) & (d - reach - slack <= b.bound.to_numpy()[:, None])

    def counted(batches):
        for _, near in asked(batches):
            yield pd.DataFrame({"c": np.arange(near.shape[1], dtype="int32"), "n": near.sum(0)})

    def listed(batches):
        for b, near in asked(batches):
            row, c = np.nonzero(near)
            for i in range(0, len(row), ASKS):
                at = row[i : i + ASKS]
                yield pd.DataFrame({"id": b.id.to_numpy()[at], "v": b.v.to_numpy()[at], "c": c[i : i + ASKS].astype("int32")})

    bounded = cut(own(srcs).join(bound, "id"))
    asks = {c: k for c, k in _count(bounded.mapInPandas(counted, "c int, n bigint")).items() if k}
    blocks = lambda k: max(1, -(-k // block_rows))
    moved = sum(k * blocks(held[c]) + held[c] * blocks(k) for c, k in asks.items())
    rows = sum(near.values())
    if moved > rows * blocks(n) + n * blocks(rows):
        return _all_pairs(src, ref, block_rows, "f").drop("side")
    want = cut(bounded.mapInPandas(listed, "id bigint, v array<double>, c int"))
    x = _blocks(want, asks, block_rows, "_b").withColumn("_part", every(held))
    y = _blocks(own(refs, "c"), held, block_rows, "_part").withColumn("_b", every(asks) if asks else F.lit(0))
    found = g(x, "c", "_part", "_b").cogroup(g(y, "c", "_part", "_b")).applyInPandas(lambda key, p, q: _met(key, p, q, "f"), _FOUND)
    return _best_of(found).drop("side")


#: Blocks of a side at least, as far as each has so many rows.
LEAST_BLOCKS, A_BLOCK = 8, 1000


def _all_pairs(src: DataFrame, ref: DataFrame, block_rows: int, sides: str) -> DataFrame:
    """The same by every pair of blocks: each row moves once for each block of the other side, and a task holds two blocks."""
    src, ref = usable(src), usable(ref)
    # some blocks at least, as the pairs of blocks are the tasks
    a, b = (max(1, -(-n // block_rows), min(LEAST_BLOCKS, n // A_BLOCK)) for n in (src.count(), ref.count()))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    s = src.select("id", "v").withColumn("_a", dealt(a)).withColumn("_b", every(b))
    r = ref.select("id", "v").withColumn("_b", dealt(b)).withColumn("_a", every(a))
    found = s.groupBy("_a", "_b").cogroup(r.groupBy("_a", "_b")).applyInPandas(lambda key, x, y: _met(key, x, y, sides), _FOUND)
    return _best_of(found)


def nearest_two(src: DataFrame, ref: DataFrame, block_rows: int = 20_000) -> DataFrame:
    """For each source descriptor its nearest and second nearest reference: s, r, d1, d2. Ties by r.

    src and ref: id, v (array); rows that aren't usable() are in no pair. The exact counterpart of an approximate
    tree search.
    """
    return _nearest(src, ref, block_rows, "f").drop("side")


def nearest_both(src: DataFrame, ref: DataFrame, block_rows: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """nearest_two from both sides; the second one's s are references."""
    n = _nearest(src, ref, block_rows, "fb")
    return tuple(n.where(F.col("side") == side).drop("side") for side in "fb")


def ratio_test(nearest: DataFrame, ratio: float) -> DataFrame:
    """Strictly nearer than ratio times the second; two distances of 0 fail."""
    return nearest.where(F.col("d1") < F.lit(ratio) * F.col("d2")).withColumn("conf", 1.0 - F.col("d1") / F.col("d2"))


def reciprocal(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Pairs found from both sides, with the smaller confidence. backward has its own s (a reference) and r."""
    b = backward.select(F.col("r").alias("s"), F.col("s").alias("r"), F.col("conf").alias("_c"))
    return forward.join(b, ["s", "r"]).select("s", "r", F.least("conf", "_c").alias("conf"))


def unique_pairs(ties: DataFrame, keys: list[str]) -> DataFrame:
    """The strongest one-to-one endpoints: ties taken by confidence (then i), each source and reference once.

    A tie that is the best of both of its endpoints is taken in any order, so all of these are taken at
    once; their endpoints' other ties fall away, and the rest goes on until nothing is left. Each
    round is a pair of windows and takes the best tie of every job at least; the number of rounds is
    the longest chain of ever weaker neighbours.
    """
    from ..shared import cut

    ends = ["sx", "sy", "rx", "ry"]
    left, taken = ties.dropDuplicates([*keys, "conf", "i", *ends]), []
    by = lambda *c: Window.partitionBy(*keys, *c).orderBy(F.desc("conf"), "i", *ends)

    def without(t: DataFrame, best: DataFrame, cols: list[str]) -> DataFrame:
        gone = best.select(*[F.col(c).alias(f"_{c}") for c in cols]).distinct()
        return t.join(gone, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cols]), "left_anti")

    while True:
        r = left.withColumns({"_s": F.row_number().over(by("sx", "sy")), "_r": F.row_number().over(by("rx", "ry"))})
        best = cut(r.where("_s = 1 and _r = 1").select(*ties.columns))
        taken.append(best)
        left = cut(without(without(left, best, [*keys, "sx", "sy"]), best, [*keys, "rx", "ry"]).select(*ties.columns))
        if left.isEmpty():
            return reduce(DataFrame.unionByName, taken)
        if len(taken) == 32:  # a short plan, however many rounds
            taken = [cut(reduce(DataFrame.unionByName, taken).coalesce(best.rdd.getNumPartitions()))]
