"""Operators over pixels: one row for each sample, keyed by y and x (and by further keys, as a scene)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from .spread import quantiles


def window_scan(px: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    return px.where(F.col("y").between(y, y + height - 1) & F.col("x").between(x, x + width - 1))


def mask_calibrate(px: DataFrame, scale: float, offset: float, specials=(), low=None, high=None) -> DataFrame:
    """Adds valid and value (null where invalid)."""
    out = px.withColumn("valid", S.valid_dn(F.col("dn"), specials, low, high))
    return out.withColumn("value", S.calibrated(F.col("dn"), F.col("valid"), scale, offset)).withColumn("valid", F.col("value").isNotNull())


def stretch(px: DataFrame, keys: list[str] = [], value: str = "value", low: float = 0.01, high: float = 0.99) -> DataFrame:  # noqa: B006
    """Adds display: 0..255 between two exact percentiles of each image."""
    q = quantiles(px, keys, value, [low, high]).withColumnRenamed("q", "_q")
    j = px.join(q, keys) if keys else px.crossJoin(F.broadcast(q))  # q is one row
    return j.withColumn("display", S.stretched(F.col(value), F.col("_q")[0], F.col("_q")[1]).cast("int")).drop("_q")


def gray_unit(px: DataFrame, keys: list[str], bands: tuple[str, ...] = ("dn",), floats: bool = True) -> tuple[DataFrame, DataFrame]:
    """Gray samples from 0 to 1 (keys, y, x, g), and keys with violations of the pictures that have none.

    bands: one column, or blue, green, red and perhaps alpha, which doesn't count. A picture of floats whose largest
    sample is 1 at most is taken as it is, whatever the band; any other is divided by 255. Samples that are null, not
    finite, or outside of 0..255 refuse their whole picture.
    """
    if len(bands) not in (1, 3, 4):
        raise ValueError("one band, or blue, green, red and perhaps alpha")
    every = F.array(*[F.col(b).cast("double") for b in bands])
    bad = F.exists(every, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    of = px.groupBy(*keys).agg(F.bool_or(bad).alias("_bad"), F.min(F.array_min(every)).alias("_low"), F.max(F.array_max(every)).alias("_high"))
    why = S.violations((F.col("_bad"), "not finite"), (~F.col("_bad") & ((F.col("_low") < 0) | (F.col("_high") > 255)), "range"))
    of = of.withColumn("violations", why)
    scale = F.when(F.lit(floats) & (F.col("_high") <= 1), 1.0).otherwise(255.0)
    tone = F.col(bands[0]).cast("double") if len(bands) == 1 else S.luma(*[F.col(b).cast("double") for b in (bands[2], bands[1], bands[0])])
    ok = of.where(F.size("violations") == 0).select(*keys, scale.alias("_scale"))
    return px.join(ok, keys).select(*keys, "y", "x", (tone / F.col("_scale")).alias("g")), of.where(F.size("violations") > 0).select(*keys, "violations")


def entropy(px: DataFrame, keys: list[str], value: str = "dn", null: float | None = 0.0) -> DataFrame:
    """Shannon entropy in bits of the unit bins 0..255; samples equal to null don't count. A group without samples has 0 bits and n = 0."""
    v = F.col(value)
    ok = (v >= 0) & (v <= 256) if null is None else (v >= 0) & (v <= 256) & (v != null)
    # a bin of samples that don't count keeps its group
    bins = F.when(ok, F.least(F.floor(v), F.lit(255)))
    n = px.groupBy(*keys, bins.alias("_bin")).agg(F.count(F.lit(1)).alias("_c")).withColumn("_c", F.when(F.col("_bin").isNotNull(), F.col("_c")).otherwise(0))
    # with c samples in a bin and n in all, the sum of -c/n log2(c/n) is log2(n) - sum(c log2 c)/n: no window is needed
    part = F.when(F.col("_c") > 0, F.col("_c") * F.log2(F.col("_c").cast("double"))).otherwise(0.0)
    n = n.groupBy(*keys).agg(F.sum(part).alias("_s"), F.sum("_c").alias("n"), F.max("_c").alias("_most"))
    bits = F.when(F.col("_most") < F.col("n"), F.log2(F.col("n").cast("double")) - F.col("_s") / F.col("n")).otherwise(0.0)
    return n.select(*keys, bits.alias("entropy"), "n")


#: Samples along a side of a tile.
TILE = 256


def tiled(px: DataFrame, before: int, after: int, first: int | None = 0, side: int = TILE) -> DataFrame:
    """px with _ty, _tx: a row for each tile whose window, wider than the tile by so many samples, holds the sample.

    Only samples near a tile's edge are repeated, so a shuffle by tile moves about the raster itself. Tiles
    before `first` are left out.
    """
    def tiles(c: str):
        low = F.floor((F.col(c) - after) / side)
        return F.explode(F.sequence(low if first is None else F.greatest(low, F.lit(first).cast("long")), F.floor((F.col(c) + before) / side)))

    return px.withColumn("_ty", tiles("y")).withColumn("_tx", tiles("x"))


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _fields(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{n}` {df.schema[n].dataType.simpleString()}, " for n in names)


def _box(a: np.ndarray, radius: int) -> np.ndarray:
    """Means of square windows that lie within a."""
    for axis in (0, 1):
        n = a.shape[axis] - 2 * radius
        parts = (np.take(a, range(k, k + n), axis) for k in range(2 * radius + 1))
        a = sum(parts) / (2 * radius + 1)
    return a


def box_moments(px: DataFrame, radius: int, keys: list[str] = [], value: str = "dn") -> DataFrame:  # noqa: B006
    """The sample, local mean m and population deviation s (1e-6 at least) of square windows with mirrored borders.

    One shuffle by tile with a halo; a tile is a numpy array. Rasters are dense: each (keys, y, x) once,
    without gaps from 0 on. Where a window holds a null or NaN, m and s are NaN.
    """
    side = max(TILE, radius)
    v = px.select(*keys, "y", "x", F.col(value).cast("double").alias(value))

    def moments(key: tuple, t: pa.Table) -> pa.Table:
        ty, tx = (int(k.as_py()) for k in key[-2:])
        y, x, dn = (_column(t, c) for c in ("y", "x", value))
        y0, x0 = int(y.min()), int(x.min())
        a = np.full((int(y.max()) - y0 + 1, int(x.max()) - x0 + 1), np.nan)
        a[y - y0, x - x0] = dn
        pads, inner = [], []
        for tile, low, n in ((ty, y0, a.shape[0]), (tx, x0, a.shape[1])):
            # where the window's halo has no samples, the picture ends
            first, last = tile * side, min(tile * side + side, low + n)
            pads.append((low - (first - radius), max(0, last + radius - (low + n))))
            inner.append((first, last))
        (ya, yb), (xa, xb) = inner
        if yb <= ya or xb <= xa:  # nothing but a halo
            h = w = 0
            m = s = own = np.zeros(0)
        else:
            p = np.pad(a, pads, mode="reflect")[: yb - ya + 2 * radius, : xb - xa + 2 * radius]
            m = _box(p, radius)
            s = np.maximum(np.sqrt(np.maximum(_box(p * p, radius) - m * m, 0)), 1e-6)
            h, w = m.shape
            own = a[ya - y0 : yb - y0, xa - x0 : xb - x0]
        yy, xx = np.indices((h, w))
        n = h * w
        arrays = [pa.array([k.as_py()] * n, t.schema.field(c).type) for c, k in zip(keys, key)]
        arrays += [pa.array((yy + ya).ravel().astype(np.int32)), pa.array((xx + xa).ravel().astype(np.int32)), *(pa.array(z.ravel()) for z in (own, m, s))]
        return pa.Table.from_arrays(arrays, names=[*keys, "y", "x", value, "m", "s"])

    return tiled(v, radius, radius, side=side).groupBy(*keys, "_ty", "_tx").applyInArrow(moments, f"{_fields(px, keys)}y int, x int, `{value}` double, m double, s double")


def wallis(px: DataFrame, window: int = 41, keys: list[str] = [], **options) -> DataFrame:  # noqa: B006
    """Adds the locally conditioned sample w."""
    m = box_moments(px, window // 2, keys)
    if set(px.columns) != {*keys, "y", "x", "dn"}:  # columns that a tile doesn't carry
        m = px.join(m.drop("dn"), [*keys, "y", "x"])
    return m.withColumn("w", S.wallis_value(F.col("dn"), F.col("m"), F.col("s"), **options).cast("int"))


def downsample(px: DataFrame, k: int, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Mean of blocks of k x k samples."""
    block = lambda c: F.floor(F.col(c) / k).cast("int").alias(c)
    return px.groupBy(*keys, block("y"), block("x")).agg(F.avg("dn").alias("dn"))


def bilinear(points: DataFrame, px: DataFrame) -> DataFrame:
    """Value v at (sx, sy) of each point by its four neighbours; what lies outside counts as 0. One row for each row of points."""
    return _gathered(points, px, (0, 1), lambda t: 1 - np.abs(t))


def cubic_weight(t: np.ndarray, a: float = -0.75) -> np.ndarray:
    """Keys' cubic kernel at a distance."""
    d = np.abs(t)
    return np.where(d <= 1, ((a + 2) * d - (a + 3)) * d * d + 1, np.where(d < 2, ((d - 5) * d + 8) * d * a - 4 * a, 0.0))


def bicubic(points: DataFrame, px: DataFrame, a: float = -0.75) -> DataFrame:
    """The same by sixteen neighbours."""
    return _gathered(points, px, (-1, 0, 1, 2), lambda t: cubic_weight(t, a))


def supported(points: DataFrame, px: DataFrame, cubic: bool = False) -> DataFrame:
    """v and ok at (sx, sy) of each point: ok where every neighbour that has a weight is a sample and not null; v is 0 elsewhere.

    Neighbours are those of bilinear() or bicubic(); samples with a null or NaN are invalid, and so is a null place.
    """
    return _gathered(points, px, *(((-1, 0, 1, 2), cubic_weight) if cubic else ((0, 1), lambda t: 1 - np.abs(t))), support=True)


def _gathered(points: DataFrame, px: DataFrame, steps: tuple[int, ...], weight, support: bool = False) -> DataFrame:
    """Points and samples meet by tile, samples with the halo of the kernel; a point's samples are looked up in an array.

    Points are shuffled once and never repeated; a null place gives a null value. With support there is ok beside v.
    """
    low, high, names = -steps[0], steps[-1], points.columns
    place = lambda c: F.floor(F.floor(c) / TILE)
    p = points.withColumns({"_ty": place("sy"), "_tx": place("sx")})
    # both sides may come from one table: columns of their own keep them apart
    samples = tiled(px.select(F.col("y").alias("y"), F.col("x").alias("x"), F.col("dn").cast("double").alias("dn")), low, high, None)

    def gather(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        own = a.select(names)
        v, ok = np.zeros(a.num_rows), np.zeros(a.num_rows, bool)
        placed = key[0].as_py() is not None and key[1].as_py() is not None
        if a.num_rows and b.num_rows and placed:
            y0, x0 = (int(k.as_py()) * TILE - low for k in key)
            grid = np.zeros((TILE + low + high,) * 2)
            dn = _column(b, "dn")  # nulls are NaN here
            grid[_column(b, "y") - y0, _column(b, "x") - x0] = np.nan_to_num(dn)
            have = np.zeros(grid.shape, bool)
            have[_column(b, "y") - y0, _column(b, "x") - x0] = np.isfinite(dn)
            ok[:] = True
            sx, sy = _column(a, "sx"), _column(a, "sy")
            fx, fy = np.floor(sx), np.floor(sy)
            for j in steps:
                wy, y = weight(sy - fy - j), (fy + j - y0).astype(int)
                for i in steps:
                    w, x = weight(sx - fx - i) * wy, (fx + i - x0).astype(int)
                    v += w * grid[y, x]
                    ok &= have[y, x] | (w == 0)
        if support:
            return own.append_column("v", pa.array(np.where(ok, v, 0.0))).append_column("ok", pa.array(ok))
        return own.append_column("v", pa.array(v) if placed else pa.nulls(a.num_rows, pa.float64()))

    g = lambda t: t.groupBy("_ty", "_tx")
    return g(p).cogroup(g(samples)).applyInArrow(gather, f"{_fields(points, names)}v double" + ", ok boolean" * support)
