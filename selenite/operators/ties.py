"""Operators over tie points: job, i, sx, sy, rx, ry, conf."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .spread import quantiles


def residuals(ties: DataFrame, h: list[float]) -> DataFrame:
    """Adds px, py (the reference projected by h) and their distance res from the source."""
    px, py = S.homography(h, F.col("rx"), F.col("ry"))
    return ties.withColumns({"px": px, "py": py}).withColumn("res", F.hypot(F.col("px") - F.col("sx"), F.col("py") - F.col("sy")))


def consensus(ties: DataFrame, h: list[float], limit: float = S.MAX_RESIDUAL) -> DataFrame:
    return residuals(ties, h).withColumn("inlier", F.col("res") <= limit)


def grid_top(ties: DataFrame, width: float, height: float, k: int = 1, cells: int = 8, keys: list[str] = ["job"]) -> DataFrame:  # noqa: B006
    """The k most confident sites of each cell; equal sites count once, ties go to the smaller i."""
    order = [F.desc("conf"), F.col("i")]
    site = F.row_number().over(Window.partitionBy(*keys, "rx", "ry").orderBy(*order))
    t = ties.withColumns({"gx": S.grid_cell(F.col("rx"), width, cells), "gy": S.grid_cell(F.col("ry"), height, cells)})
    t = t.withColumn("_one", site).where("_one = 1").drop("_one")
    rank = F.row_number().over(Window.partitionBy(*keys, "gx", "gy").orderBy(*order))
    return t.withColumn("_k", rank).where(F.col("_k") <= k).drop("_k")


def grid_flag(ties: DataFrame, width: float, height: float, eligible, cells: int = 8, keys: list[str] = ["job"]) -> DataFrame:  # noqa: B006
    """Adds retained: whether a tie is the most confident eligible one of its cell, ties going to the smaller i. No tie is dropped.

    Of a cell one row is looked for, by partial aggregates; i names a tie within its keys.
    """
    t = ties.withColumns({"_e": F.coalesce(eligible, F.lit(False)), "_gx": S.grid_cell(F.col("rx"), width, cells), "_gy": S.grid_cell(F.col("ry"), height, cells)})
    best = t.where("_e").groupBy(*keys, "_gx", "_gy").agg(F.min(F.struct((-F.col("conf")).alias("c"), "i"))["i"].alias("_i"))
    return t.join(best, [*keys, "_gx", "_gy"], "left").withColumn("retained", F.col("_e") & F.coalesce(F.col("i") == F.col("_i"), F.lit(False))).drop("_e", "_gx", "_gy", "_i")


def occupancy(ties: DataFrame, width: float, height: float, cells: int = 5, keys: list[str] = ["job"]) -> DataFrame:  # noqa: B006
    t = ties.select(*keys, S.grid_cell(F.col("rx"), width, cells).alias("gx"), S.grid_cell(F.col("ry"), height, cells).alias("gy"))
    n = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("gx", "gy").alias("occupied"))
    return n.withColumn("share", F.when(F.col("n") < 3, 0.0).otherwise(F.col("occupied") / float(cells * cells)))


def uniformity(areas: DataFrame, keys: list[str], area: str = "area") -> DataFrame:
    """1 - deviation / mean of the cells' areas, within 0..1."""
    v = 1.0 - F.stddev_pop(area) / (F.avg(area) + 1e-6)
    return areas.groupBy(*keys).agg(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)), F.lit(0.0)).alias("vsui"))


def lattice_cells(sites: DataFrame, width: int, height: int, step: int, keys: list[str] = ["job"]) -> DataFrame:  # noqa: B006
    """The area nearest to each site, counted on a lattice: at most cells*cells sites a key after thinning."""
    lattice = sites.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(width // step - 1))).alias("_u")).withColumn("_v", F.explode(F.sequence(F.lit(0), F.lit(height // step - 1))))
    lattice = lattice.select(((F.col("_u") + 0.5) * step).alias("x"), ((F.col("_v") + 0.5) * step).alias("y"), "_u", "_v")
    d = (F.col("x") - F.col("rx")) * (F.col("x") - F.col("rx")) + (F.col("y") - F.col("ry")) * (F.col("y") - F.col("ry"))
    near = sites.crossJoin(F.broadcast(lattice)).groupBy(*keys, "_u", "_v").agg(F.min_by("i", F.struct(d, "i")).alias("i"))  # lattice: (width/step)*(height/step) rows, fixed
    return near.groupBy(*keys, "i").agg((F.count(F.lit(1)) * float(step * step)).alias("area"))


def report(scored: DataFrame, keys: list[str] = ["job"]) -> DataFrame:  # noqa: B006
    """Counts, inlier ratio and radial errors of the inliers."""
    ok = F.col("inlier")
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(ok).alias("inliers"),
        (F.count_if(ok) / F.count(F.lit(1))).alias("ratio"),
        F.sqrt(F.avg(F.when(ok, F.col("res") * F.col("res")))).alias("rmse"),
    )


def error_quantiles(scored: DataFrame, keys: list[str] = ["job"], **options) -> DataFrame:  # noqa: B006
    """median and p95 of the inliers' residuals, exact, whatever share of the ties a job holds."""
    q = quantiles(scored.select(*keys, F.when(F.col("inlier"), F.col("res")).alias("res")), keys, "res", [0.5, 0.95], **options)
    return q.select(*keys, F.col("q")[0].alias("median"), F.col("q")[1].alias("p95"))


def scaled_rmse(scored: DataFrame, keys: list[str] = ["job"]) -> DataFrame:  # noqa: B006
    """Root mean square by the largest residual, which can't overflow; null without rows."""
    # scaled by powers of two within a task's rows, so that partial sums of a job need not know its largest residual:
    # residuals of one exponent are added up as they are, and the few sums of exponents then by the largest of them
    power = F.when(F.col("res") > 0, F.floor(F.log2("res"))).otherwise(F.lit(None))
    part = F.col("res") / F.pow(F.lit(2.0), F.col("_e"))
    t = scored.select(*keys, "res", power.alias("_e")).groupBy(*keys, "_e").agg(F.count("res").alias("_n"), F.coalesce(F.sum(part * part), F.lit(0.0)).alias("_s"))
    peak = F.max("_e").over(Window.partitionBy(*keys))
    t = t.withColumn("_p", peak).withColumn("_t", F.col("_s") * F.pow(F.lit(4.0), F.coalesce(F.col("_e") - F.col("_p"), F.lit(0))))
    root = F.sqrt(F.sum("_t") / F.sum("_n")) * F.pow(F.lit(2.0), F.coalesce(F.max("_p"), F.lit(0)))
    return t.groupBy(*keys).agg(F.when(F.sum("_n") > 0, root).alias("rmse"))


def spans_plane(x: str, y: str, eps: float = 1e-12):
    """Aggregate: whether points are not all on one line. The smaller spread is held against the larger one, so units don't matter."""
    vx, vy, c = F.var_pop(x), F.var_pop(y), F.covar_pop(x, y)
    return F.coalesce(vx * vy - c * c > eps * (vx + vy) * (vx + vy), F.lit(False))


def gate_reasons(ratio, retained, vsui, plane):
    return S.violations(
        (ratio < S.MIN_RATIO, "inlier ratio"), (retained < S.MIN_INLIERS, "retained count"), (~plane & (retained >= S.MIN_INLIERS), "no plane"), (vsui < S.MIN_VSUI, "uniformity"),
    )


#: Control points of one spline: the retained ties of a grid, 64 with its usual cells. They are collected, so more is an error.
CONTROLS = 1024


def spline_eval(points: DataFrame, coefficients: DataFrame, affine: tuple[float, float, float]) -> DataFrame:
    """v at each (x, y): the affine part and the weighted kernels of all control points; one row for each row of points.

    coefficients: cx, cy, w. They become a constant of the plan, so points are neither joined nor shuffled.
    """
    rows = coefficients.select("cx", "cy", "w").orderBy("cx", "cy", "w").limit(CONTROLS + 1).collect()
    if len(rows) > CONTROLS:
        raise ValueError(f"a spline of more than {CONTROLS} control points")
    x, y = F.col("x"), F.col("y")
    v = affine[0] + affine[1] * x + affine[2] * y
    if rows:
        control = F.array(*[F.struct(*(F.lit(float(r[c])).alias(c) for c in ("cx", "cy", "w"))) for r in rows])
        term = lambda c: c["w"] * S.spline_kernel((x - c["cx"]) * (x - c["cx"]) + (y - c["cy"]) * (y - c["cy"]))
        v = v + F.aggregate(control, F.lit(0.0), lambda total, c: total + term(c))
    return points.withColumn("v", v)


def lonlat(ties: DataFrame, west: float, north: float, step: float) -> DataFrame:
    """Adds lon and lat of pixel centres; longitude runs on beyond 180."""
    return ties.withColumns({"lon": west + (F.col("rx") + 0.5) * step, "lat": north - (F.col("ry") + 0.5) * step})


def csv_rows(t: DataFrame, columns: list[str]) -> DataFrame:
    return t.select("job", "i", F.concat_ws(",", *[F.coalesce(S.csv_field(F.col(c)), F.lit("")) for c in columns]).alias("line"))


#: Columns of a tie's record, and those that follow where a scene is a window of a larger one.
RECORD = ("point_id", "src_x", "src_y", "ref_x", "ref_y", "lat", "lon", "residual_px", "confidence")
FULL = ("src_full_x", "src_full_y", "ref_full_x", "ref_full_y")


def tie_records(t: DataFrame, keys: list[str], grid: tuple[float, float, float] | None = None, full: bool = False, wrap: bool = False) -> DataFrame:
    """keys, i, RECORD (and FULL), line (its CSV text) and violations of each tie.

    t: keys, i, point_id, sx, sy, rx, ry (of the window), res, conf, and with full the windows' origins sx0, sy0, rx0, ry0.
    With a grid (west, north, step of the window's first pixel; or columns of these names) lat and lon are those of
    reference pixel centres, else they are empty; wrap brings lon into -180..180. Ids are unique within keys.
    """
    c = F.col
    finite = lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)) & ~F.isnan(v)
    west, north, step = (F.lit(None).cast("double"),) * 3 if grid is None else (x if not isinstance(x, (int, float)) else F.lit(float(x)) for x in grid)
    lon = west + (c("rx") + 0.5) * step
    lon = F.pmod(lon + 180, F.lit(360.0)) - 180 if wrap else lon
    lat = north - (c("ry") + 0.5) * step
    # an id that is null is a violation of its own; ties that lie with their keys already are not moved for this
    t = t.withColumn("_again", c("point_id").isNotNull() & (F.count(F.lit(1)).over(Window.partitionBy(*keys, "point_id")) > 1))
    checks = (
        (F.coalesce(c("point_id"), F.lit("")) == "", "no id"), (c("_again"), "id again"), (~(finite(c("sx")) & finite(c("sy")) & finite(c("rx")) & finite(c("ry"))), "place"),
        (~(finite(c("res")) & (c("res") >= 0)), "residual"), (~(finite(c("conf")) & c("conf").between(0, 1)), "confidence"), (F.coalesce(~lat.between(-90, 90), F.lit(False)), "latitude"),
    )
    # a list is made of the few that have any
    bad = F.when(functools.reduce(lambda a, b: a | b, (x for x, _ in checks)), S.violations(*checks)).otherwise(F.array().cast("array<string>"))
    made = [c("point_id"), c("sx").alias("src_x"), c("sy").alias("src_y"), c("rx").alias("ref_x"), c("ry").alias("ref_y"), lat.alias("lat"), lon.alias("lon"), c("res").alias("residual_px"), c("conf").alias("confidence")]
    names = list(RECORD)
    if full:
        made += [(c(v) + c(f"{v}0")).alias(n) for v, n in zip(("sx", "sy", "rx", "ry"), FULL)]
        names += FULL
    t = t.select(*keys, "i", *made, bad.alias("violations"))
    # numbers need no quotes, and their text is not made again to look for what would
    text = lambda n: S.csv_field(c(n)) if n == "point_id" else c(n).cast("string")
    return t.withColumn("line", F.concat_ws(",", *[F.coalesce(text(n), F.lit("")) for n in names]))
