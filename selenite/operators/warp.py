"""Coordinate maps of splines, dense or from a lattice, and pictures resampled by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import image
from .ties import spline_eval

#: Pixels from which on a lattice of LATTICE is used where no step is given.
LARGE, LATTICE = 512 * 512, 8

Spline = tuple[DataFrame, tuple[float, float, float]]


def _both(points: DataFrame, sx: Spline, sy: Spline) -> DataFrame:
    """x, y and the splines' values sx, sy there, without a shuffle."""
    keep = [c for c in points.columns if c not in ("x", "y")]
    t = spline_eval(points, *sx).withColumnRenamed("v", "sx")
    return spline_eval(t, *sy).withColumnRenamed("v", "sy").select(*keep, "x", "y", "sx", "sy")


def coordinate_map(spark: SparkSession, width: int, height: int, sx: Spline, sy: Spline, step: int | None = None) -> DataFrame:
    """x, y, sx, sy of every pixel: where in the source it comes from. sx and sy are splines (cx, cy, w; affine part).

    With a step, displacements are evaluated on a lattice with one cell beyond the picture on each side, and
    the pixels of each cell interpolate its four corners; only the lattice is shuffled, never the pixels.
    """
    if step is None:
        step = LATTICE if width * height >= LARGE else 1
    if step == 1:
        n = spark.range(width * height)
        return _both(n.select((F.col("id") % width).cast("double").alias("x"), F.expr(f"id div {width}").cast("double").alias("y")), sx, sy).withColumns({"x": F.col("x").cast("int"), "y": F.col("y").cast("int")})
    if step < 1 or step % 2:
        raise ValueError("the step of a lattice is even")
    columns, rows, half = -(-width // step) + 2, -(-height // step) + 2, step // 2
    at = lambda k: k * step - half - 0.5
    n = spark.range(columns * rows).select((F.col("id") % columns).alias("i"), F.expr(f"id div {columns}").alias("j"))
    g = _both(n.select("i", "j", at(F.col("i")).alias("x"), at(F.col("j")).alias("y")), sx, sy)
    g = g.select("i", "j", (F.col("sx") - F.col("x")).alias("dx"), (F.col("sy") - F.col("y")).alias("dy"))
    # a lattice point is a corner of four cells; a cell has the corners 00, 10, 01, 11
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for b in (0, 1) for a in (0, 1)]))
    c = g.withColumn("c", corner).withColumns({"i": F.col("i") - F.col("c.a"), "j": F.col("j") - F.col("c.b")}).where((F.col("i") >= 0) & (F.col("j") >= 0))
    pick = lambda v, a, b: F.max(F.when((F.col("c.a") == a) & (F.col("c.b") == b), F.col(v))).alias(f"{v}{a}{b}")
    cells = c.groupBy("i", "j").agg(*[pick(v, a, b) for v in ("dx", "dy") for a in (0, 1) for b in (0, 1)])
    t = cells.withColumn("_u", F.explode(F.sequence(F.lit(0), F.lit(step - 1)))).withColumn("_v", F.explode(F.sequence(F.lit(0), F.lit(step - 1))))
    t = t.withColumns({"x": (F.col("i") * step - half + F.col("_u")).cast("int"), "y": (F.col("j") * step - half + F.col("_v")).cast("int")})
    t = t.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    fx, fy = (F.col("_u") + 0.5) / step, (F.col("_v") + 0.5) / step
    mixed = lambda v: (F.col(f"{v}00") * (1 - fx) + F.col(f"{v}10") * fx) * (1 - fy) + (F.col(f"{v}01") * (1 - fx) + F.col(f"{v}11") * fx) * fy
    return t.select("x", "y", (F.col("x") + mixed("dx")).alias("sx"), (F.col("y") + mixed("dy")).alias("sy"))


def warped(px: DataFrame, coordinates: DataFrame) -> DataFrame:
    """y, x, v: the source picture resampled by cubic weights at the places of a map."""
    return image.bicubic(coordinates.select("y", "x", "sx", "sy"), px).select("y", "x", "v")
