"""Scalar expressions over columns; all of them stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sphere's radius in metres, the gates of an accepted pair, the routing limits.
RADIUS_M = 1_737_400.0
MIN_RATIO, MIN_INLIERS, MIN_VSUI, MAX_RESIDUAL, MAX_RMSE = 0.70, 15, 0.75, 3.5, 0.5
ENTROPY_LIMIT, GEOMETRY_LIMIT, W_SCALE, W_ANGLE = 0.8, 3.0, 0.5, 0.5


def violations(*checks: tuple[Column, str]) -> Column:
    """The messages of all conditions that hold, in the order given."""
    return F.filter(F.array(*[F.when(bad, F.lit(text)) for bad, text in checks]), lambda x: x.isNotNull())


def valid_dn(dn: Column, specials: list[float] = (), low: float | None = None, high: float | None = None) -> Column:
    """Whether a raw sample is a measurement: finite, no special constant, within the limits."""
    ok = dn.isNotNull() & ~F.isnan(dn) & (F.abs(dn) != F.lit(float("inf")))
    if specials:
        ok = ok & ~dn.isin(*map(float, specials))
    if low is not None:
        ok = ok & (dn >= low)
    return ok & (dn <= high) if high is not None else ok


def calibrated(dn: Column, valid: Column, scale: float, offset: float) -> Column:
    """dn * scale + offset, null where invalid or no longer finite."""
    v = dn * F.lit(float(scale)) + F.lit(float(offset))
    return F.when(valid & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def stretched(v: Column, low: Column, high: Column) -> Column:
    """To 0..255 between two percentiles, rounded half to even; 0 for nulls and flat images."""
    w = F.rint(F.least(F.greatest((v - low) * 255.0 / (high - low), F.lit(0.0)), F.lit(255.0)))
    return F.when(v.isNotNull() & (high > low), w).otherwise(0.0)


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def metres(value: Column, unit: Column) -> Column:
    u = F.lower(unit)
    return F.when(u.contains("km"), value * 1000.0).when(u.contains("cm"), value * 0.01).when(u.contains("mm"), value * 0.001).otherwise(value)


def degrees_of(value: Column, unit: Column) -> Column:
    return F.when(F.lower(unit).contains("rad"), F.degrees(value)).otherwise(value)


def lenient_double(text: Column) -> Column:
    """The number that a text is, blanks around it aside; null for anything else, such as one with a type's letter or in hexadecimal."""
    number = F.regexp_extract(text, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?(?i:inf|infinity|nan))\s*$", 1)
    return F.nullif(number, F.lit("")).try_cast("double")


def local_name(tag: Column) -> Column:
    return F.substring_index(tag, "}", -1)


def scale_gap(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.greatest(a, b) / F.least(a, b))


def rectangle_area(lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column, radius: float = RADIUS_M) -> Column:
    """Square metres of a latitude and longitude rectangle on the sphere."""
    return F.lit(radius * radius) * F.abs(F.sin(F.radians(lat_max)) - F.sin(F.radians(lat_min))) * F.abs(F.radians(lon_max) - F.radians(lon_min))


def disparity(gsd_s: Column, gsd_r: Column, inc_s: Column, inc_r: Column, w1: float = W_SCALE, w2: float = W_ANGLE) -> Column:
    return w1 * F.abs(gsd_s / gsd_r - 1.0) + w2 * F.abs(inc_s - inc_r)


def wrapped(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def reflected(p: Column, n: Column) -> Column:
    """Index within 0..n-1 of a place beyond the border, mirrored about the edge samples as often as needed."""
    period = F.greatest(2 * (n - 1), F.lit(1))
    m = F.pmod(p, period)
    return F.when(n == 1, F.lit(0)).otherwise(F.least(m, period - m))


def homography(h: list[float], x: Column, y: Column) -> tuple[Column, Column]:
    """Projected x and y; infinite where the third coordinate vanishes."""
    w = h[6] * x + h[7] * y + h[8]
    ok = F.abs(w) > 1e-12
    inf = F.lit(float("inf"))
    return F.when(ok, (h[0] * x + h[1] * y + h[2]) / w).otherwise(inf), F.when(ok, (h[3] * x + h[4] * y + h[5]) / w).otherwise(inf)


def wallis_value(v: Column, m: Column, s: Column, mean: float = 128.0, std: float = 52.0, c: float = 0.8, b: float = 0.2) -> Column:
    """Locally conditioned sample, clipped to 0..255 and cut to an integer."""
    out = (v - m) * (c * std / (c * s + (1 - c) * std)) + b * mean + (1 - b) * m
    return F.floor(F.least(F.greatest(out, F.lit(0.0)), F.lit(255.0)))


def spline_kernel(r2: Column) -> Column:
    """r**2 * ln(r), 0 at 0, from the squared distance."""
    return F.when(r2 > 0, 0.5 * r2 * F.log(r2)).otherwise(0.0)


def quality_status(accepted: Column, validated: Column, rmse: Column, vsui: Column) -> Column:
    good = accepted & validated & rmse.isNotNull() & ~F.isnan(rmse) & (rmse <= MAX_RMSE) & (vsui >= MIN_VSUI)
    return F.when(good, F.lit("complete")).otherwise(F.lit("review_required"))


def grid_cell(v: Column, size: float, cells: int) -> Column:
    """Cell of a coordinate on a closed canvas; its far edge belongs to the last cell."""
    return F.least(F.floor(v / F.lit(float(size)) * cells), F.lit(cells - 1))


def csv_field(text: Column) -> Column:
    """Quoted where it must be, quotes doubled."""
    t = text.cast("string")
    return F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)
