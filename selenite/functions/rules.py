"""Contracts and admission rules as column expressions: each gives a list of what is wrong, or the value that holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scalar as S

#: Default limits and weights of routing, and the largest error and least uniformity of a complete result.
ROUTING = {"entropy_threshold": 0.8, "geometry_threshold": 3.0, "w1": 0.5, "w2": 0.5}
LEAST_KEYPOINTS, LEAST_MATCHES, LEAST_INLIERS = 8, 8, 6
SOURCES = {"PDS3": "attached label", "PDS4": "separate label", "IMAGE_ONLY": "image header"}


def _no(x: Column) -> Column:
    return ~F.coalesce(x, F.lit(False))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def result_violations(status: Column, progress: Column, rmse: Column, ratio: Column, vsui: Column, preview: Column, image: Column, ties: Column) -> Column:
    """A result is complete or to be reviewed, with all its progress made; a complete one passes the gates and has its artifacts."""
    complete = status == "complete"
    return S.violations(
        (_no(status.isin("complete", "review_required")), "status"), (_no(progress == 100), "progress"), (rmse.isNotNull() & _no(finite(rmse) & (rmse >= 0)), "error"),
        (_no(ratio.between(0, 1)), "inlier ratio"), (_no(vsui.between(0, 1)), "uniformity"),
        (complete & _no((rmse <= S.MAX_RMSE) & (vsui >= S.MIN_VSUI)), "quality gates"), (complete & _no(preview & image & ties), "artifacts"),
    )


def match_violations(sx: Column, sy: Column, rx: Column, ry: Column, conf: Column) -> Column:
    return S.violations((~(finite(sx) & finite(sy) & finite(rx) & finite(ry)), "place"), (_no(finite(conf) & conf.between(0, 1)), "confidence"))


def legacy_gate(keypoints: Column, matches: Column, inliers: Column) -> Column:
    """The first gate of the simple matcher that a pair fails; null if none."""
    return F.when(_no(keypoints >= LEAST_KEYPOINTS), "too few keypoints").when(_no(matches >= LEAST_MATCHES), "too few matches").when(_no(inliers >= LEAST_INLIERS), "too few inliers")


def paired(source: Column, reference: Column) -> Column:
    return S.violations((source.isNull() != reference.isNull(), "telemetry of one picture"))


def grid_violations(west: Column, north: Column, step: Column, width: Column, height: Column) -> Column:
    """A grid of square pixels in degrees must lie on the globe and turn around it once at most."""
    return S.violations(
        (_no(west.between(-360, 360)), "west"), (_no(north.between(-90, 90)), "north"), (_no((step > 0) & (step <= 360)), "step"),
        (_no(north - height * step >= -90), "south"), (_no(width * step <= 360), "span"),
    )


def overlap_status(a: Column, b: Column) -> Column:
    """Of two windows (west, north, step, width, height): `unknown` where either has no grid, else whether they overlap at any turn of longitude."""
    known = F.lit(True)
    for g in (a, b):
        known = known & g.isNotNull() & g["west"].isNotNull() & g["north"].isNotNull() & g["step"].isNotNull()
    south = lambda g: g["north"] - g["height"] * g["step"]
    east = lambda g: g["west"] + g["width"] * g["step"]
    level = F.least(a["north"], b["north"]) > F.greatest(south(a), south(b))
    turns = [F.greatest(a["west"], b["west"] + t) < F.least(east(a), east(b) + t) for t in (-360.0, 0.0, 360.0)]
    meets = F.coalesce(level & (turns[0] | turns[1] | turns[2]), F.lit(False))
    return F.when(~F.coalesce(known, F.lit(False)), "unknown").when(meets, "verified_grid_overlap").otherwise("nonoverlap")


def box(edges: Column, corners: Column) -> Column:
    """Bounds by the four edges where all are there, else by the corners' least and largest; null without either."""
    names = ("lat_min", "lat_max", "lon_min", "lon_max")
    missing = F.array_except(F.array(*map(F.lit, names)), F.filter(F.array(*[F.when(edges[n].isNotNull(), F.lit(n)) for n in names]), lambda x: x.isNotNull()))
    lat, lon = F.transform(corners, lambda c: c["lat"]), F.transform(corners, lambda c: c["lon"])
    given = F.struct(*[edges[n].alias(n) for n in names], F.lit("edges").alias("source"))
    made = F.struct(F.array_min(lat).alias("lat_min"), F.array_max(lat).alias("lat_max"), F.array_min(lon).alias("lon_min"), F.array_max(lon).alias("lon_max"), F.lit("corners").alias("source"))
    return F.when(edges.isNotNull() & (F.size(missing) == 0), given).when(F.size(corners) > 0, made)


def per_band(values: Column, bands: Column, default: float) -> Column:
    """A value for each band: the default for all where none is given, null where their number is another."""
    return F.when(values.isNull(), F.array_repeat(F.lit(default), bands)).when(F.size(values) == bands, values)


def reordered(bands: Column) -> Column:
    """Colours stored in the order blue, green, red in their usual order; a fourth band stays last, fewer bands stay."""
    turned = F.concat(F.reverse(F.slice(bands, 1, 3)), F.slice(bands, 4, F.greatest(F.size(bands) - 3, F.lit(0))))
    return F.when(F.size(bands) >= 3, turned).otherwise(bands)


def with_sources(own: Column, source_format: Column, fields: tuple[str, ...]) -> Column:
    """The sources of fields: what is known stays, the rest comes from the format's label."""
    source = F.try_element_at(F.create_map(*[F.lit(x) for kv in SOURCES.items() for x in kv]), source_format)
    rest = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[source for _ in fields]))
    return F.map_concat(F.map_filter(rest, lambda k, _: ~F.map_contains_key(own, k)), own)


def told(state: Column, cause: Column, cancel: Column) -> tuple[Column, Column]:
    """State and error as a client sees them: a cause stays inside, and cancelling only closes a job that isn't finished."""
    stopped = cancel & state.isin("queued", "processing")
    return F.when(stopped, "cancelled").otherwise(state), F.when(stopped, "cancelled").when(state == "failed", "registration failed")


def admitted(size: Column, limit: int) -> Column:
    return F.coalesce(size.between(1, limit), F.lit(False))


def blocks(size: Column, block: int) -> Column:
    return F.ceil(F.coalesce(size, F.lit(0)) / block).cast("long")


def displayed(px: DataFrame, identity: bool, specials: list[float]) -> DataFrame:
    """y, x, display: uncalibrated bytes as they are, anything else stretched between two percentiles of the valid samples; masked ones are 0."""
    from ..operators import image

    px = px.withColumn("value", F.when(S.valid_dn(F.col("dn"), specials), F.col("dn")))
    if identity:
        return px.select("y", "x", F.coalesce("value", F.lit(0.0)).cast("int").alias("display"))
    return image.stretch(px, value="value").select("y", "x", "display")


def router_settings(files: DataFrame) -> DataFrame:
    """id, the four settings and violations of each text of settings (id, text): its section `routing`, one setting a line.

    Settings that are left out have their defaults; other sections are left alone; comments begin with #.
    """
    lines = F.transform(F.split("text", "\n"), lambda x: F.rtrim(F.regexp_replace(x, r"(^|\s)#.*$", "")))
    section = F.regexp_extract(F.array_join(F.filter(lines, lambda x: x != ""), "\n"), r"(?:^|\n)routing:((?:\n[ \t]+[^\n]*)*)", 1)
    t = files.withColumn("_has", F.col("text").rlike(r"(?m)^routing:\s*(#.*)?$"))
    pairs = F.transform(F.filter(F.split(section, "\n"), lambda x: F.trim(x) != ""), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    t = t.withColumn("_pairs", pairs)
    of = lambda k: F.get(F.filter("_pairs", lambda p: p["k"] == k), F.lit(0))
    settings = {k: F.when(of(k).isNull(), F.lit(default)).otherwise(S.lenient_double(of(k)["v"])) for k, default in ROUTING.items()}
    t = t.withColumns(settings)
    keys = F.transform("_pairs", lambda p: p["k"])
    bad = S.violations(
        (_no(F.col("_has")), "no routing"), (F.size(F.array_except(keys, F.array(*map(F.lit, ROUTING)))) > 0, "unknown key"), (F.size(F.array_distinct(keys)) < F.size(keys), "repeated key"),
        (F.exists(F.array(*map(F.col, ROUTING)), lambda v: _no(finite(v) & (v >= 0))), "value"),
    )
    return t.select("id", *ROUTING, bad.alias("violations"))
