"""XML labels: fields by the local names of their tags, first one in document order; strict or lenient."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed limits of a label.
BYTES, ELEMENTS, DEPTH = 1 << 20, 20_000, 48
#: The local tag names (lower case) and the fields that they stand for.
TAGS = {
    "pixel_resolution": "gsd",
    "ground_sampling_distance": "gsd",
    "map_resolution": "gsd",
    "map_scale": "gsd",
    "spatial_resolution": "gsd",
    "incidence_angle": "incidence",
    "solar_incidence_angle": "incidence",
    "solar_incidence": "incidence",
    "incidence": "incidence",
    "emission_angle": "emission",
    "emission": "emission",
    "solar_azimuth_angle": "azimuth",
    "sub_solar_azimuth": "azimuth",
    "sun_azimuth": "azimuth",
    "solar_azimuth": "azimuth",
    "south_bounding_coordinate": "lat_min",
    "minimum_latitude": "lat_min",
    "southernmost_latitude": "lat_min",
    "north_bounding_coordinate": "lat_max",
    "maximum_latitude": "lat_max",
    "northernmost_latitude": "lat_max",
    "west_bounding_coordinate": "lon_min",
    "minimum_longitude": "lon_min",
    "westernmost_longitude": "lon_min",
    "east_bounding_coordinate": "lon_max",
    "maximum_longitude": "lon_max",
    "easternmost_longitude": "lon_max",
    "logical_identifier": "product_id",
    "product_id": "product_id",
    "data_set_id": "product_id",
    "instrument_name": "instrument",
    "instrument_id": "instrument",
}
FIELDS = sorted(set(TAGS.values()))
#: What a name must contain to be an instrument's.
INSTRUMENTS = ("tmc", "ohrc", "iirs", "nac", "camera", "spectrometer")


def nodes(data: bytes) -> list[tuple[int, str, str, str | None]]:
    """(order, local name, text, unit) of every element with text; refuses declarations and what exceeds the limits."""
    if len(data) > BYTES:
        raise ValueError("label too long")
    if re.search(rb"<!(?:DOCTYPE|ENTITY)", data, re.I):
        raise ValueError("declarations are not read")
    out, depth, n = [], 0, 0
    parser = ET.XMLPullParser(("start", "end"))
    parser.feed(data)
    parser.close()
    for event, e in parser.read_events():
        depth += 1 if event == "start" else -1
        n += event == "start"
        if n > ELEMENTS or depth > DEPTH:
            raise ValueError("too many elements, or too deep")
        if event == "start":
            e.set("_order", str(n))
        elif e.text and e.text.strip():
            unit = e.get("unit")
            out.append((int(e.get("_order")), e.tag.rpartition("}")[2], e.text.strip(), unit))
    return sorted(out)


def telemetry(labels: DataFrame, id_: str = "id", content: str = "content", strict: bool = True) -> DataFrame:
    """One row for each label with its fields as numbers in metres and degrees, and the list of violations.

    The box comes from the four edges where all are said, else from the least and largest of the corners.
    """
    from ..functions import scalar as S

    @F.udf("struct<nodes: array<struct<ord: int, tag: string, text: string, unit: string>>, error: string>", useArrow=True)
    def read(data):
        try:
            return nodes(bytes(data or b"")), None
        except (ValueError, ET.ParseError) as e:
            return None, f"unreadable: {type(e).__name__}"

    t = labels.select(id_, read(content).alias("r")).select(id_, "r.error", F.explode_outer("r.nodes").alias("n"))
    names = F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv])
    t = t.withColumn("field", F.try_element_at(names, F.lower("n.tag")))
    # a name that tells of an instrument is one, in capitals; what comes first counts
    named = (F.lower("n.tag") == "name") & F.lower("n.text").rlike("|".join(INSTRUMENTS))
    t = t.withColumns({"field": F.when(named, "instrument").otherwise(F.col("field")), "said": F.struct(F.when(named, F.upper("n.text")).otherwise(F.col("n.text")).alias("text"), "n.unit")})
    tag, value = F.lower("n.tag"), S.degrees_of(S.lenient_double(F.col("n.text")), F.coalesce("n.unit", F.lit("deg")))
    corner = lambda what: F.when(tag.contains(what) & tag.rlike("upper|lower|corner"), value)
    lat, lon = corner("latitude"), F.when(~tag.contains("latitude"), corner("longitude"))
    ends = t.groupBy(id_).agg(F.min(lat).alias("c_lat_min"), F.max(lat).alias("c_lat_max"), F.min(lon).alias("c_lon_min"), F.max(lon).alias("c_lon_max"))
    first = t.groupBy(id_, "error").pivot("field", FIELDS).agg(F.min_by("said", "n.ord")).join(ends, id_)
    number = lambda f: S.lenient_double(F.col(f)["text"])
    edges = ("lat_min", "lat_max", "lon_min", "lon_max")
    given, made = F.lit(True), F.col("c_lat_min").isNotNull() & F.col("c_lon_min").isNotNull()
    for f in edges:
        given = given & F.col(f).isNotNull()
    edge = lambda f: F.when(given, S.degrees_of(number(f), F.coalesce(F.col(f)["unit"], F.lit("deg")))).when(made, F.col(f"c_{f}"))
    unread = lambda f: F.col(f).isNotNull() & number(f).isNull()
    out = first.select(
        id_, "error", F.col("product_id")["text"].alias("product_id"), F.col("instrument")["text"].alias("instrument"),
        S.metres(number("gsd"), F.coalesce(F.col("gsd")["unit"], F.lit("m"))).alias("gsd"),
        *[S.degrees_of(number(f), F.coalesce(F.col(f)["unit"], F.lit("deg"))).alias(f) for f in ("incidence", "azimuth")],
        # what looks straight down need not say so
        F.when(F.col("emission").isNull() & F.col("error").isNull(), 0.0).otherwise(S.degrees_of(number("emission"), F.coalesce(F.col("emission")["unit"], F.lit("deg")))).alias("emission"),
        *[edge(f).alias(f) for f in edges], unread("emission").alias("_emission"), (given & reduce(lambda a, b: a | b, map(unread, edges))).alias("_edges"),
    )
    need = [(F.col(f).isNull(), f"missing {f}") for f in ("gsd", "incidence", "azimuth")] if strict else []
    checks = S.violations(
        (F.col("error").isNotNull(), "unreadable"), *need, (F.col("gsd") <= 0, "gsd"), (~F.col("incidence").between(0, 90), "incidence"), (~F.col("emission").between(0, 90), "emission"),
        ((F.col("azimuth") < 0) | (F.col("azimuth") >= 360), "azimuth"), ((F.col("lat_min") < -90) | (F.col("lat_max") > 90) | (F.col("lat_min") > F.col("lat_max")), "latitude"), (F.col("lon_min") > F.col("lon_max"), "longitude"),
        (F.col("_emission"), "emission number"), (F.col("_edges"), "box number"),
    )
    return out.withColumn("violations", checks).drop("_emission", "_edges")
