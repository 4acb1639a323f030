"""Queries over label records, manifests, contracts and admission rules, with their SQL."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import records, warp
from ..shared import cut, dealt, shared_dir
from ..sources import raster
from .views import duck, view

Q, SQL = {}, {}


def query(f):
    Q[f.__name__] = f
    return f


def _part(spark, d):
    return view(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("id"), F.col("p_size").cast("bigint").alias("s"))


@query
def pds3_records(spark, d):
    """Attached labels to layout records: pointers in records and in bytes, and what is wrong with some of them."""
    t = dealt(_part(spark, d), "id").withColumn("rb", (F.col("s") % 8 + 1) * 200).withColumn("h", F.col("s") + 5)
    m = lambda k: F.col("id") % k == 0
    line = lambda *x: F.concat(*[v.cast("string") if not isinstance(v, str) else F.lit(v) for v in x], F.lit("\r\n"))
    text = F.concat(
        line("PDS_VERSION_ID = PDS3"), line("RECORD_TYPE = FIXED_LENGTH"), line("RECORD_BYTES = ", F.col("rb")), line("LABEL_RECORDS = 2"), line("FILE_RECORDS = ", F.col("h") + 2),
        F.when(m(17), line("^IMAGE = 1")).when(m(2), line("^IMAGE = 3")).otherwise(line("^IMAGE = ", F.col("rb") * 2 + 1, " <BYTES>")), line("TARGET_NAME = ", F.when(m(7), "MARS").otherwise("MOON")),
        line("OBJECT = IMAGE"), line(" LINES = ", F.col("h")), F.when(m(13), line(" LINES = ", F.col("h"))).otherwise(""), line(" LINE_SAMPLES = ", (F.col("rb") / 2).cast("int")), line(" SAMPLE_TYPE = MSB_INTEGER"),
        line(" SAMPLE_BITS = ", F.when(m(5), 12).otherwise(16)), line(" NULL = ", F.when(m(3), 70000).otherwise(-32768)), line(" OFFSET = 1.5"), line("END_OBJECT = IMAGE"), line("END"),
    )
    files = t.select("id", F.format_string("P%d.IMG", "id").alias("file_name"), (F.col("rb") * (F.col("h") + 2) - F.when(m(11), 1).otherwise(0)).alias("file_size"), text.cast("binary").alias("content"))
    r = records.pds3_attached(files)
    return r.select("id", "width", "height", "dtype", "offset", "end_byte", "value_offset", "target", F.concat_ws(";", "violations").alias("reasons"))


SQL["pds3_records"] = """with p as (select p_partkey::bigint id, (p_size % 8 + 1)::bigint * 200 rb, p_size::bigint + 5 h from part),
o as (select *, case when id % 17 = 0 then 0 else 2 * rb end "offset", rb * (h + 2) - case when id % 11 = 0 then 1 else 0 end size from p),
e as (select *, case when id % 5 <> 0 then "offset" + rb * h end end_byte from o)
select id, rb // 2 width, h height, case when id % 5 <> 0 then '>i2' end dtype, "offset", end_byte, 1.5::double value_offset, case when id % 7 = 0 then 'MARS' else 'MOON' end target,
 concat_ws(';', case when id % 13 = 0 then 'ambiguous' end, case when id % 11 = 0 then 'file records' end, case when id % 17 = 0 then 'pointer within label' end, case when id % 5 = 0 then 'sample type' end,
  case when id % 5 <> 0 and id % 3 = 0 then 'special value' end, case when end_byte > size then 'short file' end, case when id % 7 = 0 then 'target' end) reasons from e"""


@query
def pds4_records(spark, d):
    """XML labels to layout records: axes by their sequence numbers whatever their order in the text, and what is wrong with some."""
    t = dealt(_part(spark, d), "id")
    m = lambda k: F.col("id") % k == 0
    axis = lambda name, size, n: F.concat(F.lit(f"<Axis_Array><axis_name>{name}</axis_name><elements>"), size.cast("string"), F.lit("</elements><sequence_number>"), n.cast("string"), F.lit("</sequence_number></Axis_Array>"))
    line, sample = axis("Line", F.col("s"), F.lit(1)), axis("Sample", F.col("s") * 2, F.when(m(5), 3).otherwise(2))
    array = F.concat(
        F.lit('<Array_2D_Image><offset unit="byte">64</offset><axes>2</axes><axis_index_order>Last Index Fastest</axis_index_order><Element_Array><data_type>'), F.when(m(7), "UnsignedMSB3").otherwise("UnsignedLSB2"), F.lit("</data_type>"),
        F.when(m(4), "").otherwise("<scaling_factor>0.5</scaling_factor>"), F.lit("<value_offset>1</value_offset></Element_Array>"), F.when(m(3), F.concat(sample, line)).otherwise(F.concat(line, sample)),
        F.lit("<Special_Constants><missing_constant>"), F.when(m(19), "70000").otherwise("65535"), F.lit("</missing_constant></Special_Constants></Array_2D_Image>"),
    )
    size = F.col("s") * F.col("s") * 4 + 64
    file = F.concat(F.lit("<File><file_name>"), F.when(m(11), "other").otherwise(F.concat(F.lit("p"), F.col("id").cast("string"))), F.lit('.img</file_name><file_size unit="byte">'), size.cast("string"), F.lit("</file_size></File>"))
    area = F.concat(F.lit("<File_Area_Observational>"), file, array, F.lit("</File_Area_Observational>"), F.when(m(13), F.concat(F.lit("<File_Area_Observational_Supplemental>"), file, F.lit("</File_Area_Observational_Supplemental>"))).otherwise(""))
    xml = F.concat(
        F.lit('<Product_Observational xmlns="http://pds.nasa.gov/pds4/pds/v1"><Observation_Area><Target_Identification><name>'), F.when(m(17), "Mars").otherwise("Moon"),
        F.lit("</name></Target_Identification></Observation_Area>"), area, F.lit("</Product_Observational>"),
    )
    r = records.pds4_records(t.select("id", F.format_string("P%d.IMG", "id").alias("file_name"), size.alias("file_size"), xml.alias("content"), F.lit(None).cast("string").alias("container")))
    return r.select("id", "width", "height", "bands", "dtype", "offset", "end_byte", "scale", "value_offset", F.get("specials", F.lit(0)).alias("special"), "target", F.concat_ws(";", "violations").alias("reasons"))


SQL["pds4_records"] = """with p as (select p_partkey::bigint id, p_size::bigint s, p_partkey % 13 <> 0 one, p_partkey % 7 <> 0 typed from part)
select id, case when one then 2 * s end width, case when one then s end height, 1::bigint bands, case when one and typed then '<u2' end dtype, case when one then 64::bigint end "offset", case when one and typed then 64 + 4 * s * s end end_byte,
 case when not one or id % 4 = 0 then 1.0 else 0.5 end::double scale, case when one then 1.0 else 0.0 end::double value_offset, case when one then case when id % 19 = 0 then 70000.0 else 65535.0 end::double end special, case when id % 17 = 0 then 'mars' else 'moon' end target,
 concat_ws(';', case when not one then 'file area' end, case when one and id % 11 = 0 then 'file name' end, case when one and id % 5 = 0 then 'axes' end, case when one and not typed then 'sample type' end,
  case when one and typed and id % 19 = 0 then 'special value' end, case when id % 17 = 0 then 'target' end) reasons from p"""


@query
def resolve_labels(spark, d):
    """Which label of a scene counts in each mode: labels that are missing, broken, or differ in size, type or product among them."""
    t = _part(spark, d)
    m = lambda k: F.col("id") % k == 0
    layout = lambda w, kind: (w.cast("bigint").alias("width"), F.col("s").alias("height"), F.lit(1).alias("bands"), kind.alias("dtype"), F.lit(64).alias("offset"), (w * 2).cast("bigint").alias("row_bytes"))
    broken = lambda k: F.when(m(k), F.array(F.lit("size"))).otherwise(F.array().cast("array<string>")).alias("violations")
    separate = t.where("id % 2 = 0").select("id", *layout(F.col("s") + 1, F.lit("<u2")), F.format_string("urn:x:p%d", "id").alias("product_id"), broken(23))
    attached = t.where("id % 3 = 0").select("id", *layout(F.col("s") + F.when(m(5), 2).otherwise(1), F.when(m(7), ">i2").otherwise("<u2")), F.when(~m(17), F.format_string("P%d", F.when(m(13), F.col("id") + 1).otherwise(F.col("id")))).alias("product_id"), broken(19))
    container = t.where("id % 11 <> 0").select("id", *layout(F.col("s"), F.lit("|u1")))
    mode = F.element_at(F.array(*map(F.lit, ("auto", "attached", "separate", "none"))), (F.floor(F.col("id") / 6) % 4 + 1).cast("int"))
    r = records.resolved(t.select("id", mode.alias("mode")), separate, attached, container)
    return r.select("id", "mode", "route", "width", "dtype", *[F.concat_ws(";", c).alias(c) for c in ("conflicts", "warnings", "violations")])


#: The verdict for every mode and state of the two labels (no, ok, bad; `clash` where both are sound and differ), as the rules are written down.
SQL["resolve_labels"] = """with verdicts(mode, sep, att, clash, route, warnings, violations) as (values
 ('auto', 'no', 'no', false, 'container', '', ''), ('auto', 'no', 'ok', false, 'attached', '', ''), ('auto', 'no', 'bad', false, null, '', 'attached label'),
 ('auto', 'ok', 'no', false, 'separate', '', ''), ('auto', 'ok', 'ok', false, 'separate', '', ''), ('auto', 'ok', 'ok', true, null, '', 'conflict'), ('auto', 'ok', 'bad', false, null, '', 'conflict with a broken label'),
 ('auto', 'bad', 'no', false, null, '', 'separate label'), ('auto', 'bad', 'ok', false, null, '', 'separate label'), ('auto', 'bad', 'bad', false, null, '', 'separate label'),
 ('attached', 'no', 'no', false, null, '', 'no label'), ('attached', 'no', 'ok', false, 'attached', '', ''), ('attached', 'no', 'bad', false, null, '', 'attached label'),
 ('attached', 'ok', 'no', false, null, 'separate label overridden', 'no label'), ('attached', 'ok', 'ok', false, 'attached', 'separate label overridden', ''), ('attached', 'ok', 'ok', true, 'attached', 'separate label overridden', ''),
 ('attached', 'ok', 'bad', false, null, 'separate label overridden', 'attached label'), ('attached', 'bad', 'no', false, null, 'separate label overridden', 'no label'), ('attached', 'bad', 'ok', false, 'attached', 'separate label overridden', ''),
 ('attached', 'bad', 'bad', false, null, 'separate label overridden', 'attached label'),
 ('separate', 'no', 'no', false, null, '', 'no label'), ('separate', 'no', 'ok', false, null, '', 'no label'), ('separate', 'no', 'bad', false, null, '', 'no label'),
 ('separate', 'ok', 'no', false, 'separate', '', ''), ('separate', 'ok', 'ok', false, 'separate', '', ''), ('separate', 'ok', 'ok', true, null, '', 'conflict'), ('separate', 'ok', 'bad', false, null, '', 'conflict with a broken label'),
 ('separate', 'bad', 'no', false, null, '', 'separate label'), ('separate', 'bad', 'ok', false, null, '', 'separate label'), ('separate', 'bad', 'bad', false, null, '', 'separate label'),
 ('none', 'no', 'no', false, 'container', '', ''), ('none', 'no', 'ok', false, 'container', '', ''), ('none', 'no', 'bad', false, 'container', '', ''),
 ('none', 'ok', 'no', false, 'container', 'separate label ignored', ''), ('none', 'ok', 'ok', false, 'container', 'separate label ignored', ''), ('none', 'ok', 'ok', true, null, '', 'conflict'), ('none', 'ok', 'bad', false, null, '', 'conflict with a broken label'),
 ('none', 'bad', 'no', false, null, '', 'separate label'), ('none', 'bad', 'ok', false, null, '', 'separate label'), ('none', 'bad', 'bad', false, null, '', 'separate label')),
p as (select p_partkey::bigint id, p_size::bigint s, ['auto', 'attached', 'separate', 'none'][p_partkey // 6 % 4 + 1] mode, case when p_partkey % 2 <> 0 then 'no' when p_partkey % 23 = 0 then 'bad' else 'ok' end sep,
 case when p_partkey % 3 <> 0 then 'no' when p_partkey % 19 = 0 then 'bad' else 'ok' end att from part),
c as (select *, case when sep = 'ok' and att = 'ok' then concat_ws(';', case when id % 5 = 0 then 'width' end, case when id % 7 = 0 then 'dtype' end, case when id % 5 = 0 then 'row_bytes' end, case when id % 13 = 0 and id % 17 <> 0 then 'product_id' end) else '' end conflicts from p)
select id, mode, v.route0 route, case v.route0 when 'separate' then s + 1 when 'attached' then s + case when id % 5 = 0 then 2 else 1 end when 'container' then s end width,
 case v.route0 when 'separate' then '<u2' when 'attached' then case when id % 7 = 0 then '>i2' else '<u2' end when 'container' then '|u1' end dtype, conflicts, v.warnings, v.violations
from (select c.*, case when k.route = 'container' and id % 11 = 0 then null else k.route end route0, k.warnings, case when k.route = 'container' and id % 11 = 0 then 'no label' else k.violations end violations
 from c join verdicts k on k.mode = c.mode and k.sep = c.sep and k.att = c.att and k.clash = (conflicts <> '')) v"""


@query
def manifest_scan(spark, d):
    """Tile manifests as JSON, read strictly and held against their tiles."""
    t = _part(spark, d)
    m = lambda k: F.col("id") % k == 0
    digest = F.sha2(F.col("id").cast("string"), 256)
    tile = F.struct(F.when(m(13), -1).otherwise(3).alias("x"), F.lit(4).alias("y"), F.col("s").alias("width"), F.lit(8).alias("height"), F.lit(0).alias("band"))
    body = F.to_json(F.struct(
        F.lit("tile-1").alias("schema"), F.lit("A.IMG").alias("original_name"), F.when(m(7), "FITS").otherwise("PDS3").alias("original_format"), F.lit(999).alias("original_size"), F.sha2(F.lit("x"), 256).alias("original_sha256"),
        F.when(m(5), "not base64!").otherwise(F.base64(F.concat(F.lit("label "), F.col("id").cast("string")).cast("binary"))).alias("original_label_base64"), F.when(m(11), F.sha2(F.lit("y"), 256)).otherwise(digest).alias("tile_sha256"), tile.alias("tile"), F.lit("made").alias("extractor"),
    ))
    body = F.when(m(17), F.concat(F.lit('{"more": 1, '), F.substring(body, 2, 100_000))).otherwise(body)
    r = records.manifests(t.select("id", body.alias("content"), digest.alias("tile_digest"), F.when(m(3), F.col("s") + 1).otherwise(F.col("s")).alias("width"), F.lit(8).alias("height"), F.lit("<i2").alias("dtype"), F.lit(40).alias("layout_width"), F.lit(12).alias("layout_height"), F.lit(">i2").alias("layout_dtype")))
    return r.select("id", F.decode("label", "UTF-8").alias("label"), F.col("m.tile.x").alias("x"), F.concat_ws(";", "violations").alias("reasons"))


SQL["manifest_scan"] = """with p as (select p_partkey::bigint id, p_size s from part)
select id, case when id % 5 <> 0 then 'label ' || id end label, case when id % 13 = 0 then -1 else 3 end::bigint x,
 concat_ws(';', case when id % 17 = 0 then 'keys' end, case when id % 7 = 0 then 'format' end, case when id % 11 = 0 then 'tile digest' end, case when id % 5 = 0 then 'label' end,
  case when id % 13 = 0 or s > case when id % 13 = 0 then 41 else 37 end then 'tile' end, case when id % 3 = 0 then 'tile differs' end) reasons from p"""


@query
def result_contract(spark, d):
    """Results held against their contract: ranges, status, and what a complete one must bring."""
    o = view(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(F.array(*map(F.lit, ("complete", "review_required", "done"))), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("status"), F.lit(100).alias("progress"),
                                        F.when(F.col("o_orderkey") % 5 == 0, None).otherwise((F.col("o_custkey") % 80) / 100.0).alias("rmse"), ((F.col("o_custkey") % 60) / 50.0).alias("ratio"), ((F.col("o_orderkey") % 40 + 60) / 100.0).alias("vsui"),
                                        *[(F.col("o_custkey") % k != 0).alias(n) for n, k in (("preview", 4), ("image", 9), ("ties", 11))])
    bad = rules.result_violations(*[F.col(c) for c in ("status", "progress", "rmse", "ratio", "vsui", "preview", "image", "ties")])
    return o.select("id", "status", F.concat_ws(";", bad).alias("reasons"))


SQL["result_contract"] = """with o as (select o_orderkey id, ['complete', 'review_required', 'done'][o_orderkey % 3 + 1] status, case when o_orderkey % 5 <> 0 then (o_custkey % 80) / 100.0::double end rmse, (o_custkey % 60) / 50.0::double ratio, (o_orderkey % 40 + 60) / 100.0::double vsui,
 o_custkey % 4 <> 0 and o_custkey % 9 <> 0 and o_custkey % 11 <> 0 every from orders)
select id, status, concat_ws(';', case when status = 'done' then 'status' end, case when ratio > 1 then 'inlier ratio' end, case when status = 'complete' and (rmse is null or rmse > 0.5 or vsui < 0.75) then 'quality gates' end,
 case when status = 'complete' and not every then 'artifacts' end) reasons from o"""


@query
def match_contract(spark, d):
    """Matches held against their contract: finite places, confidences within 0 and 1."""
    t = view(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.when(F.col("l_partkey") % 9 == 0, F.lit(float("inf"))).otherwise(F.col("l_quantity")).alias("sx"),
                                          F.col("l_tax").alias("sy"), F.col("l_quantity").alias("rx"), F.when(F.col("l_suppkey") % 7 == 0, None).otherwise(F.col("l_tax")).alias("ry"), (F.col("l_discount") * 12).alias("conf"))
    bad = rules.match_violations(*[F.col(c) for c in ("sx", "sy", "rx", "ry", "conf")])
    return t.groupBy(F.concat_ws(";", bad).alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


SQL["match_contract"] = """select concat_ws(';', case when l_partkey % 9 = 0 or l_suppkey % 7 = 0 then 'place' end, case when l_discount * 12 < 0 or l_discount * 12 > 1 then 'confidence' end) reasons, count(*) n from lineitem group by 1"""


@query
def legacy_gates(spark, d):
    """The gates of the simple matcher: keypoints, ratio survivors and inliers."""
    c = view(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 12).alias("keypoints"), (F.col("c_custkey") % 10).alias("matches"), (F.col("c_nationkey") % 9).alias("inliers"))
    return c.select("id", rules.legacy_gate(F.col("keypoints"), F.col("matches"), F.col("inliers")).alias("reason"))


SQL["legacy_gates"] = """select c_custkey id, case when c_custkey % 12 < 8 then 'too few keypoints' when c_custkey % 10 < 8 then 'too few matches' when c_nationkey % 9 < 6 then 'too few inliers' end reason from customer"""


@query
def job_params(spark, d):
    """Parameters of a job: telemetry for both pictures or for neither, and a grid within the globe."""
    p = _part(spark, d)
    some = lambda k: F.when(F.col("id") % k != 0, F.col("s").cast("double"))
    t = p.select("id", some(2).alias("a"), some(3).alias("b"), (F.col("id") % 900 - 450).cast("double").alias("west"), (F.col("s") * 2 - 10).cast("double").alias("north"), (F.col("id") % 9 / 8.0).alias("step"), (F.col("s") * 10).alias("w"), (F.col("s") * 5).alias("h"))
    bad = F.concat(rules.paired(F.col("a"), F.col("b")), rules.grid_violations(*[F.col(c) for c in ("west", "north", "step", "w", "h")]))
    return t.select("id", F.concat_ws(";", bad).alias("reasons"))


SQL["job_params"] = """with p as (select p_partkey::bigint id, p_size s, (p_partkey % 900 - 450)::double west, (p_size * 2 - 10)::double north, (p_partkey % 9) / 8.0::double step from part)
select id, concat_ws(';', case when (id % 2 = 0) <> (id % 3 = 0) then 'telemetry of one picture' end, case when west < -360 or west > 360 then 'west' end, case when north < -90 or north > 90 then 'north' end,
 case when step <= 0 or step > 360 then 'step' end, case when north - s * 5 * step < -90 then 'south' end, case when s * 10 * step > 360 then 'span' end) reasons from p"""


@query
def nodata_fits(spark, d):
    """Whether a value of no data can be stored exactly in each sample type."""
    kinds = F.explode(F.array(*map(F.lit, ("|u1", "<i2", ">u4", "<f4", "<f8"))))
    v = F.when(F.col("id") % 4 == 0, F.col("s") / 10.0).when(F.col("id") % 4 == 1, F.col("s") * -1000.0).when(F.col("id") % 4 == 2, F.col("s") * 7.0).otherwise(F.lit(1e39))
    t = _part(spark, d).select("id", v.alias("v"), kinds.alias("dtype"))
    return t.select("id", "dtype", records.representable(F.col("v"), F.col("dtype")).alias("fits"))


SQL["nodata_fits"] = """with p as (select p_partkey::bigint id, case p_partkey % 4 when 0 then p_size / 10.0::double when 1 then p_size * -1000.0::double when 2 then p_size * 7.0::double else 1e39::double end v from part)
select id, dtype, case dtype when '|u1' then v between 0 and 255 and v = floor(v) when '<i2' then v between -32768 and 32767 and v = floor(v) when '>u4' then v between 0 and 4294967295 and v = floor(v)
 when '<f4' then abs(v) <= 3.4028234663852886e38::double and (case when abs(v) <= 3.4e38::double then v::float::double end) = v else true end fits from p, (select unnest(['|u1', '<i2', '>u4', '<f4', '<f8']) dtype)"""


@query
def corner_box(spark, d):
    """The box of a scene: its four edges where all are given, else the least and largest of its corners."""
    n = view(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("double").alias("k"))
    edge = lambda v, m: F.when(F.col("id") % m != 0, v)
    t = n.select("id", F.struct(edge(F.col("k") - 5, 3).alias("lat_min"), (F.col("k") + 5).alias("lat_max"), (F.col("k") * 2).alias("lon_min"), edge(F.col("k") * 2 + 3, 5).alias("lon_max")).alias("edges"),
                 F.when(F.col("id") % 4 != 0, F.array(*[F.struct((F.col("k") + a).alias("lat"), (F.col("k") * b).alias("lon")) for a, b in ((1.0, 1.0), (2.0, 1.5), (-1.0, 1.25), (0.0, 2.0))])).alias("corners"))
    box = rules.box(F.col("edges"), F.col("corners"))
    return t.select("id", box.alias("b")).select("id", "b.lat_min", "b.lat_max", "b.lon_min", "b.lon_max", F.col("b.source").alias("source"))


SQL["corner_box"] = """with s as (select s_suppkey id, s_nationkey::double k, s_suppkey % 3 <> 0 and s_suppkey % 5 <> 0 edges, s_suppkey % 4 <> 0 corners from supplier)
select id, case when edges then k - 5 when corners then k - 1 end lat_min, case when edges then k + 5 when corners then k + 2 end lat_max, case when edges then k * 2 when corners then least(k, k * 2) end lon_min,
 case when edges then k * 2 + 3 when corners then greatest(k, k * 2) end lon_max, case when edges then 'edges' when corners then 'corners' end source from s"""


@query
def band_values(spark, d):
    """Scales for each band (a default for all, or one each) and colours in their own order."""
    t = _part(spark, d).withColumn("bands", (F.col("s") % 4 + 1).cast("int"))
    given = F.when(F.col("id") % 2 == 0, F.transform(F.sequence(F.lit(1), F.when(F.col("id") % 3 == 0, F.col("bands") + 1).otherwise(F.col("bands"))), lambda i: i * 0.5))
    t = t.withColumns({"scales": rules.per_band(given, F.col("bands"), 1.0), "rgb": rules.reordered(F.transform(F.sequence(F.lit(1), F.col("bands")), lambda i: i * 10))})
    return t.select("id", F.concat_ws(",", F.col("scales").cast("array<string>")).alias("scales"), F.col("scales").isNull().alias("wrong"), F.concat_ws(",", F.col("rgb").cast("array<string>")).alias("rgb"))


SQL["band_values"] = """with p as (select p_partkey::bigint id, p_size % 4 + 1 b from part)
select id, case when id % 2 <> 0 then concat_ws(',', '1.0', case when b > 1 then '1.0' end, case when b > 2 then '1.0' end, case when b > 3 then '1.0' end)
 when id % 3 = 0 then '' else concat_ws(',', '0.5', case when b > 1 then '1.0' end, case when b > 2 then '1.5' end, case when b > 3 then '2.0' end) end scales, id % 6 = 0 wrong,
 case b when 1 then '10' when 2 then '10,20' when 3 then '30,20,10' else '30,20,10,40' end rgb from p"""


@query
def display_samples(spark, d):
    """Samples for display: bytes with no calibration as they are, others stretched between two percentiles; masked ones are 0."""
    px = view(spark, d, "px").withColumn("dn", F.floor("dn").cast("double"))
    return rules.displayed(px, identity=True, specials=[255.0]).withColumnRenamed("display", "plain").join(rules.displayed(px, identity=False, specials=[255.0]), ["y", "x"]).select("y", "x", "plain", "display")


SQL["display_samples"] = duck("""+f as (select y, x, floor(dn) dn, floor(dn) <> 255 ok from px), q as (select quantile_cont(dn, 0.01) lo, quantile_cont(dn, 0.99) hi from f where ok)
select y, x, case when ok then dn else 0 end::int plain, case when ok then round_even(least(greatest((dn - lo) * 255.0::double / (hi - lo), 0), 255), 0) else 0 end::int display from f, q""", "px")


@query
def provenance(spark, d):
    """Where each field of a record comes from: what a label says stays, the rest gets its format's source."""
    o = view(spark, d, "orders")
    own = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("width"), F.lit("by hand"))).otherwise(F.create_map().cast("map<string,string>"))
    m = rules.with_sources(own, F.element_at(F.array(*map(F.lit, ("PDS3", "PDS4", "IMAGE_ONLY"))), (F.col("o_custkey") % 3 + 1).cast("int")), ("width", "height", "dtype"))
    return o.select("o_orderkey", *[m[f].alias(f) for f in ("width", "height", "dtype")], F.size(m).alias("n"))


SQL["provenance"] = """with o as (select o_orderkey, ['attached label', 'separate label', 'image header'][o_custkey % 3 + 1] s from orders)
select o_orderkey, case when o_orderkey % 2 = 0 then 'by hand' else s end width, s height, s dtype, 3 n from o"""


@query
def job_errors(spark, d):
    """What a client is told about jobs: a failure's cause stays inside; a cancelled job that was still running is closed."""
    e = view(spark, d, "orders").select(F.col("o_orderkey").alias("job"), F.element_at(F.array(*map(F.lit, ("queued", "processing", "complete", "failed"))), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("state"),
                                        F.when(F.col("o_orderkey") % 4 == 3, F.concat(F.lit("Traceback: /srv/"), F.col("o_orderpriority"))).alias("cause"), (F.col("o_custkey") % 5 == 0).alias("cancel"))
    state, error = rules.told(F.col("state"), F.col("cause"), F.col("cancel"))
    return e.select("job", state.alias("state"), error.alias("error"))


SQL["job_errors"] = """select o_orderkey job, case when o_custkey % 5 = 0 and o_orderkey % 4 < 2 then 'cancelled' else ['queued', 'processing', 'complete', 'failed'][o_orderkey % 4 + 1] end state,
 case when o_custkey % 5 = 0 and o_orderkey % 4 < 2 then 'cancelled' when o_orderkey % 4 = 3 then 'registration failed' end error from orders"""


@query
def router_settings(spark, d):
    """Routing settings as text, one file a row: read strictly, defaults filled in, unknown keys and bad values refused."""
    p = _part(spark, d)
    m = lambda k: F.col("id") % k == 0
    text = F.concat(F.lit("# limits\nother:\n  x: 1\n"), F.when(m(7), "").otherwise("routing:\n"), F.when(m(2), F.concat(F.lit("  entropy_threshold: "), (F.col("s") / 10.0).cast("string"), F.lit("  # bits\n"))).otherwise(""),
                    F.when(m(3), "  w1: -1\n").otherwise(""), F.when(m(5), "  w3: 1\n").otherwise(""), F.lit("  w2: 0.25\n"))
    r = rules.router_settings(p.select("id", text.alias("text")))
    return r.select("id", "entropy_threshold", "geometry_threshold", "w1", "w2", F.concat_ws(";", "violations").alias("reasons"))


SQL["router_settings"] = """with p as (select p_partkey::bigint id, p_size s, p_partkey % 7 <> 0 has from part)
select id, case when has and id % 2 = 0 then s / 10.0 else 0.8 end::double entropy_threshold, 3.0::double geometry_threshold, case when has and id % 3 = 0 then -1.0 else 0.5 end::double w1, case when has then 0.25 else 0.5 end::double w2,
 concat_ws(';', case when not has then 'no routing' end, case when has and id % 5 = 0 then 'unknown key' end, case when has and id % 3 = 0 then 'value' end) reasons from p"""


@query
def upload_copy(spark, d):
    """Files that may be taken in: none that is empty or beyond the limit, in blocks whose sizes add up."""
    t = view(spark, d, "documents").select(F.col("doc_id").alias("id"), F.octet_length("text").cast("bigint").alias("n"))
    return t.select("id", rules.admitted(F.col("n"), 8192).alias("admitted"), rules.blocks(F.col("n"), 1024).alias("blocks"))


SQL["upload_copy"] = "select doc_id id, coalesce(octet_length(encode(text)), 0) between 1 and 8192 admitted, ceil(coalesce(octet_length(encode(text)), 0) / 1024.0)::bigint blocks from documents"


@query
def read_accounting(spark, d):
    """Windows of a raw raster read one by one: samples, valid ones among them, and the bytes and seeks that the reads really took."""
    from pyarrow import fs

    px = view(spark, d, "px").withColumn("dn", F.floor("dn").cast("double"))
    height = (px.agg(F.max("y")).first()[0] or 0) + 1
    store, root = fs.FileSystem.from_uri(folder := f"{shared_dir(spark)}/reads-{uuid.uuid4().hex}")
    store.create_dir(root, recursive=True)
    size = cut(raster.write_raw(px, f"{folder}/a.raw", ">i2", b"H" * 64)).first()
    # windows of 25 x 16 samples over the whole raster, the lowest ones as high as is left
    n = 0 if size is None or not size[0] > 64 else -(-height // 16)
    windows = spark.range(4 * n).select("id", (F.col("id") % 4 * 25).cast("int").alias("x"), F.expr("cast(id div 4 * 16 as int)").alias("y"))
    path = f"{folder}/a.raw"

    def run(batches):
        for b in batches:
            rows = []
            for i, x, y in zip(b["id"], b["x"], b["y"]):
                reader = raster.RawReader({"path": path, "dtype": ">i2", "width": 100, "height": height, "offset": 64, "x": x, "y": y, "w": 25, "h": min(16, height - y)})
                parts = [batch for p in reader.partitions() for batch in reader.read(p)]
                dn = np.concatenate([p.column(3).to_numpy() for p in parts])
                rows.append((i, len(dn), int((dn != 255).sum()), reader.bytes_read, reader.seeks, float(dn[dn != 255].sum())))
            yield pd.DataFrame(rows, columns=["id", "pixels", "valid", "bytes", "seeks", "total"])

    out = cut(windows.repartition("y").mapInPandas(run, "id bigint, pixels bigint, valid bigint, bytes bigint, seeks bigint, total double"))
    store.delete_dir(root)
    return out


SQL["read_accounting"] = duck("""select (y // 16 * 4 + x // 25)::bigint id, count(*) pixels, count(*) filter (floor(dn) <> 255) valid, 2 * count(*) bytes, count(distinct y) seeks, coalesce(sum(floor(dn)) filter (floor(dn) <> 255), 0)::double total
from px group by 1""", "px")


_CONTROLS = [(100.0 + 137 * k % 800, 50.0 + 211 * k % 900, ((k * 7) % 5 - 2) / 50000.0, ((k * 3) % 5 - 2) / 50000.0) for k in range(9)]


@query
def spline_map(spark, d):
    """The source place of every pixel of the raster by a lattice of step 8."""
    last = view(spark, d, "px").agg(F.max("y")).first()[0]
    control = lambda i: spark.createDataFrame([(a, b, (w, u)[i]) for a, b, w, u in _CONTROLS], "cx double, cy double, w double")
    args = (spark, 100, 1 if last is None else last + 1, (control(0), (1.5, 1.01, -0.02)), (control(1), (-2.0, 0.015, 0.99)))
    m = warp.coordinate_map(*args, step=8)
    return m.where(F.lit(last is not None)).select("x", "y", F.round("sx", 3).alias("sx"), F.round("sy", 3).alias("sy"))


def _spline_sql(x: str, y: str, w: int, affine: tuple[float, float, float]) -> str:
    r2 = lambda c: f"(({x} - {c[0]}::double) ** 2 + ({y} - {c[1]}::double) ** 2)"
    terms = " + ".join(f"{c[2 + w]!r}::double * case when {r2(c)} > 0 then {r2(c)} * ln({r2(c)}) * 0.5::double else 0 end" for c in _CONTROLS)
    return f"({affine[0]}::double + {affine[1]}::double * {x} + {affine[2]}::double * {y} + {terms})"


SQL["spline_map"] = duck(f"""+top as (select max(y) + 1 h from px), l as (select i, j, (i * 8 - 4.5)::double u, (j * 8 - 4.5)::double v from (select unnest(range({-(-100 // 8) + 2})) i), (select unnest(range((select (h + 7) // 8 + 2 from top))) j)),
g as (select i, j, {_spline_sql('u', 'v', 0, (1.5, 1.01, -0.02))} - u dx, {_spline_sql('u', 'v', 1, (-2.0, 0.015, 0.99))} - v dy from l),
p as (select x, y, (x + 4) // 8 i, (y + 4) // 8 j, ((x + 4) % 8 + 0.5) / 8.0::double fx, ((y + 4) % 8 + 0.5) / 8.0::double fy from px)
select x::int x, y::int y, round(x + sum(w * dx), 3) sx, round(y + sum(w * dy), 3) sy from (
 select x, y, dx, dy, (case when g.i = p.i then 1 - fx else fx end) * (case when g.j = p.j then 1 - fy else fy end) w from p join g on g.i between p.i and p.i + 1 and g.j between p.j and p.j + 1) group by 1, 2, x, y""", "px")


@query
def spline_warp(spark, d):
    """The pixels resampled along a dense map of two splines."""
    px = view(spark, d, "px")
    last = px.agg(F.max("y")).first()[0]
    height = 0 if last is None else last + 1
    control = lambda i: spark.createDataFrame([(a, b, (w, u)[i]) for a, b, w, u in _CONTROLS], "cx double, cy double, w double")
    m = warp.coordinate_map(spark, 100, height, (control(0), (1.5, 1.01, -0.02)), (control(1), (-2.0, 0.015, 0.99)), step=1)
    return warp.warped(px, m).select("y", "x", F.round("v", 3).alias("v"))


def _cubic(t: str) -> str:
    a = f"abs({t})"
    return f"(case when {a} <= 1 then ((1.25::double * {a} - 2.25::double) * {a} * {a} + 1) when {a} < 2 then ((({a} - 5) * {a} + 8) * {a} * -0.75::double + 3) else 0 end)"


SQL["spline_warp"] = duck(f"""+pt as (select y, x, {_spline_sql('x', 'y', 0, (1.5, 1.01, -0.02))} sx, {_spline_sql('x', 'y', 1, (-2.0, 0.015, 0.99))} sy from px),
t as (select y, x, sx, sy, floor(sy)::int + j ty, floor(sx)::int + i tx from pt, (select unnest([-1, 0, 1, 2]) i), (select unnest([-1, 0, 1, 2]) j))
select t.y, t.x, round(sum({_cubic('sx - tx')} * {_cubic('sy - ty')} * coalesce(dn, 0)), 3) v from t left join px on px.y = ty and px.x = tx group by 1, 2""", "px")


@query
def overlap_status(spark, d):
    """Whether the windows of customers' scenes overlap with those of their nations' suppliers: scenes without a grid among them.

    Equal windows of a nation are compared once and count as often as they stand, so no pair of copies is made."""
    grid = lambda k, some: F.when(some, F.struct(((k * 53) % 720 - 360).cast("double").alias("west"), ((k * 37) % 160 - 70).cast("double").alias("north"), F.lit(0.25).alias("step"), F.lit(200).alias("width"), F.lit(80).alias("height")))
    c = view(spark, d, "customer").select(F.col("c_custkey").alias("a"), F.col("c_nationkey").alias("n"), grid(F.col("c_custkey"), F.col("c_custkey") % 7 > 0).alias("ga"))
    s = view(spark, d, "supplier").select(F.col("s_suppkey").alias("b"), F.col("s_nationkey").alias("n"), grid(F.col("s_suppkey"), F.col("s_suppkey") % 5 > 0).alias("gb"))
    c, s = (t.groupBy("n", g).agg(F.count(F.lit(1)).alias(f"k{g}")) for t, g in ((c, "ga"), (s, "gb")))
    return c.join(s, "n").select("n", rules.overlap_status(F.col("ga"), F.col("gb")).alias("status"), (F.col("kga") * F.col("kgb")).alias("k")).groupBy("n", "status").agg(F.sum("k").alias("pairs"))


SQL["overlap_status"] = """with c as (select c_nationkey n, c_custkey % 7 > 0 known, (c_custkey * 53) % 720 - 360 w, (c_custkey * 37) % 160 - 70 t from customer),
s as (select s_nationkey n, s_suppkey % 5 > 0 known, (s_suppkey * 53) % 720 - 360 w, (s_suppkey * 37) % 160 - 70 t from supplier)
select c.n, case when not (c.known and s.known) then 'unknown' when abs(c.t - s.t) < 20 and (abs(c.w - s.w) < 50 or abs(c.w - s.w - 360) < 50 or abs(c.w - s.w + 360) < 50) then 'verified_grid_overlap' else 'nonoverlap' end status, count(*) pairs
from c join s on c.n = s.n group by 1, 2"""
