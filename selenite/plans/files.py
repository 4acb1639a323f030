"""Queries that write and read files of the shared folder, or parse labels; numeric image kernels."""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import image, kernels, records
from ..shared import cut, dealt, shared_dir
from ..sources import bundles, odl, raster, tiff, xmllabel
from .views import duck, view

Q, SQL = {}, {}


def query(f):
    Q[f.__name__] = f
    return f


def _folder(spark):
    return f"{shared_dir(spark)}/raster-{uuid.uuid4().hex}"


@query
def raw_roundtrip(spark, d):
    """Pixels as a raw file with a header and big-endian samples, then a window of it by the data source."""
    px = view(spark, d, "px").withColumn("dn", F.floor("dn").cast("double"))
    from pyarrow import fs

    height = (px.agg(F.max("y")).first()[0] or 0) + 1
    if height < 3:  # no row within the window
        return px.select("y", "x", "dn").where(F.lit(False))
    store, root = fs.FileSystem.from_uri(folder := _folder(spark))
    store.create_dir(root, recursive=True)
    cut(raster.write_raw(px, f"{folder}/a.raw", ">i2", b"H" * 64))
    out = cut(raster.read_raw(spark, f"{folder}/a.raw", dtype=">i2", width=100, height=height, offset=64, x=5, y=1, w=90, h=height - 2))
    store.delete_dir(root)
    return out.select("y", "x", "dn")


SQL["raw_roundtrip"] = duck("select y, x, floor(dn)::double dn from px where x between 5 and 94 and y between 1 and (select max(y) from px) - 1", "px")


@query
def tiff_roundtrip(spark, d):
    """Tiles of pixels as images of 16-bit samples, and a window of each read back."""
    px = view(spark, d, "px").withColumns({"tile": F.floor(F.col("x") / 50).cast("bigint"), "row": F.floor(F.col("y") / 256).cast("bigint")})

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        t, r = int(pdf.tile.iloc[0]), int(pdf.row.iloc[0])
        a = raster.image_array(pdf.assign(x=pdf.x - 50 * t, y=pdf.y - 256 * r), "u2")
        return pd.DataFrame({"tile": [t], "row": [r], "tiff": [tiff.encoded(a, tiff.DEFLATE, rows=3)]})

    files = cut(px.groupBy("tile", "row").applyInPandas(write, "tile bigint, row bigint, tiff binary"))

    def read(batches):
        for b in batches:
            for t, r, raw in zip(b.tile, b.row, b.tiff):
                f, first = tiff.opened(raw), int(r == 0)
                if f.height <= first:
                    continue
                a = f.window(10, first, 30)[0][:, :, 0]
                y, x = np.indices(a.shape)
                yield pd.DataFrame({"tile": t, "y": (y.ravel() + first + 256 * r).astype("int32"), "x": (x.ravel() + 10).astype("int32"), "dn": a.ravel().astype(float)})

    return files.mapInPandas(read, "tile bigint, y int, x int, dn double")


SQL["tiff_roundtrip"] = duck("select (x // 50)::bigint tile, y, (x % 50)::int x, floor(dn)::double dn from px where x % 50 between 10 and 39 and y >= 1", "px")


@query
def tile_extract(spark, d):
    """Tiles of a raw raster with their manifests, which are read back and held against the tiles.

    A box beyond what a tile may hold is as many tiles, one below the other; what they hold is put together again."""
    px = view(spark, d, "px").withColumn("dn", F.floor("dn").cast("double"))
    from pyarrow import fs

    height = (px.agg(F.max("y")).first()[0] or 0) + 1
    store, root = fs.FileSystem.from_uri(folder := _folder(spark))
    store.create_dir(root, recursive=True)
    size = 0 if height < 4 else cut(raster.write_raw(px, f"{folder}/a.raw", ">i2", b"H" * 64)).first()[0]
    most = bundles.WINDOW_PIXELS // 20
    boxes = [(k, 10 * k, k % 3, 20, height - 3) for k in range(6)] if size else []
    r = spark.createDataFrame(boxes, "box int, x int, y int, w int, h int")
    # the box's number and the number of the part
    r = r.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("h") - 1) / most).cast("int")))).withColumn("id", F.col("part").cast("bigint") * 6 + F.col("box"))
    r = r.withColumns({"y": F.col("y") + F.col("part") * most, "h": F.least(F.lit(most), F.col("h") - F.col("part") * most)}).repartition("id").withColumns({
        "path": F.lit(f"{folder}/a.raw"), "file_size": F.lit(size), "file_sha256": F.sha2(F.lit("stated"), 256), "label": F.lit("H" * 64).cast("binary"), "format": F.lit("PDS3"), "dtype": F.lit(">i2"),
        "width": F.lit(100), "height": F.lit(height), "offset": F.lit(64), "prefix": F.lit(0), "suffix": F.lit(0), "band": F.lit(0),
    })
    bundles.publish(bundles.tile_bundles(r), f"{folder}/tiles")

    def read(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        of = dict(zip(b.name, b.content))
        raw = of["tile.tif"]
        a = tiff.opened(raw).window()[0][:, :, 0]
        return pd.DataFrame({"id": [int(key[0].removeprefix("tile-"))], "content": [of["tile.json"].decode()], "digest": [hashlib.sha256(raw).hexdigest()], "width": [a.shape[1]], "height": [a.shape[0]], "dtype": ["<" + a.dtype.str[1:]], "total": [float(a.astype(float).sum())]})

    store.create_dir(f"{root}/tiles", recursive=True)
    back = bundles.published(spark, f"{folder}/tiles").groupBy("bundle").applyInPandas(read, "id bigint, content string, digest string, width int, height int, dtype string, total double")
    t = back.select("id", "content", F.col("digest").alias("tile_digest"), "width", "height", "dtype", F.lit(100).alias("layout_width"), F.lit(height).alias("layout_height"), F.lit(">i2").alias("layout_dtype"), "total")
    parts = records.manifests(t).groupBy((F.col("id") % 6).alias("id"), F.col("m.tile.x").alias("x"))
    reasons = F.concat_ws(";", F.array_sort(F.array_distinct(F.flatten(F.collect_list("violations")))))
    out = cut(parts.agg(F.sum("height").cast("int").alias("height"), F.sum("total").alias("total"), reasons.alias("reasons")))
    store.delete_dir(root)
    return out


SQL["tile_extract"] = duck("""+b as (select k, 10 * k x0, k % 3 y0, (select max(y) from px) - 2 h from (select unnest(range(6)) k))
select k id, x0 x, h::int height, sum(floor(dn))::double total, '' reasons from b join px on x between x0 and x0 + 19 and y between y0 and y0 + h - 1 group by 1, 2, 3""", "px")


@query
def preview_png(spark, d):
    """A preview of the stretched, averaged pixels, at most 1024 of them along an axis, as a PNG in a data address."""
    px = view(spark, d, "px")
    side = max(x or 0 for x in px.agg(F.max("y"), F.max("x")).first()) + 1
    px = image.stretch(image.downsample(px, max(1, -(-side // 1024))), value="dn").select("y", "x", F.col("display").alias("dn"), F.lit(0).alias("scene"))

    def png(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"scene": [0], "png": [raster.png_bytes(raster.image_array(pdf, "u1"))]})

    p = px.groupBy("scene").applyInPandas(png, "scene bigint, png binary")  # at most 1024 x 1024 samples
    return p.select("scene", F.concat(F.lit("data:image/png;base64,"), F.translate(F.base64("png"), "\r\n", "")).alias("address"))


@query
def container_kinds(spark, d):
    """What files are by their first bytes: rows of pixels as images in two containers and as raw samples with and without a label, and texts."""
    px = view(spark, d, "px").withColumns({"tile": F.floor(F.col("y") / 16).cast("bigint")})

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf.tile.iloc[0])
        a = raster.image_array(pdf.assign(y=pdf.y - 16 * t), "u1")
        label = b"/* of a tile */ PDS_VERSION_ID = PDS3\r\nEND\r\n"
        return pd.DataFrame({"tile": t, "content": [tiff.encoded(a.astype("u2")), tiff.encoded(a), raster.png_bytes(a), label + a.tobytes(), b"\0" + a.tobytes()]})

    made = px.groupBy("tile").applyInPandas(write, "tile bigint, content binary")
    texts = view(spark, d, "documents").select(F.lit(-1).cast("bigint").alias("tile"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return made.unionByName(texts).groupBy("tile", raster.container(F.col("content")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


SQL["container_kinds"] = duck("""+t as (select distinct (y // 16)::bigint tile from px) select tile, kind, case kind when 'tiff' then 2 else 1 end::bigint n from t, (select unnest(['tiff', 'png', 'pds3', 'unknown']) kind)
union all select -1, case when text like 'BM%' then 'bmp' when contains(encode(text)[:4096]::varchar, 'PDS_VERSION_ID') then 'pds3' else 'unknown' end, count(*) from documents group by 1, 2""", "px")


def _labels(spark, d):
    p = dealt(view(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    text = F.format_string(
        "PDS_VERSION_ID = PDS3 /* made up */\r\nRECORD_BYTES = %d\r\n^IMAGE = (\"a.img\", %d <BYTES>)\r\nOBJECT = IMAGE\r\n LINES = 16#%s#\r\n NAME = 'low %d'\r\n SCALE = %d.5 <m>\r\n X = (1, (2, NULL))\r\nEND_OBJECT = IMAGE\r\n%s",
        "p_size", "p_partkey", F.hex("p_size"), F.col("p_partkey") % 7, F.col("p_size"), F.when(F.col("p_partkey") % 11 == 0, "END_GROUP\r\nEND\r\n").otherwise("END\r\n"),
    )
    return p.select(F.col("p_partkey").alias("id"), text.alias("text"), F.col("p_size").alias("size"))


@query
def odl_parse(spark, d):
    return odl.parsed(_labels(spark, d).withColumn("content", F.col("text").cast("binary"))).select("id", *odl.VALUES, "violation")


SQL["odl_parse"] = """with p as (select p_partkey id, p_size size from part),
v as (select id, unnest([
 {'path': '', 'key': 'PDS_VERSION_ID', 'ordinal': 1, 'item': 1, 'type': 'name', 'value': 'PDS3', 'unit': null},
 {'path': '', 'key': 'RECORD_BYTES', 'ordinal': 2, 'item': 1, 'type': 'integer', 'value': size::varchar, 'unit': null},
 {'path': '', 'key': '^IMAGE', 'ordinal': 3, 'item': 1, 'type': 'string', 'value': 'a.img', 'unit': null},
 {'path': '', 'key': '^IMAGE', 'ordinal': 3, 'item': 2, 'type': 'integer', 'value': id::varchar, 'unit': 'BYTES'},
 {'path': 'IMAGE', 'key': 'LINES', 'ordinal': 4, 'item': 1, 'type': 'integer', 'value': size::varchar, 'unit': null},
 {'path': 'IMAGE', 'key': 'NAME', 'ordinal': 5, 'item': 1, 'type': 'string', 'value': 'LOW ' || id % 7, 'unit': null},
 {'path': 'IMAGE', 'key': 'SCALE', 'ordinal': 6, 'item': 1, 'type': 'real', 'value': size || '.5', 'unit': 'M'},
 {'path': 'IMAGE', 'key': 'X', 'ordinal': 7, 'item': 1, 'type': 'integer', 'value': '1', 'unit': null},
 {'path': 'IMAGE', 'key': 'X', 'ordinal': 7, 'item': 2, 'type': 'integer', 'value': '2', 'unit': null},
 {'path': 'IMAGE', 'key': 'X', 'ordinal': 7, 'item': 3, 'type': 'null', 'value': 'NULL', 'unit': null}]) r from p where id % 11 <> 0)
select id, r.path path, r.key "key", r.ordinal ordinal, r.item item, r.type "type", r.value "value", r.unit unit, null::varchar violation from v
union all select id, null, null, null, null, null, null, null, 'a block ends that wasn''t begun' from p where id % 11 = 0"""


@query
def odl_tokens(spark, d):
    return odl.tokenised(_labels(spark, d))


@query
def odl_sniff(spark, d):
    """Which texts are labels: documents, and made-up labels and broken ones among them."""
    t = view(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    made = _labels(spark, d).select((F.col("id") + 10_000_000).alias("id"), F.when(F.col("id") % 5 == 0, F.replace("text", F.lit("PDS3"), F.lit("PDS4"))).when(F.col("id") % 5 == 1, F.concat(F.lit("= "), "text")).otherwise(F.col("text")).alias("text"))
    return odl.sniffed(t.unionByName(made))


SQL["odl_sniff"] = "select doc_id id, false is_label from documents union all select p_partkey + 10000000, p_partkey % 5 <> 0 from part"


@query
def xml_telemetry(spark, d):
    """Telemetry of XML labels with units, aliases, missing and broken ones among them."""
    p = view(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("s"))
    n = F.col("id")
    text = F.concat(
        F.lit('<r xmlns:q="urn:q"><q:product_id>P'), n.cast("string"), F.lit('</q:product_id><q:pixel_resolution unit="'), F.when(n % 2 == 0, "cm/pixel").otherwise("m"), F.lit('">'), F.col("s").cast("string"), F.lit("</q:pixel_resolution>"),
        F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("<incidence_angle>"), (n % 100).cast("string"), F.lit("</incidence_angle>"))),
        F.lit("<sun_azimuth>12</sun_azimuth><solar_azimuth>700</solar_azimuth>"), F.when(n % 13 == 0, "<r>").otherwise("</r>"),
    )
    t = xmllabel.telemetry(p.select("id", text.cast("binary").alias("content")))
    return t.select("id", "product_id", F.round("gsd", 6).alias("gsd"), "incidence", "azimuth", F.concat_ws(";", "violations").alias("reasons"))


SQL["xml_telemetry"] = """with p as (select p_partkey id, p_size s, p_partkey % 13 = 0 broken from part),
f as (select id, broken, case when not broken then 'P' || id end product_id, case when not broken then round(s * case when id % 2 = 0 then 0.01 else 1 end::double, 6) end gsd,
 case when not broken and id % 5 <> 0 then (id % 100)::double end incidence, case when not broken then 12.0::double end azimuth from p)
select id, product_id, gsd, incidence, azimuth, concat_ws(';', case when broken then 'unreadable' end, case when gsd is null then 'missing gsd' end, case when incidence is null then 'missing incidence' end,
 case when azimuth is null then 'missing azimuth' end, case when incidence > 90 then 'incidence' end) reasons from f"""


def _smooth(spark, d):
    """The pixels' local means: a picture that has structure at the scale of a keypoint."""
    return image.box_moments(view(spark, d, "px"), 2).select("y", "x", F.col("m").alias("dn"))


def _tile(pdf: pd.DataFrame) -> tuple[np.ndarray, int, int]:
    """A tile's window as an array, and its first row and column."""
    y0, x0 = int(pdf.y.min()), int(pdf.x.min())
    return raster.image_array(pdf.assign(y=pdf.y - y0, x=pdf.x - x0), "f8"), y0, x0


def _inside(key: tuple, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which places belong to the tile itself and not to its halo."""
    return (x // image.TILE == key[1]) & (y // image.TILE == key[0])


@query
def keypoints(spark, d):
    """The strongest keypoints of the smoothed pixels, found by tile with a halo: x, y, response, and what its descriptor adds up to, weighted by place."""

    def find(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, y0, x0 = _tile(pdf)
        if min(a.shape) < 8:
            return pd.DataFrame(columns=["x", "y", "response", "shape"])
        p, v = kernels.keypoints(a, contrast=0.01)
        x, y = p[:, 0] + x0, p[:, 1] + y0
        own = _inside(key, x, y)
        return pd.DataFrame({"x": x[own].astype(int), "y": y[own].astype(int), "response": p[own, 2].round(6), "shape": (v[own] @ np.arange(1, 129)).round(3)})

    k = image.tiled(_smooth(spark, d), 24, 24).groupBy("_ty", "_tx").applyInPandas(find, "x int, y int, response double, shape double")
    return k.orderBy(F.desc("response"), "y", "x").limit(1024)  # the strongest ones are the feature


@query
def lk_refine(spark, d):
    """Lattice points tracked by tile from the smoothed pixels to the same moved by (2, -1), there and back, kept by the survival rule."""
    m = _smooth(spark, d)
    both = m.withColumn("side", F.lit("a")).unionByName(m.select((F.col("y") - 1).alias("y"), (F.col("x") + 2).alias("x"), "dn", F.lit("b").alias("side")).where("y >= 0"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, y0, x0 = _tile(pdf[pdf.side == "a"]) if (pdf.side == "a").any() else (np.zeros((0, 0)), 0, 0)
        if min(a.shape) < 40:
            return pd.DataFrame(columns=["x", "y", "dx", "dy", "kept"])
        q = pdf[(pdf.side == "b") & (pdf.x - x0 < a.shape[1]) & (pdf.y - y0 < a.shape[0]) & (pdf.x >= x0) & (pdf.y >= y0)]
        b = a.copy()
        b[q.y.to_numpy() - y0, q.x.to_numpy() - x0] = q.dn.to_numpy()
        ys, xs = (range(-(-v // 12) * 12 + 24, v + n - 20, 12) for v, n in zip((y0, x0), a.shape))
        p = np.array([(x, y) for y in ys for x in xs], float).reshape(-1, 2)
        p = p[_inside(key, p[:, 0], p[:, 1])] - (x0, y0)
        to, ok = kernels.track(a, b, p, p)
        r, back = kernels.track(b, a, to, p)
        kept = ok & back & (np.hypot(*(r - p).T) <= 0.5) & (np.hypot(*(to - p).T) <= S.MAX_RESIDUAL)
        x, y = p.T + np.array([[x0], [y0]])
        return pd.DataFrame({"x": x.astype(int), "y": y.astype(int), "dx": (to - p)[:, 0].round(2), "dy": (to - p)[:, 1].round(2), "kept": kept})

    return image.tiled(both, 48, 48).groupBy("_ty", "_tx").applyInPandas(run, "x int, y int, dx double, dy double, kept boolean")
