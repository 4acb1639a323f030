"""Labels, rasters and streams."""

import random

import numpy as np
import pytest

from selenite.plans import tiepoints
from selenite.sources import odl, raster, xmllabel
from selenite.streaming import jobs


def test_odl_values():
    text = b"A = 16#-F# /* no */ ; B = 2#-101# <m per s>\r\nC = (1.5, ('x y', NULL))\r\nOBJECT = T\r\n D = \"two\nlines END\"\r\nEND_OBJECT = T\r\nEND\r\nrest"
    rows, end = odl.statements(text)
    assert [(r[0], r[1], r[4], r[5], r[6]) for r in rows] == [
        ("", "A", "integer", "-15", None), ("", "B", "integer", "-5", "M PER S"), ("", "C", "real", "1.5", None), ("", "C", "string", "X Y", None), ("", "C", "null", "NULL", None), ("T", "D", "string", "two\nlines END", None),
    ]
    assert text[end:].strip() == b"rest"


@pytest.mark.parametrize("bad", [b"", b"A = ", b"A = (1", b"A = 1 2\nEND", b"OBJECT = X\nEND", b"END_OBJECT\nEND", b"A = 17#1#\nEND", b"A = -2#1#\nEND", b"A = 1234567890123456789012345\nEND", b"A = X <m>\nEND", b"A = 1e999\nEND", b"A = 'x\ny'\nEND", b"A = \"\\\"\nEND", b"^STRUCTURE = \"f\"\nEND", b"A = 1"])
def test_odl_malformed(bad):
    with pytest.raises(odl.OdlError):
        odl.statements(bad)


def test_odl_fuzz():
    r = random.Random(91)
    seed = b"PDS_VERSION_ID = PDS3\r\nOBJECT = A\r\n X = (1, 'b', 2#1#) <m>\r\nEND_OBJECT = A\r\nEND\r\n"
    for _ in range(2000):
        b = bytearray(seed)
        for _ in range(r.randint(0, 8)):
            b[r.randrange(len(b))] = r.randrange(256)
        try:
            odl.statements(bytes(b))
        except odl.OdlError:
            pass
        odl.is_label(b.decode("latin-1"))
    assert odl.is_label("/* x */ pds_version_id = PDS3\n") and not odl.is_label("\"PDS_VERSION_ID = PDS3\"")


def test_xml_limits():
    assert xmllabel.nodes(b"<a xmlns='u'><b unit='m'> 1 </b></a>") == [(2, "b", "1", "m")]
    for bad in (b"<!DOCTYPE a><a/>", b"<a>" * 60 + b"</a>" * 60, b"<a>" + b"<b/>" * 20_001 + b"</a>", b" " * (1 << 20) + b"<a/>"):
        with pytest.raises(ValueError):
            xmllabel.nodes(bad)


def test_padded_raw_rows(spark, tmp_path):
    a = np.arange(2 * 6 * 5).reshape(2, 6, 5).astype(">u2")
    rows = b"".join(b"PP" + r.tobytes() + b"S" for band in a for r in band)
    (tmp_path / "a.raw").write_bytes(b"H" * 10 + rows)
    o = {"dtype": ">u2", "width": 5, "height": 6, "bands": 2, "offset": 10, "prefix": 2, "suffix": 1, "x": 1, "y": 2, "w": 3, "h": 4}
    got = raster.read_raw(spark, f"file://{tmp_path}/a.raw", **o).collect()
    assert {(r.band, r.y, r.x): r.dn for r in got} == {(b, y, x): a[b, y, x] for b in range(2) for y in range(2, 6) for x in range(1, 4)}
    (tmp_path / "b.raw").write_bytes(rows[:50])
    with pytest.raises(Exception, match="ends within"):
        raster.read_raw(spark, f"file://{tmp_path}/b.raw", **o).collect()


def test_stream_equals_batch(spark, tmp_path):
    from selenite.plans.views import view

    ev = view(spark, "/root/testdata/sf0.001", "job_ev").withColumn("ts", tiepoints.F.col("ts").cast("timestamp"))
    ev = ev.withColumn("job", tiepoints.F.col("event_id") % 60)
    src = str(tmp_path / "in")
    for k, part in enumerate(ev.orderBy("ts", "event_id").toPandas().pipe(lambda p: np.array_split(p, 3))):
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(src)
    # a repeated delivery changes nothing
    ev.limit(5).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(ev.schema).parquet(src)
    q = jobs.state_stream(s, stall=None).writeStream.format("memory").queryName("job_states").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = {r.job: (r.status, r.progress) for r in spark.table("job_states").collect()}
    want = {r.job: (r.status, r.progress) for r in jobs.states(ev).collect()}
    assert got == want


def test_steps():
    s, seen = (None, 0), []
    for kind in ("processing", "queued", "queued", "progress", "processing", "processing", "progress", "complete", "failed", "progress"):
        s = jobs.step(*s, kind)
        seen.append(s)
    assert seen == [(None, 0), ("queued", 0), ("queued", 0), ("queued", 0), ("processing", 5), ("processing", 5), ("processing", 10), ("complete", 100), ("complete", 100), ("complete", 100)]


def chunked(kind, data):
    import struct
    import zlib

    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


@pytest.mark.parametrize("colour, count", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png_windows(colour, count):
    import struct
    import zlib

    r = np.random.default_rng(colour)
    a = r.integers(0, 256, (11, 7, count)).astype(np.uint8)
    if count in (2, 4):
        a[3, 2, -1] = 0
    lines, last = [], np.zeros(7 * count, int)
    for k, row in enumerate(a.reshape(11, -1).astype(int)):
        f = k % 5
        left = np.concatenate([np.zeros(count, int), row[:-count]])
        corner = np.concatenate([np.zeros(count, int), last[:-count]])
        p = left + last - corner
        near = np.where((abs(p - left) <= abs(p - last)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - last) <= abs(p - corner), last, corner))
        guess = [0, left, last, (left + last) // 2, near][f]
        lines.append(bytes([f]) + ((row - guess) % 256).astype(np.uint8).tobytes())
        last = row
    png = b"\x89PNG\r\n\x1a\n" + chunked(b"IHDR", struct.pack(">IIBBBBB", 7, 11, 8, colour, 0, 0, 0)) + chunked(b"IDAT", zlib.compress(b"".join(lines))) + chunked(b"IEND", b"")
    v, ok = raster.png_window(png, 1, 2, 5, 8)
    tone = a[..., 0] if count < 3 else a[..., :3].astype(float).mean(2)
    assert v == pytest.approx(tone[2:10, 1:6], abs=1e-4)
    assert (ok == (a[2:10, 1:6, -1] > 0 if count in (2, 4) else True)).all()


def test_png_bytes_read_back():
    a = np.random.default_rng(2).integers(0, 256, (9, 13)).astype(np.uint8)
    v, ok = raster.png_window(raster.png_bytes(a), 2, 1, 6, 7)
    assert (v == a[1:8, 2:8]).all() and ok.all()


@pytest.mark.parametrize("text, want", [(" 5.5 ", 5.5), ("\t-1e3\n", -1000.0), (".5", 0.5), ("5.", 5.0), ("5d", None), ("7f", None), ("0x1p3", None), ("1 2", None), ("", None), (None, None), ("inf", float("inf")), ("+1", 1.0), ("1e", None)])
def test_numbers_of_texts(spark, text, want):
    from pyspark.sql import functions as F

    from selenite.functions import scalar

    assert spark.createDataFrame([(text,)], "t string").select(scalar.lenient_double(F.col("t"))).first()[0] == want


def test_settings_without_text(spark):
    from selenite.functions import rules

    (row,) = rules.router_settings(spark.createDataFrame([(1, None)], "id int, text string")).collect()
    assert row.violations == ["no routing"]


def test_boxes_of_labels(spark):
    """Edges in radians, corners where an edge is missing, instruments by name, and no emission angle."""
    need = "<gsd>1</gsd><pixel_resolution unit='km/pixel'>2</pixel_resolution><incidence_angle>1</incidence_angle><solar_azimuth>2</solar_azimuth>"
    edges = "".join(f"<{n}_bounding_coordinate unit='rad'>{v}</{n}_bounding_coordinate>" for n, v in (("south", 0.5), ("north", 1), ("west", 1), ("east", 2)))
    corners = "<upper_left_latitude>4</upper_left_latitude><lower_right_latitude>-1</lower_right_latitude><corner_longitude>7</corner_longitude><upper_right_longitude unit='radian'>0.1</upper_right_longitude><upper_middle_latitude>x</upper_middle_latitude>"
    texts = [need + edges, need + corners + edges.replace("north_b", "nrth_b"), need + corners + edges, need + "<name>my Camera</name><instrument_id>z</instrument_id><emission>x</emission>", need + edges.replace(">2<", ">y<")]
    t = spark.createDataFrame([(i, f"<r>{x}</r>".encode()) for i, x in enumerate(texts)], "id int, content binary")
    got = {r.id: r for r in xmllabel.telemetry(t).collect()}
    box = lambda i: [None if v is None else round(v, 9) for v in (got[i].lat_min, got[i].lat_max, got[i].lon_min, got[i].lon_max)]
    rad = [round(float(np.degrees(v)), 9) for v in (0.5, 1, 1, 2)]
    assert box(0) == rad and box(2) == rad and box(1) == [-1, 4, round(float(np.degrees(0.1)), 9), 7]
    assert got[0].emission == 0 and got[0].gsd == 2000 and got[0].violations == []
    assert got[3].instrument == "MY CAMERA" and got[3].violations == ["emission number"] and "box number" in got[4].violations


STATES = [(mode, separate, attached) for mode in ("auto", "separate", "attached", "none") for separate in ("no", "ok", "bad") for attached in ("no", "ok", "differs", "bad")]


def test_label_modes(spark):
    """Expectations of the modes one by one: what is refused, and what is only warned of."""
    from selenite.operators import records

    kinds = "id int, width int, height int, bands int, dtype string, offset int, row_bytes int, product_id string, violations array<string>"
    row = lambda i, state, name: (i, 4 + (state == "differs"), 4, 1, "<i2", 0, 8, name, ["x"] if state == "bad" else [])
    of = lambda k, name: spark.createDataFrame([row(i, s[k], name) for i, s in enumerate(STATES) if s[k] != "no"], kinds)
    scenes = spark.createDataFrame([(i, s[0]) for i, s in enumerate(STATES)], "id int, mode string")
    got = {r.id: r for r in records.resolved(scenes, of(1, "urn:a:P1"), of(2, "p1"), of(0, None).where("id < 0")).collect()}
    for i, (mode, separate, attached) in enumerate(STATES):
        sound = separate == "no" or separate == "ok" and attached in ("no", "ok")
        if mode == "attached":  # a separate label, whatever it says, is overridden
            want = "attached" if attached in ("ok", "differs") else None
            assert bool(got[i].warnings) == (separate != "no")
        elif mode == "separate":
            want = "separate" if sound and separate == "ok" else None
        elif mode == "auto":
            want = ("separate" if sound else None) if separate != "no" else "attached" if attached in ("ok", "differs") else None
        else:
            want = None  # no container here
        assert got[i].route == want and bool(got[i].violations) == (want is None), (STATES[i], got[i])
        assert ("conflict" in got[i].violations) == (mode != "attached" and separate == "ok" and attached == "differs")


def test_overlap_of_windows(spark):
    from pyspark.sql import functions as F

    from selenite.functions import rules

    g = lambda west: (west, 10.0, 0.01, 64, 64)
    cases = [(g(359.8), g(-0.1), "verified_grid_overlap"), (g(359.8), g(60.0), "nonoverlap"), (g(1.0), None, "unknown"), (None, None, "unknown"), ((1.0, None, 0.01, 64, 64), g(1.0), "unknown"), (g(0.0), (0.0, 9.36, 0.01, 64, 64), "nonoverlap"), (g(0.0), (0.63, 9.37, 0.01, 64, 64), "verified_grid_overlap")]
    kind = "struct<west: double, north: double, step: double, width: int, height: int>"
    t = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], f"i int, a {kind}, b {kind}")
    got = {r.i: r.s for r in t.select("i", rules.overlap_status(F.col("a"), F.col("b")).alias("s")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]
