"""The sink of bundles: whole or not at all, whatever fails."""

import json

import pytest
from pyspark.sql import functions as F

from selenite.sources import bundles

DATA = [(f"b{i}", f"{k}.txt", f"{i}{k}".encode()) for i in range(6) for k in "xyz"]


def names(folder):
    return sorted(p.relative_to(folder).as_posix() for p in folder.rglob("*") if p.is_file())


def files(spark, data=DATA):
    return spark.createDataFrame(data, bundles.FILES)


def test_whole_bundles(spark, tmp_path):
    bundles.publish(files(spark), f"file://{tmp_path}/out")
    got = {(r.bundle, r.name, bytes(r.content)) for r in bundles.published(spark, f"file://{tmp_path}/out").collect()}
    assert got == set(DATA)
    assert names(tmp_path / "out") == sorted([f"{b}/{n}" for b, n, _ in DATA] + [f"b{i}/manifest.json" for i in range(6)])
    assert set(json.loads((tmp_path / "out/b0/manifest.json").read_text())) == {"x.txt", "y.txt", "z.txt"}


def test_a_task_that_dies_publishes_nothing(spark, tmp_path):
    """A task fails after others have written their files; the same write succeeds later."""
    folder = tmp_path / "out"

    def dies(batches):
        for b in batches:
            yield b
            raise RuntimeError("killed")

    broken = files(spark).repartition("bundle").mapInArrow(dies, bundles.FILES)
    spark.dataSource.register(bundles.Bundles)
    with pytest.raises(Exception, match="killed"):
        broken.write.format("bundles").mode("append").option("path", f"file://{folder}").save()
    assert not folder.exists() or names(folder) == []
    bundles.publish(files(spark), f"file://{folder}")
    assert len(names(folder)) == 24


def test_a_commit_that_dies_can_run_again(spark, tmp_path):
    """After some bundles were moved and the driver died, the same write publishes the others; readers never saw half a bundle."""
    folder = tmp_path / "out"
    bundles.publish(files(spark).where("bundle in ('b1', 'b4')"), f"file://{folder}")
    stage = folder / ".stage-old/t/b0"
    stage.mkdir(parents=True)
    (stage / "x.txt").write_bytes(b"half")
    assert {r.bundle for r in bundles.published(spark, f"file://{folder}").collect()} == {"b1", "b4"}
    bundles.publish(files(spark), f"file://{folder}")
    got = {(r.bundle, r.name, bytes(r.content)) for r in bundles.published(spark, f"file://{folder}").collect()}
    assert got == set(DATA)


def test_other_contents_are_refused(spark, tmp_path):
    folder = tmp_path / "out"
    bundles.publish(files(spark).where("bundle = 'b1'"), f"file://{folder}")
    before = {n: (folder / n).read_bytes() for n in names(folder)}
    with pytest.raises(Exception, match="other contents"):
        bundles.publish(files(spark).withColumn("content", F.lit(b"new")), f"file://{folder}")
    assert {n: (folder / n).read_bytes() for n in names(folder)} == before
    with pytest.raises(Exception, match="overwritten"):
        files(spark).write.format("bundles").mode("overwrite").option("path", f"file://{folder}").save()


@pytest.mark.parametrize("bad", [("../b", "x", b""), ("b", "../x", b""), ("b", ".x", b""), ("b", "manifest.json", b""), ("", "x", b""), (None, "x", b"")])
def test_names(spark, tmp_path, bad):
    with pytest.raises(Exception, match="not a name"):
        bundles.publish(files(spark, [bad]), f"file://{tmp_path}/out")


def test_empty_and_doubled(spark, tmp_path):
    bundles.publish(files(spark, []), f"file://{tmp_path}/out")
    with pytest.raises(Exception, match="twice"):
        bundles.publish(files(spark, [("b", "x", b"1"), ("b", "x", None)]), f"file://{tmp_path}/out")
    assert not (tmp_path / "out").exists() or names(tmp_path / "out") == []


GRID = (359.9, 1.0, 0.01)


def tie(i, **change):
    return {"wy": 0, "wx": 0, "i": i, "point_id": f"LG-{i:04d}", "sx": 1.5, "sy": 2.5, "rx": 3.0 + i, "ry": 4.0, "res": 0.25, "conf": 0.5, "sx0": 24.0, "sy0": 24.0, "rx0": 30.0, "ry0": 40.0} | change


TIE = "wy bigint, wx bigint, i bigint, point_id string, sx double, sy double, rx double, ry double, res double, conf double, sx0 double, sy0 double, rx0 double, ry0 double"


def test_records_of_ties(spark):
    """Thirteen columns, longitudes within -180 and 180, CRLF-safe quoting, and what a row may not hold."""
    from selenite.operators import ties

    nan, inf = float("nan"), float("inf")
    data = [tie(0), tie(1, point_id='a "b",\r\nc'), tie(2, point_id="LG-0003"), tie(3), tie(4, sx=nan), tie(5, ry=inf), tie(6, res=-1.0), tie(7, conf=1.01), tie(8, ry=9200.0), tie(9, point_id=None), tie(10, res=None), tie(11, wx=1, point_id="LG-0000")]
    t = spark.createDataFrame([tuple(r[c.split()[0]] for c in TIE.split(", ")) for r in data], TIE)
    got = {r.i: r for r in ties.tie_records(t, ["wy", "wx"], GRID, full=True, wrap=True).collect()}
    assert {i: r.violations for i, r in got.items() if r.violations} == {2: ["id again"], 3: ["id again"], 4: ["place"], 5: ["place", "latitude"], 6: ["residual"], 7: ["confidence"], 8: ["latitude"], 9: ["no id"], 10: ["residual"]}
    r = got[0]
    assert (r.src_full_x, r.ref_full_y) == (25.5, 44.0) and r.lat == 1.0 - 4.5 * 0.01 and r.lon == pytest.approx(359.9 + 0.035 - 360)
    assert r.line == f"LG-0000,1.5,2.5,3.0,4.0,{r.lat},{r.lon},0.25,0.5,25.5,26.5,33.0,44.0"
    assert got[1].line.startswith('"a ""b"",\r\nc",1.5')
    plain = {r.i: r for r in ties.tie_records(t, ["wy", "wx"]).collect()}
    assert plain[0].line == "LG-0000,1.5,2.5,3.0,4.0,,,0.25,0.5" and plain[8].violations == []


@pytest.mark.parametrize("cubic", [False, True])
def test_support(spark, cubic):
    """A place is supported where each sample that has a weight is there and valid; whole places need one sample only."""
    import numpy as np

    from selenite.operators import image

    dn = {(y, x): float(x + 10 * y) for y in range(8) for x in range(8)}
    dn[4, 4] = None
    px = spark.createDataFrame([(y, x, v) for (y, x), v in dn.items()], "y int, x int, dn double")
    places = [(2.0, 2.0), (4.0, 4.0), (3.5, 4.0), (3.0, 4.0), (2.5, 2.5), (4.5, 3.0), (-0.5, 1.0), (7.0, 7.0), (7.25, 1.0), (None, 1.0), (1.25, 5.75)]
    got = {(r.sx, r.sy): (r.ok, r.v) for r in image.supported(spark.createDataFrame(places, "sx double, sy double"), px, cubic).collect()}
    for sx, sy in places:
        if sx is None:
            assert got[sx, sy] == (False, 0.0)
            continue
        w = (lambda t: float(image.cubic_weight(np.array(t)))) if cubic else (lambda t: max(0.0, 1 - abs(t)))
        used = {(y, x): w(sx - x) * w(sy - y) for y in range(-3, 11) for x in range(-3, 11) if abs(w(sx - x) * w(sy - y)) > 1e-12}
        ok = all(dn.get(k) is not None for k in used)
        assert got[sx, sy][0] == ok and got[sx, sy][1] == pytest.approx(sum(v * dn[k] for k, v in used.items()) if ok else 0.0)


def scene(spark, height=20, width=30):
    return spark.createDataFrame([(y, x, float(y * width + x), (x + y) % 5 > 0) for y in range(height) for x in range(width)], "y int, x int, v double, ok boolean")


def test_windows_with_masks(spark, tmp_path):
    """Windows at the scene's edges are smaller; each has its own grid, mask and ties, or none."""
    import csv
    import io

    from selenite.operators import ties
    from selenite.sources import tiff

    t = spark.createDataFrame([tuple(r[c.split()[0]] for c in TIE.split(", ")) for r in (tie(0), tie(1, wy=1, wx=1), tie(2, wy=1, wx=1))], TIE)
    rows = ties.tie_records(t, ["wy", "wx"], GRID, full=True)
    folder = f"file://{tmp_path}/out"
    bundles.publish(bundles.window_bundles(scene(spark), rows, 16, 16, GRID, 0.5, 1.0, (*ties.RECORD, *ties.FULL)), folder)
    got = {}
    for r in bundles.published(spark, folder).collect():
        got.setdefault(r.bundle, {})[r.name] = bytes(r.content)
    assert set(got) == {f"window-{a}-{b}" for a in (0, 1) for b in (0, 1)}
    for name, of in got.items():
        wy, wx = map(int, name.split("-")[1:])
        f = tiff.opened(of[bundles.IMAGE])
        a, ok = f.window()
        assert a.shape == (16 if wy == 0 else 4, 16 if wx == 0 else 14, 1) and a.dtype == "f8"
        for y in range(a.shape[0]):
            for x in range(a.shape[1]):
                good = (wy * 16 + y + wx * 16 + x) % 5 > 0
                assert ok[y, x] == good and a[y, x, 0] == (float((wy * 16 + y) * 30 + wx * 16 + x) if good else 0.0)
        assert f.grid() == (GRID[0] + wx * 16 * 0.01, GRID[1] - wy * 16 * 0.01, 0.01) and tiff.on_the_moon(f.crs())
        said = json.loads(of[bundles.DOSSIER])
        assert said["valid_pixels"] == ok.sum() and said["ties"] == len(list(csv.reader(io.StringIO(of[bundles.TIES].decode(), newline="")))) - 1 == {(0, 0): 1, (1, 1): 2}.get((wy, wx), 0)
        assert of[bundles.TIES].startswith(b"point_id,src_x,src_y,ref_x,ref_y,lat,lon,residual_px,confidence,src_full_x,src_full_y,ref_full_x,ref_full_y\r\n")


@pytest.mark.parametrize("change, match", [({"conf": 2.0}, "confidence"), ({"wy": 7}, "no image")])
def test_windows_that_are_refused(spark, tmp_path, change, match):
    """One bad tie, or a window without an image, and nothing at all is published."""
    from selenite.operators import ties

    t = spark.createDataFrame([tuple(r[c.split()[0]] for c in TIE.split(", ")) for r in (tie(0), tie(1, wx=1, **change))], TIE)
    with pytest.raises(Exception, match=match):
        bundles.publish(bundles.window_bundles(scene(spark), ties.tie_records(t, ["wy", "wx"]), 16, 16, columns=ties.RECORD), f"file://{tmp_path}/out")
    assert not (tmp_path / "out").exists() or names(tmp_path / "out") == []
    with pytest.raises(Exception, match="gaps"):
        bundles.publish(bundles.window_bundles(scene(spark).where("x <> 3"), ties.tie_records(t.limit(0), ["wy", "wx"]), 16, 16), f"file://{tmp_path}/out")


def test_extracted_tiles(spark, tmp_path):
    """Windows of a raw raster as images with manifests; a retry after a crash succeeds, another tile of the name doesn't."""
    import numpy as np

    from selenite.sources import tiff

    a = np.arange(12 * 10).reshape(12, 10).astype(">i2")
    (tmp_path / "a.raw").write_bytes(b"H" * 8 + b"".join(b"P" + r.tobytes() for r in a))
    kinds = "id bigint, path string, file_size bigint, file_sha256 string, label binary, format string, dtype string, width int, height int, offset int, prefix int, suffix int, x int, y int, w int, h int, band int"
    row = lambda i, x: (i, f"file://{tmp_path}/a.raw", 260, "0" * 64, b"H", "PDS3", ">i2", 10, 12, 8, 1, 0, x, 3, 4, 5, 0)
    requests, folder = spark.createDataFrame([row(1, 2), row(2, 6)], kinds), f"file://{tmp_path}/out"
    for _ in range(2):
        bundles.publish(bundles.tile_bundles(requests), folder)
    got = {(r.bundle, r.name): bytes(r.content) for r in bundles.published(spark, folder).collect()}
    assert (tiff.opened(got["tile-1", "tile.tif"]).window()[0][:, :, 0] == a[3:8, 2:6]).all() and (tiff.opened(got["tile-2", "tile.tif"]).window()[0][:, :, 0] == a[3:8, 6:]).all()
    assert json.loads(got["tile-2", "tile.json"])["tile"] == {"x": 6, "y": 3, "width": 4, "height": 5, "band": 0}
    for bad, match in ((row(1, 3), "other contents"), (row(3, 8), "outside")):
        with pytest.raises(Exception, match=match):
            bundles.publish(bundles.tile_bundles(spark.createDataFrame([bad], kinds)), folder)


@pytest.mark.parametrize("most", [20 * 4, 20 * 7])
def test_boxes_beyond_a_tile(spark, monkeypatch, most):
    """A box of more samples than a tile may hold is many tiles; rows, samples and totals are those of the whole box."""
    from selenite.plans import files

    want = sorted(map(tuple, files.tile_extract(spark, "/root/testdata/sf0.01").collect()))
    monkeypatch.setattr(bundles, "WINDOW_PIXELS", most)
    assert sorted(map(tuple, files.tile_extract(spark, "/root/testdata/sf0.01").collect())) == want and len(want) == 6


def test_windows_below_the_globe(spark, monkeypatch):
    """A raster longer than from pole to pole is scenes one below the other; results are those of going on south."""
    from selenite.plans import exports

    want = sorted(map(tuple, exports.window_bundle(spark, "/root/testdata/sf0.01").collect()))
    monkeypatch.setattr(exports, "TURN", 1)
    got = sorted(map(tuple, exports.window_bundle(spark, "/root/testdata/sf0.01").collect()))
    assert [(r[0], *(pytest.approx(v) for v in r[1:])) for r in got] == want
    # the second row of windows would lie below the pole
    monkeypatch.setattr(exports, "GRID", (359.5, -89.0, 0.01))
    assert len(exports.window_bundle(spark, "/root/testdata/sf0.01").collect()) == len(want)


def test_files_come_in_small_batches(spark, tmp_path):
    """Contents of a task don't come as one batch, and a session's own setting is the same afterwards."""
    from selenite.shared import small_batches

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    kept = spark.conf.get(name, None)
    t = spark.range(64, numPartitions=1).select(F.expr("cast(repeat('x', 1 << 20) as binary)").alias("content"))

    def largest(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    with small_batches(spark):
        assert spark.conf.get(name) == str(4 << 20)
        assert t.mapInArrow(largest, "n bigint").agg(F.max("n")).first()[0] <= 5
    assert spark.conf.get(name, None) == kept
    bundles.publish(files(spark), f"file://{tmp_path}/out")
    assert spark.conf.get(name, None) == kept


def test_windows_by_strips(spark, monkeypatch, tmp_path):
    """Strips of windows are published one after the other: texts of one only are on the disk, no shuffle stays, and rows are those of a single strip."""
    from pathlib import Path

    from selenite import shared
    from selenite.plans import exports

    want = sorted(map(tuple, exports.window_bundle(spark, "/root/testdata/sf0.01").collect()))
    monkeypatch.setattr(shared, "ROUND", 12_000)
    monkeypatch.setattr(exports, "_folder", lambda spark: f"file://{tmp_path}/out")
    plain, strips = bundles.publish, []

    def publish(files, folder, **how):
        plain(files, folder, **how)
        there = sorted((tmp_path / "out").glob("*/window-*"))
        strips.append({p.name for p in there})
        assert {p.parent for p in there} == {Path(folder.removeprefix("file://"))} and all((p / bundles.TIES).exists() for p in there)

    monkeypatch.setattr(bundles, "publish", publish)
    got = sorted(map(tuple, exports.window_bundle(spark, "/root/testdata/sf0.01").collect()))
    assert got == want and len(want) == 4
    assert len(strips) > 1 and sorted(x for s in strips for x in s) == [r[0] for r in want]
    assert not (tmp_path / "out").exists()


def test_ties_of_strips_are_numbered_as_a_whole(spark, monkeypatch, tmp_path):
    """Numbers made by ranges of orders are those of the view, and each tie is in the strip of its window."""
    from selenite import shared
    from selenite.plans import exports, views

    d = "/root/testdata/sf0.01"
    monkeypatch.setattr(shared, "ROUND", 12_000)
    monkeypatch.setattr(views, "CELL", 10)
    monkeypatch.setattr(exports, "CELL", 10)
    lines = views.tie_lines(views.view(spark, d, "lineitem"))
    assert len(shared.rounds(views.tie_bases(lines), "cell")) > 3
    strips = [(0, 1, 0), (2, 4, 0), (5, 9, 0)]
    kept = exports._kept_ties(spark, lines, lambda t: t.withColumns({"wy": F.floor(F.col("ry") / 102).cast("bigint"), "wx": F.lit(0).cast("bigint")}), strips, f"file://{tmp_path}/ties")
    want = sorted(map(tuple, views.view(spark, d, "tie").select("job", "i", "rx", "ry", "sx", "sy", "conf").collect()))
    assert sorted(map(tuple, kept.selectExpr("job", "i", *views.PLACE).select("job", "i", "rx", "ry", "sx", "sy", "conf").collect())) == want
    assert {(r.strip, r.wy) for r in kept.select("strip", "wy").distinct().collect()} == {(0, 0), (0, 1), (1, 2), (1, 3), (1, 4), (2, 5), (2, 6), (2, 7), (2, 8), (2, 9)}


def test_rounds(spark, monkeypatch):
    """Ranges follow one another, hold every key, and have few rows unless a range of keys that is counted as one has more."""
    from selenite import shared

    monkeypatch.setattr(shared, "ROUND", 10)
    counts = lambda rows: spark.createDataFrame(rows, "k bigint, n bigint")
    assert shared.rounds(counts([]), "k") == []
    assert shared.rounds(counts([(-3, 4), (-2, 4), (0, 9), (7, 30), (8, 1), (None, 5)]), "k")[:3] == [(-3, -2, 8), (0, 0, 9), (7, 7, 30)]
    many = shared.rounds(counts([(k * 1000 - 2**40, 1) for k in range(5000)]), "k")
    assert len(many) <= 2 * shared.ROUNDS + 1 and sum(n for *_, n in many) == 5000 and max(n for *_, n in many) <= -(-5000 // shared.ROUNDS)
    assert all(a[1] < b[0] for a, b in zip(many, many[1:])) and many[0][0] == -(2**40) and many[-1][1] >= 4999 * 1000 - 2**40


def test_files_that_are_together(spark, tmp_path):
    """Files that lie with their bundle are not moved; a bundle of two tasks is refused."""
    one = files(spark).repartition(1)
    bundles.publish(one, f"file://{tmp_path}/out", together=True)
    assert len(names(tmp_path / "out")) == 24
    with pytest.raises(Exception, match="from two tasks"):
        bundles.publish(spark.range(2, numPartitions=2).selectExpr("'b' bundle", "concat('f', id) name", "cast('1' as binary) content"), f"file://{tmp_path}/two", together=True)
    assert not (tmp_path / "two").exists() or names(tmp_path / "two") == []


def test_a_broken_bundle_is_no_row(spark, tmp_path):
    from selenite.plans import exports

    bundles.publish(files(spark, [("window-0-0", bundles.TIES, ",".join([*ties_columns()]).encode() + b"\r\n")]), f"file://{tmp_path}/out")
    with pytest.raises(Exception, match="lacks its image"):
        exports._window_contents(spark, f"file://{tmp_path}/out").collect()


def ties_columns():
    from selenite.operators import ties

    return (*ties.RECORD, *ties.FULL)


@pytest.mark.parametrize("empty", [("lineitem",), ("events",), ("lineitem", "events")])
def test_windows_of_empty_tables(spark, tmp_path, empty):
    """Without ties the windows are all there; without samples there is no window for a tie."""
    from selenite.plans import exports

    for t in ("lineitem", "events"):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        (rows.limit(0) if t in empty else rows).write.parquet(f"{tmp_path}/{t}.parquet")
    got = exports.window_bundle(spark, str(tmp_path)).collect()
    want = exports.window_bundle(spark, "/root/testdata/sf0.001").collect() if "events" not in empty else []
    assert sorted(r[:7] for r in got) == sorted(r[:7] for r in want) and all(r.ties == r.lon == 0 for r in got)
