"""Every query on empty tables; operators on repeated points, long chains and wide rasters."""

import numpy as np
import pandas as pd
import pytest

from selenite import registry
from selenite.operators import image, kernels, ties
from selenite.plans.views import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{where}/{t}.parquet")
    return str(where)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, empty, name):
    rows = registry.queries()[name](spark, empty).count()
    assert rows == 0


def dense(spark, a):
    y, x = np.indices(a.shape)
    return spark.createDataFrame(pd.DataFrame({"y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32), "dn": a.ravel()}))


def test_repeated_points_stay_apart(spark):
    a = np.arange(100.0).reshape(10, 10)
    points = spark.createDataFrame([(4.5, 5.5)] * 3 + [(None, 2.0), (-0.5, 0.0), (40.0, 4.0)], "sx double, sy double")
    for f in (image.bilinear, image.bicubic):
        got = sorted(((r.sx, r.sy, r.v) for r in f(points, dense(spark, a)).collect()), key=repr)
        assert len(got) == 6 and sum(v == pytest.approx(59.5) for *_, v in got if v is not None) == 3
        assert [v for x, _, v in got if x is None] == [None] and [v for x, _, v in got if x == 40] == [0.0]
    c = spark.createDataFrame([(0.0, 0.0, 1.0)], "cx double, cy double, w double")
    p = spark.createDataFrame([(1.0, 1.0)] * 2 + [(0.0, 0.0)], "x double, y double")
    assert sorted(r.v for r in ties.spline_eval(p, c, (1.0, 1.0, 1.0)).collect()) == pytest.approx([1.0, 3.0 + np.log(2), 3.0 + np.log(2)])
    assert ties.spline_eval(p, c.limit(0), (1.0, 0.0, 0.0)).count() == 3


@pytest.mark.parametrize("shape, radius", [((300, 530), 20), ((1, 7), 3), ((5, 4), 9), ((260, 258), 2), ((20, 20), 300)])
def test_moments_over_tiles(spark, shape, radius):
    a = np.random.default_rng(1).integers(0, 255, shape).astype(float)
    p = np.pad(a, radius, mode="reflect")
    n = 2 * radius + 1
    total = lambda v: np.pad(v, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    box = lambda v: (t := total(v))[n:, n:] - t[:-n, n:] - t[n:, :-n] + t[:-n, :-n]
    m = box(p) / n**2
    s = np.sqrt(np.maximum(box(p * p) / n**2 - m * m, 0))
    got = image.box_moments(dense(spark, a), radius).toPandas().sort_values(["y", "x"])
    assert len(got) == a.size and np.array_equal(got.dn.to_numpy().reshape(shape), a)
    assert np.allclose(got.m.to_numpy().reshape(shape), m) and np.allclose(got.s.to_numpy().reshape(shape), np.maximum(s, 1e-6), atol=1e-4)


def test_gathers_across_tiles(spark):
    a = np.random.default_rng(2).integers(0, 255, (300, 300)).astype(float)
    r = np.random.default_rng(3)
    pts = pd.DataFrame({"sx": r.uniform(-3, 303, 4000), "sy": r.uniform(-3, 303, 4000)})
    pts.loc[:500, "sx"] = r.uniform(253, 259, 501)
    got = image.bicubic(spark.createDataFrame(pts), dense(spark, a)).toPandas()
    p = np.pad(a, 8)
    fx, fy = np.floor(got.sx.to_numpy()), np.floor(got.sy.to_numpy())
    want = sum(image.cubic_weight(got.sx - fx - i) * image.cubic_weight(got.sy - fy - j) * p[(fy + j + 8).astype(int), (fx + i + 8).astype(int)] for i in range(-1, 3) for j in range(-1, 3))
    assert len(got) == 4000 and np.allclose(got.v, want)


def test_tracking_from_far_away():
    y, x = np.mgrid[:160, :160]
    r = np.random.default_rng(9)
    spots = [(*r.uniform(0, 160, 2), r.uniform(3, 7), r.choice((-60, 60))) for _ in range(120)]
    picture = lambda dx, dy: 127 + sum(a * np.exp(-((x - dx - i) ** 2 + (y - dy - j) ** 2) / (2 * s * s)) for i, j, s, a in spots)
    p = np.array([(i, j) for i in range(50, 111, 15) for j in range(50, 111, 15)], float)
    q, ok = kernels.track(picture(0, 0), picture(17.5, -14.25), p, p)
    near = np.hypot(*(q - p - (17.5, -14.25)).T) < 0.1
    flat, _ = kernels.track(picture(0, 0), picture(17.5, -14.25), p, p, levels=0)
    assert ok.mean() > 0.9 and near.mean() > 0.8 and near.sum() > (np.hypot(*(flat - p - (17.5, -14.25)).T) < 0.1).sum()
    assert len(kernels.track(picture(0, 0), picture(0, 0), p[:0], p[:0])[0]) == 0
