"""Numeric kernels on cases with known answers."""

import numpy as np
import pandas as pd
import pytest

from selenite.functions import scalar as S
from selenite.operators import image, kernels, match, ties


def test_voronoi_cells():
    assert kernels.voronoi_areas(np.array([[10.0, 30], [40, 30]]), 80, 60) == pytest.approx([1500, 3300])
    assert kernels.voronoi_areas(np.array([[20.0, 15], [60, 15], [20, 45], [60, 45]]), 80, 60) == pytest.approx([1200] * 4)
    r = np.random.default_rng(3)
    p = r.random((64, 2)) * [953, 217]
    a = kernels.voronoi_areas(p, 953, 217)
    assert a.sum() == pytest.approx(953 * 217, rel=1e-9)
    q = r.random((20_000, 2)) * [953, 217]
    share = np.bincount(((q[:, None] - p) ** 2).sum(2).argmin(1), minlength=64) / len(q)
    assert np.abs(share - a / a.sum()).max() < 0.01


def test_hull():
    p = np.array([[0, 0], [4, 0], [4, 3], [0, 3], [2, 1], [4, 3], [2, 0]])
    assert kernels.polygon_area(kernels.hull(p)) == 12
    assert kernels.polygon_area(kernels.hull(np.array([[0, 0], [1, 1], [2, 2]]))) == 0


@pytest.mark.parametrize("seed", [101, 202, 303])
def test_spline_on_unseen_points(seed):
    warp = lambda p: p + np.column_stack([3 * np.sin(p[:, 1] / 60) + 1, 2 * np.cos(p[:, 0] / 80) - 1])
    g = np.stack(np.meshgrid(np.linspace(10, 500, 8), np.linspace(10, 370, 8)), -1).reshape(-1, 2)
    q = np.random.default_rng(seed).random((500, 2)) * [480, 350] + [15, 15]
    out = kernels.spline_apply(q, g, *kernels.spline_fit(g, warp(g)))
    assert np.sqrt(((out - warp(q)) ** 2).sum(1).mean()) < 0.45


def test_spline_keeps_affine_maps():
    r = np.random.default_rng(1)
    p = r.random((30, 2)) * 300
    m = lambda v: v @ np.array([[1.1, 0.2], [-0.1, 0.9]]) + [5, -7]
    q = r.random((50, 2)) * 300
    assert np.abs(kernels.spline_apply(q, p, *kernels.spline_fit(p, m(p))) - m(q)).max() < 1e-6


@pytest.mark.parametrize("seed", [401, 502, 603])
def test_homography_among_outliers(seed):
    r = np.random.default_rng(seed)
    h = np.array([[1.05, 0.03, 12], [-0.02, 0.97, -8], [1e-5, -2e-5, 1]])
    g = np.stack(np.meshgrid(np.linspace(20, 780, 8), np.linspace(20, 780, 8)), -1).reshape(-1, 2)
    good = kernels.projected(h, g) + r.normal(0, 0.08, g.shape)
    bad = r.random((96, 2)) * 800
    src, dst = np.vstack([g, r.random((96, 2)) * 800]), np.vstack([good, bad])
    got, mask = kernels.robust_homography(src, dst, seed=seed)
    assert mask[:64].mean() >= 0.95 and mask[64:].mean() <= 0.05
    again, _ = kernels.robust_homography(src, dst, seed=seed)
    assert (got == again).all()
    assert kernels.robust_homography(src[:3], dst[:3])[0] is None


def picture(n=160, dx=0.0, dy=0.0):
    y, x = np.mgrid[:n, :n].astype(float)
    x, y = x - dx, y - dy
    v = 110 + 60 * np.sin(x / 7) * np.cos(y / 9) + 40 * np.sin(x * y / 900)
    for i in range(25):
        v += 60 * np.exp(-((x - 20 - 37 * i % 120) ** 2 + (y - 20 - 53 * i % 120) ** 2) / (2 * (2 + i % 3) ** 2))
    return np.clip(v, 0, 255)


def test_tracking_and_keypoints():
    a, b = picture(), picture(dx=1.3, dy=-0.8)
    p = np.array([(x, y) for x in range(30, 130, 20) for y in range(30, 130, 20)], float)
    q, ok = kernels.track(a, b, p, p)
    assert ok.mean() > 0.9 and np.abs(np.median(q[ok] - p[ok], axis=0) - [1.3, -0.8]).max() < 0.05
    r = np.random.default_rng(4)
    spots = [(*r.integers(15, 145, 2), r.choice((2.0, 2.5, 3.0)), r.choice((-80, 80))) for _ in range(70)]
    y, x = np.mgrid[:160, :160]
    a = np.clip(127 + sum(v * np.exp(-((x - i) ** 2 + (y - j) ** 2) / (2 * s * s)) for i, j, s, v in spots), 0, 255)
    k, d = kernels.keypoints(a, contrast=0.01)
    assert len(k) > 20 and (np.diff(k[:, 2]) <= 0).all() and np.linalg.norm(d, axis=1) == pytest.approx(1)
    k2, d2 = kernels.keypoints(np.roll(a, (4, 6), (0, 1)), contrast=0.01)
    near = ((d[:, None] - d2) ** 2).sum(2).argmin(1)
    shift = k2[near, :2] - k[:, :2]
    assert (np.abs(shift - [6, 4]).max(1) < 0.5).mean() > 0.6


def sliding(v, r):
    p = np.pad(v, r, mode="reflect") if min(v.shape) > 1 else np.pad(v, r, mode="edge")
    w = np.lib.stride_tricks.sliding_window_view(p, (2 * r + 1, 2 * r + 1))
    return w.mean((2, 3)), w.std((2, 3))


@pytest.mark.parametrize("shape, r", [((12, 17), 2), ((6, 9), 4), ((5, 4), 20), ((1, 7), 3)])
def test_local_moments(spark, shape, r):
    v = np.random.default_rng(5).integers(0, 255, shape).astype(float)
    y, x = np.indices(shape)
    px = spark.createDataFrame(pd.DataFrame({"y": y.ravel().astype("i4"), "x": x.ravel().astype("i4"), "dn": v.ravel()}))
    got = image.box_moments(px, r).toPandas().sort_values(["y", "x"])
    if shape[0] == 1:
        m = np.array([[np.pad(v[0], r, mode="reflect")[i : i + 2 * r + 1].mean() for i in range(shape[1])]])
        assert got.m.to_numpy() == pytest.approx(m.ravel())
        return
    m, s = sliding(v, r)
    assert got.m.to_numpy() == pytest.approx(m.ravel()) and got.s.to_numpy() == pytest.approx(np.maximum(s.ravel(), 1e-6), abs=1e-5)


def test_constant_images_condition_to_one_value(spark):
    for v in (0.0, 10.0, 60.0, 128.0, 255.0):
        px = spark.createDataFrame([(y, x, v) for y in range(9) for x in range(8)], "y int, x int, dn double")
        assert {r.w for r in image.wallis(px, 5).collect()} == {int(0.2 * 128 + 0.8 * v)}


def test_entropy_of_sixteen_levels(spark):
    px = spark.createDataFrame([(0, float(i % 16 + 1)) for i in range(256)] + [(0, 0.0)] * 9, "scene int, dn double")
    assert image.entropy(px, ["scene"]).first().entropy == pytest.approx(4)


def test_routing_examples(spark):
    d = spark.createDataFrame([(1.0, 1.0, 20.0, 20.0), (5.0, 0.25, 20.0, 20.0), (1.0, 1.0, 15.0, 80.0)], "a double, b double, c double, d double")
    assert [r[0] for r in d.select(S.disparity(d.a, d.b, d.c, d.d)).collect()] == pytest.approx([0, 9.5, 32.5])


def greedy(rows):
    s, r, out = set(), set(), []
    for row in sorted(rows, key=lambda x: (-x[6], x[1])):
        if row[2:4] not in s and row[4:6] not in r:
            s.add(row[2:4]), r.add(row[4:6]), out.append(row[1])
    return sorted(out)


def test_one_to_one_endpoints(spark):
    r = np.random.default_rng(9)
    rows = [(1, i, *map(float, r.integers(0, 5, 4)), float(r.integers(0, 6)) / 5) for i in range(120)]
    t = spark.createDataFrame(rows, "job int, i int, sx double, sy double, rx double, ry double, conf double")
    assert sorted(x.i for x in match.unique_pairs(t, ["job"]).collect()) == greedy(rows)


def test_grid_ties_duplicates_and_edges(spark):
    rows = [(1, 0, 800.0, 800.0, 0.5), (1, 1, 799.0, 799.0, 0.9), (1, 2, 10.0, 10.0, 0.7), (1, 3, 10.0, 10.0, 0.8), (1, 4, 20.0, 20.0, 0.8)]
    t = spark.createDataFrame(rows, "job int, i int, rx double, ry double, conf double")
    assert sorted(r.i for r in ties.grid_top(t, 800, 800, 1).collect()) == [1, 3]
    assert sorted(r.i for r in ties.grid_top(t, 800, 800, 2).collect()) == [0, 1, 3, 4]


def test_one_to_one_long_chain(spark):
    n = 134  # over 64 rounds: each tie shares an endpoint with the next weaker one, so every second is taken
    rows = [(0, i, float((i + 1) // 2), 0.0, float(i // 2), 0.0, 1 - i / 1000) for i in range(n)]
    t = spark.createDataFrame(rows, "job int, i int, sx double, sy double, rx double, ry double, conf double")
    assert sorted(x.i for x in match.unique_pairs(t, ["job"]).collect()) == list(range(0, n, 2))


def test_nearest_two_of_many_copies(spark):
    r = np.random.default_rng(5)
    one = r.random(16)
    refs = [(100 - k, one.tolist()) for k in range(50)] + [(1000 - k, (one + 1e-9 * r.random(16)).tolist()) for k in range(50)] + [(2000 + k, v.tolist()) for k, v in enumerate(r.random((9, 16)))]
    srcs = [(1, one.tolist()), (2, (one + 0.25).tolist()), (3, (one + 1e-9).tolist()), (4, r.random(16).tolist())]
    make = lambda x: spark.createDataFrame(x, "id bigint, v array<double>")
    for refs_ in (refs, refs[:1]):
        want = []
        for s, x in srcs:
            d = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), i) for i, y in refs_)
            want.append((s, d[0][1], d[0][0], d[1][0] if len(d) > 1 else None))
        assert sorted(map(tuple, match.nearest_two(make(srcs), make(refs_)).collect())) == want


def test_vectors_that_are_no_vectors(spark):
    """Rows with nulls, NaN or infinities are in no pair and change no other row's pairs."""
    make = lambda rows: spark.createDataFrame(rows, "id bigint, v array<double>")
    nan, inf = float("nan"), float("inf")
    bad = [(90, None), (91, [nan, 1.0]), (92, [1.0, None]), (93, []), (None, [1.0, 2.0]), (94, [inf, 0.0]), (95, [1.0, -inf])]
    src, ref = make([(0, [1.0, 2.0]), *bad]), make([(1, [1.0, 2.0]), (2, [0.0, 1.0]), *bad])
    (row,) = match.nearest_two(src, ref).collect()
    assert tuple(row) == (0, 1, 0.0, 2**0.5)
    assert match.unusable(src) == len(bad) and match.nearest_two(make(bad), ref).count() == 0


def test_entropy_of_one_value_and_of_none(spark):
    px = spark.createDataFrame([(1, 5.0)] * 3 + [(2, None), (2, 0.0), (3, 1.0), (3, 2.0)], "k int, dn double")
    got = {r.k: (r.entropy, r.n) for r in image.entropy(px, ["k"]).collect()}
    assert got == {1: (0.0, 3), 2: (0.0, 0), 3: (1.0, 2)} and str(got[1][0]) == "0.0"


def test_nearest_by_index(spark, monkeypatch):
    """The index finds what all pairs find: clusters, copies, one hot cluster, few references; and it asks for few pairs of what is clustered."""
    r = np.random.default_rng(12)
    make = lambda v, first=0: spark.createDataFrame([(first + i, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<double>")
    clustered = lambda n: (r.random((20, 3)) * 100)[r.integers(0, 20, n)] + r.random((n, 3))
    hot = np.concatenate([np.tile(r.random(3), (300, 1)) + r.random((300, 3)) * 1e-3, r.random((100, 3)) * 50])
    asked = []
    count = match._count
    monkeypatch.setattr(match, "_count", lambda t: asked.append(count(t)) or asked[-1])
    cases = [(clustered(700), clustered(900)), (hot[::2], hot), (r.random((90, 8)), r.random((300, 8))), (r.random((80, 2)), np.repeat(r.random((3, 2)), 40, 0)), (r.random((70, 2)), r.random((1, 2)))]
    for s, t in cases:
        src, ref = make(s), make(t, 5000)
        got, want = (sorted(map(tuple, f(src, ref).collect())) for f in (lambda a, b: match._indexed(a, b, 64), lambda a, b: match._all_pairs(a, b, 64, "f").drop("side")))
        assert got == want and len(got) == len(s)
    one = {c: n for c, n in asked[1].items()}
    assert sum(one.values()) < 700 * 28 / 3  # of 28 centres
    both = [sorted(map(tuple, n.collect())) for n in match.nearest_both(make(cases[0][0]), make(cases[0][1], 5000), 64)]
    assert len(both[0]) == 700 and len(both[1]) == 900


def test_gray_pictures(spark):
    """Detection of 0..1 is of the whole picture, not of a band or a sample; one bad sample refuses its picture."""
    nan = float("nan")
    data = [(1, 0.5, 1.0, 0.0), (1, 0.25, 0.25, 0.25), (2, 0.5, 1.0, 0.0), (2, 2.0, 0.0, 0.0), (3, nan, 0.0, 0.0), (3, 1.0, 1.0, 1.0), (4, -1.0, 0.0, 0.0), (5, 255.5, 0.0, 0.0), (6, None, 0.0, 0.0), (7, 255.0, 255.0, 255.0)]
    px = spark.createDataFrame([(k, i, 0, b, g, r) for i, (k, b, g, r) in enumerate(data)], "k int, y int, x int, b double, g double, r double")
    good, bad = image.gray_unit(px, ["k"], ("b", "g", "r"))
    got = {r.y: r.g for r in good.collect()}
    luma = lambda b, g, r: 0.114 * b + 0.587 * g + 0.299 * r
    assert got == {i: pytest.approx(luma(b, g, r) / (1 if k == 1 else 255)) for i, (k, b, g, r) in enumerate(data) if k in (1, 2, 7)}
    assert {r.k: r.violations for r in bad.collect()} == {3: ["not finite"], 4: ["range"], 5: ["range"], 6: ["not finite"]}
    whole, _ = image.gray_unit(px.where("k = 1"), ["k"], ("b",), floats=False)
    assert sorted(r.g for r in whole.collect()) == [0.25 / 255, 0.5 / 255]
    with pytest.raises(ValueError):
        image.gray_unit(px, ["k"], ("b", "g"))


def test_neighbours_without_clusters_move_few_rows(spark, monkeypatch):
    """Vectors that no bound sets apart aren't sent to every cluster, and no task holds more than so many distances."""
    from selenite.operators import match

    r = np.random.default_rng(5)
    make = lambda v, first: spark.createDataFrame([(first + i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    src, ref = make(r.normal(size=(150, 32)), 0), make(r.normal(size=(640, 32)), 5000)
    written = []
    monkeypatch.setattr("selenite.shared.cut", lambda t: written.append((t.columns, t.count())) or t)
    got = sorted(map(tuple, match._indexed(src, ref, 200).collect()))
    assert max(n for _, n in written) <= 640
    assert got == sorted(map(tuple, match._all_pairs(src, ref, 200, "f").drop("side").collect()))
    x, y = (np.array([q.v for q in t.orderBy("id").collect()]) for t in (src, ref))
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    assert [(s, q) for s, q, *_ in got] == [(i, 5000 + j) for i, j in enumerate(d.argmin(1))]
    monkeypatch.setattr(match, "CELLS", 700)
    t = lambda v, first: pd.DataFrame({"id": np.arange(first, first + len(v)), "v": list(v)})
    two = match._two_best(t(x, 0), t(y, 5000))
    assert np.allclose(two.d.to_numpy().reshape(-1, 2), np.sort(d, 1)[:, :2]) and two.s.tolist() == np.repeat(np.arange(150), 2).tolist()
