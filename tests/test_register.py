"""A whole registration with a known translation, beside pairs that can't be registered."""

import numpy as np
import pandas as pd
import pytest

from selenite.operators import kernels
from selenite.plans import register


def spots(n, dx=0.0, dy=0.0, seed=4):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[:n, :n]
    v = 127.0
    for _ in range(n * n // 90):
        i, j, s, a = *r.uniform(-20, n + 20, 2), r.choice((2.0, 2.5, 3.0)), r.choice((-80, 80))
        v = v + a * np.exp(-((x - dx - i) ** 2 + (y - dy - j) ** 2) / (2 * s * s))
    return np.clip(v, 0, 255).astype(int).astype(float)


def lattice(n, dx=0.0, dy=0.0, cell=32, seed=21):
    """A cluster of spots around the middle of each cell, so that the strongest tie of each is near it."""
    r = np.random.default_rng(seed)
    y, x = np.mgrid[:n, :n]
    v = np.full((n, n), 127.0)
    for cy in range(cell // 2, n, cell):
        for cx in range(cell // 2, n, cell):
            for _ in range(4):
                i, j, s, a = cx + r.uniform(-6, 6), cy + r.uniform(-6, 6), r.uniform(1.8, 2.6), r.choice((-70, 70)) * r.uniform(0.7, 1)
                v = v + a * np.exp(-((x - dx - i) ** 2 + (y - dy - j) ** 2) / (2 * s * s))
    return np.clip(v, 0, 255).astype(int).astype(float)


def test_whole_registration_is_complete(spark):
    n = 256
    y, x = np.indices((n, n))
    parts = [pd.DataFrame({"job": 5, "side": s, "y": y.ravel(), "x": x.ravel(), "dn": v.ravel()}) for s, v in (("s", lattice(n, 3.25, -2.5)), ("r", lattice(n)))]
    px = spark.createDataFrame(pd.concat(parts)).selectExpr("cast(job as bigint) job", "side", "cast(y as int) y", "cast(x as int) x", "dn")
    r = register.register(px, float(n), float(n)).first()
    assert (r.reasons, r.basis, r.status) == ("", "withheld", "complete")
    assert r.rmse < 0.5 and r.vsui >= 0.75 and r.ratio >= 0.7 and r.withheld >= 8 and r.candidates >= r.refined >= r.inliers >= r.retained


def table(spark, parts):
    """Pixels of {(job, side): array}."""
    rows = []
    for (job, side), v in parts.items():
        y, x = np.indices(v.shape)
        rows.append(pd.DataFrame({"job": job, "side": side, "y": y.ravel(), "x": x.ravel(), "dn": v.ravel()}))
    return spark.createDataFrame(pd.concat(rows)).selectExpr("cast(job as bigint) job", "side", "cast(y as int) y", "cast(x as int) x", "dn", "dn w")


def test_keypoints_by_tile_are_those_of_the_picture(spark):
    """Several tiles, cut at odd sizes, and small and flat pictures: the same keypoints and descriptors as from the whole."""
    wide = spots(150)[:, :97]
    px = table(spark, {(1, "s"): wide, (1, "r"): np.full((40, 50), 9.0), (2, "s"): spots(70), (2, "r"): spots(70)[:6], (3, "s"): spots(70)[:, :20]})
    for most in (10_000, 40):
        got = {}
        for r in register.features(px, most, 0.01, tile=32).collect():
            got.setdefault((r.job, r.side), {})[r.x, r.y] = r.v
        for key, v in {(1, "s"): wide, (2, "s"): spots(70), (3, "s"): spots(70)[:, :20]}.items():
            p, d = kernels.keypoints(v, most, 0.01, octaves=register.OCTAVES)
            assert len(p) > 1 and set(got[key]) == set(map(tuple, p[:, :2]))
            for (x, y, _), own in zip(p, d):
                assert np.allclose(got[key][x, y], own, atol=1e-9) or list(map(tuple, p[:, :2])).count((x, y)) > 1
        assert (1, "r") not in got and (2, "r") not in got


def test_tracking_by_patch_is_that_of_the_picture(spark):
    n = 330
    a, b = spots(n, 2.25, -1.5), spots(n)
    p, _ = kernels.keypoints(a, 150, 0.01)
    at = [(1, i, x, y, x - 2.0, y + 1.0, 0.5) for i, (x, y, _) in enumerate(p)] + [(9, 0, 1.0, 1.0, 2.0, 2.0, 0.5)]
    pairs = spark.createDataFrame([tuple(float(v) if k > 1 else int(v) for k, v in enumerate(r)) for r in at], "job bigint, i bigint, sx double, sy double, rx double, ry double, conf double")
    px = table(spark, {(1, "s"): a, (1, "r"): b, (9, "s"): a[:50], (9, "r"): b[:60]})
    got = {(r.job, r.i): (r.rx, r.ry) for r in register.refined(px, pairs, tile=128).collect()}
    src, ref = np.array([r[2:4] for r in at[:-1]]), np.array([r[4:6] for r in at[:-1]])
    to, ok = kernels.track(a, b, src, ref)
    again, ok2 = kernels.track(b, a, to, src)
    keep = ok & ok2 & (np.hypot(*(again - src).T) <= 0.5) & (np.hypot(*(to - ref).T) <= 3.5)
    assert keep.sum() > 100 and set(got) == {(1, int(i)) for i in np.flatnonzero(keep)} | {(9, 0)}
    assert all(np.allclose(got[1, int(i)], to[i], atol=1e-3) for i in np.flatnonzero(keep)) and got[9, 0] == (2.0, 2.0)


def test_translation_flat_and_unrelated(spark):
    n = 192
    pairs = {0: (spots(n, 6, -4), spots(n)), 1: (np.zeros((n, n)), spots(n)), 2: (spots(n, seed=8), spots(n, seed=9))}
    y, x = np.indices((n, n))
    parts = [pd.DataFrame({"job": j, "side": s, "y": y.ravel(), "x": x.ravel(), "dn": v.ravel()}) for j, p in pairs.items() for s, v in zip("sr", p)]
    px = spark.createDataFrame(pd.concat(parts)).selectExpr("cast(job as bigint) job", "side", "cast(y as int) y", "cast(x as int) x", "dn")
    got = {r.job: r for r in register.register(px, float(n), float(n)).collect()}
    assert set(got) == {0, 1, 2}
    assert got[0].inliers >= 50 and got[0].ratio >= 0.7 and got[0].rmse < 0.5 and "ratio" not in got[0].reasons
    # its ties are too uneven, so no spline is fitted and nothing is validated
    assert got[0].reasons == "uniformity" and got[0].withheld == 0 and got[0].basis == "rejected"
    assert got[1].candidates == 0 and got[1].status == "review_required"
    assert got[2].status == "review_required"


def test_small_tables(spark):
    assert {r.status for r in register.register_pairs(spark, "/root/testdata/sf0.001").collect()} <= {"review_required", "complete"}


def test_other_matchers_and_progress(spark, monkeypatch):
    """A matcher of one's own takes part under the same contract; stages are told in order."""
    n, told = 48, []
    own = [(1, i, float(x), float(y), float(x), float(y), 0.5 + i / 1000) for i, (x, y) in enumerate((x, y) for x in range(4, n, 6) for y in range(4, n, 6))]
    bad = [(2, 0, 1.0, 1.0, 1.0, 1.0, 1.5), (2, 1, 2.0, 2.0, 2.0, 2.0, 0.5), (3, 7, 1.0, 1.0, 1.0, 1.0, 0.5), (3, 7, 2.0, 2.0, 2.0, 2.0, 0.5)]
    monkeypatch.setitem(register.MATCHERS, "given", lambda conditioned: spark.createDataFrame(own + bad, "job bigint, i bigint, sx double, sy double, rx double, ry double, conf double"))
    v = spots(n)
    px = table(spark, {(j, s): v for j in (1, 2, 3) for s in "sr"})
    got = {r.job: r for r in register.register(px, float(n), float(n), matcher="given", progress=lambda percent, stage: told.append((percent, stage))).collect()}
    assert got[1].candidates == len(own) and got[1].inliers > 40 and "contract" not in got[1].reasons
    assert all(got[j].candidates == 0 and got[j].reasons.startswith("match contract") and got[j].status == "review_required" for j in (2, 3))
    assert told == [(30, "conditioning"), (40, "matching"), (60, "filtering"), (75, "spline")]
    with pytest.raises(ValueError, match="no matcher"):
        register.register(px, float(n), float(n), matcher="other")
