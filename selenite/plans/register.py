"""Whole registrations: two pictures of each job in, matched and judged tie points and quality metrics out.

Every step is a table keyed by job, so many pairs run as one query. Pixels only meet by tile, with as much of their
neighbourhood as a step looks at, so pictures may have any size: local moments, octaves, keypoints, and the patches that
ties are tracked in. Matching, the robust fit and the spline see one job's features, which the keypoint limit bounds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import scalar as S
from ..operators import image, kernels, ties
from ..shared import cut, small_batches
from ..sources.raster import image_array
from .views import view

Q, SQL = {}, {}
#: Keypoints of a picture, ratio of the two best distances, and octaves of a picture.
FEATURES, RATIO, OCTAVES = 2048, 0.8, 2
#: Samples around a tile that a keypoint and its descriptor depend on, and that halving does.
AROUND, HALVING = 24, 6
#: Samples on each side of a tie that tracking may look at: windows of 21 on pictures halved twice, and room to move.
PATCH, PATCH_TILE = 96, 1024
_KEYS = ["job", "side", "_ty", "_tx"]


def _window(pdf: pd.DataFrame, value: str) -> tuple[np.ndarray, int, int]:
    """A tile with its surroundings as an array, and its first row and column."""
    y0, x0 = int(pdf.y.min()), int(pdf.x.min())
    return image_array(pd.DataFrame({"y": pdf.y - y0, "x": pdf.x - x0, "dn": pdf[value]}), "f8"), y0, x0


def halved(px: DataFrame, tile: int = image.TILE) -> DataFrame:
    """Smoothed pictures at every other sample: job, side, y, x, w."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, y0, x0 = _window(pdf, "w")
        b = kernels._blurred(a, 1.6)
        (ya, xa), (yb, xb) = ((k * tile for k in key[2:]), (min((k + 1) * tile, low + n) for k, low, n in zip(key[2:], (y0, x0), a.shape)))
        b = b[ya - y0 : max(ya, yb) - y0 : 2, xa - x0 : max(xa, xb) - x0 : 2]
        y, x = np.indices(b.shape)
        return pd.DataFrame({"job": key[0], "side": key[1], "y": (y.ravel() + ya // 2).astype("int32"), "x": (x.ravel() + xa // 2).astype("int32"), "w": b.ravel()})

    return image.tiled(px.select("job", "side", "y", "x", "w"), HALVING, HALVING, side=tile).groupBy(*_KEYS).applyInPandas(run, "job bigint, side string, y int, x int, w double")


def features(px: DataFrame, most: int = FEATURES, contrast: float = 0.01, tile: int = image.TILE) -> DataFrame:
    """job, side, x, y, v (descriptor) of the strongest keypoints of each picture (job, side, y, x, w), found by tile in all octaves."""

    def find(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, y0, x0 = _window(pdf, "w")
        if min(a.shape) < 8:  # too little texture
            p, d = np.zeros((0, 3)), []
        else:
            p, d = kernels._octave(a, contrast, 10.0)
            own = ((p[:, 0] + x0) // tile == key[3]) & ((p[:, 1] + y0) // tile == key[2])
            p, d = p[own] + (x0, y0, 0), d[own]
            order = np.lexsort((p[:, 0], p[:, 1], -p[:, 2]))[:most]  # no more of a tile can be among a picture's strongest
            p, d = p[order], d[order]
        return pd.DataFrame({"job": key[0], "side": key[1], "x": p[:, 0], "y": p[:, 1], "response": p[:, 2], "v": pd.Series(list(d), dtype=object)})

    level = px.select("job", "side", "y", "x", (F.col("w") / 255.0).alias("w"))
    size = px.groupBy("job", "side").agg(F.least(F.max("y"), F.max("x")).alias("_last"))
    out = None
    for k in range(OCTAVES):
        if k:
            # a picture goes on as long as its half has room for a descriptor
            level = cut(halved(level.join(size.where(F.floor(F.col("_last") / 2**k) + 1 >= 16).select("job", "side"), ["job", "side"], "left_semi"), tile))
        found = image.tiled(level, AROUND, AROUND, side=tile).groupBy(*_KEYS).applyInPandas(find, "job bigint, side string, x double, y double, response double, v array<double>")
        found = found.withColumns({"x": F.col("x") * 2**k, "y": F.col("y") * 2**k, "octave": F.lit(k)})
        out = found if out is None else out.unionByName(found)
    order = [F.desc("response"), "y", "x", "octave"]
    # a picture's keypoints are ranked in shares first
    for by in ("_share", None):
        out = out.withColumn("_share", F.pmod(F.xxhash64("x", "y"), F.lit(64))) if by else out
        out = out.withColumn("_rank", F.row_number().over(Window.partitionBy("job", "side", *([by] if by else [])).orderBy(*order))).where(F.col("_rank") <= most)
    return out.select("job", "side", "x", "y", "v")


def matches(feats: DataFrame, ratio: float = RATIO) -> DataFrame:
    """Reciprocal nearest neighbours that pass the ratio test both ways, one to one by confidence: job, i, sx, sy, rx, ry, conf."""

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(a) < 2 or len(b) < 2:
            return pd.DataFrame({c: [] for c in ("job", "i", "sx", "sy", "rx", "ry", "conf")})
        x, y = np.stack(a.v.to_numpy()), np.stack(b.v.to_numpy())
        d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0))
        best = []
        for m in (d, d.T):
            two = np.argpartition(m, 1, axis=1)[:, :2]
            rows = np.arange(len(m))[:, None]
            two = two[rows, np.argsort(m[rows, two], axis=1, kind="stable")]
            d1, d2 = m[rows[:, 0], two[:, 0]], m[rows[:, 0], two[:, 1]]
            best.append((two[:, 0], d1 < ratio * d2, 1 - d1 / np.maximum(d2, 1e-300)))
        (f, ok, c), (g, ok2, c2) = best
        s = np.flatnonzero(ok & ok2[f] & (g[f] == np.arange(len(f))))
        out = pd.DataFrame({"sx": a.x.to_numpy()[s], "sy": a.y.to_numpy()[s], "rx": b.x.to_numpy()[f[s]], "ry": b.y.to_numpy()[f[s]], "conf": np.minimum(c[s], c2[f[s]])})
        out = out.sort_values(["conf", "ry", "rx", "sy", "sx"], ascending=[False, True, True, True, True], ignore_index=True)
        used, keep = set(), []
        for k, (x1, y1, x2, y2) in enumerate(zip(out.sx, out.sy, out.rx, out.ry)):  # the strongest first, each end once
            if not {("s", x1, y1), ("r", x2, y2)} & used:
                used |= {("s", x1, y1), ("r", x2, y2)}
                keep.append(k)
        out = out.iloc[keep].sort_values(["ry", "rx", "sy", "sx"], ignore_index=True)
        return out.assign(job=key[0], i=np.arange(1, len(out) + 1))[["job", "i", "sx", "sy", "rx", "ry", "conf"]]

    # both sides come from one table: columns of their own keep them apart
    g = lambda side: feats.where(F.col("side") == side).select(*[F.col(c).alias(c) for c in ("job", "x", "y", "v")]).groupBy("job")
    return g("s").cogroup(g("r")).applyInPandas(run, "job bigint, i bigint, sx double, sy double, rx double, ry double, conf double")


def _patches(px: DataFrame, places: DataFrame, side: str, x: str, y: str, tile: int) -> DataFrame:
    """job, i, and for the place (x, y) of each tie the samples around it as bytes, their first row and column, and the shape."""

    def run(key: tuple, t: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        names = ["job", "i", "patch", "y0", "x0", "h", "w"]
        if p.empty or t.empty:
            return pd.DataFrame(columns=names)
        a, top, left = _window(p, "w")
        a, rows = a.astype(np.float32), []
        for i, px_, py_ in zip(t.i, t.px, t.py):
            # patches begin at multiples of four, as halved pictures do
            ya, xa = (max(low, (int(v) - PATCH) // 4 * 4) for v, low in ((py_, top), (px_, left)))
            yb, xb = (min(low + n, int(v) + PATCH + 1) for v, low, n in ((py_, top, a.shape[0]), (px_, left, a.shape[1])))
            b = a[ya - top : yb - top, xa - left : xb - left]
            rows.append((key[0], i, np.ascontiguousarray(b).tobytes(), ya, xa, *b.shape))
        return pd.DataFrame(rows, columns=names)

    t = places.select("job", "i", F.col(x).alias("px"), F.col(y).alias("py"), F.floor(F.col(y) / tile).alias("_ty"), F.floor(F.col(x) / tile).alias("_tx"))
    own = image.tiled(px.where(F.col("side") == side).select(*[F.col(c).alias(c) for c in ("job", "y", "x", "w")]), PATCH + 4, PATCH + 4, side=tile)
    g = lambda d: d.groupBy("job", "_ty", "_tx")
    out = g(t).cogroup(g(own)).applyInPandas(run, "job bigint, i bigint, patch binary, y0 int, x0 int, h int, w int")
    return out.select("job", "i", F.struct("patch", "y0", "x0", "h", "w").alias(f"_{side}"))


def refined(px: DataFrame, pairs: DataFrame, limit: float = S.MAX_RESIDUAL, back: float = 0.5, tile: int = PATCH_TILE) -> DataFrame:
    """pairs with the reference's place tracked from the source, where tracking there and back again agrees; the others go.

    px: job, side, y, x, w. Pictures of different sizes keep their pairs as they are. A tie is tracked within the samples
    around both of its places, so what moves further is lost, as it would be by the limits.
    """
    names = ("job", "i", "sx", "sy", "rx", "ry", "conf")

    def run(batches):
        for t in batches:
            keep, rx, ry = np.zeros(len(t), bool), t.rx.to_numpy(copy=True), t.ry.to_numpy(copy=True)
            for k, (s, r) in enumerate(zip(t["_s"], t["_r"])):
                if s is None or r is None:
                    continue
                (a, ya, xa), (b, yb, xb) = ((np.frombuffer(d["patch"], np.float32).reshape(d["h"], d["w"]).astype(float), d["y0"], d["x0"]) for d in (s, r))
                src, ref = np.array([[t.sx.iloc[k] - xa, t.sy.iloc[k] - ya]]), np.array([[rx[k] - xb, ry[k] - yb]])
                to, ok = kernels.track(a, b, src, ref)
                again, ok2 = kernels.track(b, a, to, src)
                keep[k] = ok[0] and ok2[0] and np.hypot(*(again - src)[0]) <= back and np.hypot(*(to - ref)[0]) <= limit
                rx[k], ry[k] = to[0, 0] + xb, to[0, 1] + yb
            yield t.assign(rx=rx, ry=ry)[list(names)][keep]

    size = px.groupBy("job").agg(*[F.max(F.when(F.col("side") == s, F.struct("y"))).alias(f"{s}y") for s in "sr"], *[F.max(F.when(F.col("side") == s, F.struct("x"))).alias(f"{s}x") for s in "sr"])
    same = size.select("job", ((F.col("sy") == F.col("ry")) & (F.col("sx") == F.col("rx"))).alias("_same"))
    pairs = pairs.select(*names).join(same, "job", "left")
    equal = pairs.where(F.coalesce("_same", F.lit(False))).drop("_same")
    t = equal.join(_patches(px, equal, "s", "sx", "sy", tile), ["job", "i"], "left").join(_patches(px, equal, "r", "rx", "ry", tile), ["job", "i"], "left")
    with small_batches(px.sparkSession):  # two patches of 150 kB each are in a row
        done = cut(t.repartition("job", "i").mapInPandas(run, "job bigint, i bigint, sx double, sy double, rx double, ry double, conf double"))
    return done.unionByName(pairs.where(~F.coalesce("_same", F.lit(False))).drop("_same"))


def judged(pairs: DataFrame, limit: float = S.MAX_RESIDUAL) -> DataFrame:
    """Adds inlier and res by a robust homography of each job, reference to source."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("i", ignore_index=True)
        h, ok = kernels.robust_homography(p[["rx", "ry"]].to_numpy(), p[["sx", "sy"]].to_numpy(), limit, tries=800, seed=int(p.job.iloc[0]))
        res = np.full(len(p), np.inf) if h is None else np.hypot(*(kernels.projected(h, p[["rx", "ry"]].to_numpy()) - p[["sx", "sy"]].to_numpy()).T)
        return p.assign(inlier=ok, res=res)

    return pairs.groupBy("job").applyInPandas(run, "job bigint, i bigint, sx double, sy double, rx double, ry double, conf double, inlier boolean, res double")


def held_out(flagged: DataFrame) -> DataFrame:
    """job, withheld, rmse: the spline of the retained ties at the inliers left out of it."""

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("i")
        k, w = p[p.retained], p[p.inlier & ~p.retained]
        c = k[["rx", "ry"]].to_numpy()
        rmse = None
        if len(k) >= 4 and len(w) and np.linalg.matrix_rank(c - c.mean(0)) == 2:
            e = kernels.spline_apply(w[["rx", "ry"]].to_numpy(), c, *kernels.spline_fit(c, k[["sx", "sy"]].to_numpy())) - w[["sx", "sy"]].to_numpy()
            rmse = float(np.sqrt((e**2).sum(1).mean()))
        return pd.DataFrame({"job": [key[0]], "withheld": [len(w)], "rmse": pd.array([rmse], "Float64")})

    return flagged.groupBy("job").applyInPandas(run, "job bigint, withheld bigint, rmse double")


#: Matchers by name: from conditioned pictures (job, side, y, x, w) to ties (job, i, sx, sy, rx, ry, conf). Others may be added.
MATCHERS: dict[str, Callable[[DataFrame], DataFrame]] = {"keypoints": lambda conditioned: matches(cut(features(conditioned)))}


def register(px: DataFrame, width: float, height: float, window: int = 41, matcher: str = "keypoints", progress: Callable[[int, str], None] | None = None) -> DataFrame:
    """One row of metrics and a status for each job, from pixels job, side ('s' or 'r'), y, x, dn.

    matcher names one of MATCHERS; a job of whose ties one breaks the contract (finite places, confidences from 0 to 1,
    numbers that don't repeat) has no ties and says so. progress is told the percentage and name of each stage as it begins.

    Candidates are the matches before tracking, so the inlier ratio counts what tracking rejects. Splines are
    only fitted for jobs that pass the gates. Pictures may have any size.
    """
    if matcher not in MATCHERS:
        raise ValueError(f"no matcher {matcher}: {sorted(MATCHERS)}")
    tell = progress or (lambda percent, stage: None)
    tell(30, "conditioning")
    conditioned = cut(image.wallis(px, window, ["job", "side"]).select("job", "side", "y", "x", "w"))
    tell(40, "matching")
    raw = cut(MATCHERS[matcher](conditioned).select("job", F.col("i").cast("bigint").alias("i"), *[F.col(c).cast("double").alias(c) for c in ("sx", "sy", "rx", "ry", "conf")]))
    broken = raw.where(F.size(rules.match_violations(*[F.col(c) for c in ("sx", "sy", "rx", "ry", "conf")])) > 0).select("job")
    broken = cut(broken.unionByName(raw.groupBy("job", "i").count().where("count > 1 or i is null").select("job")).distinct().withColumn("_broken", F.lit(True)))
    raw = raw.join(broken, "job", "left_anti")
    tell(60, "filtering")
    flagged = cut(ties.grid_flag(judged(refined(conditioned, raw)), width, height, F.col("inlier")))

    def areas(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("i")
        return pd.DataFrame({"job": key[0], "area": kernels.voronoi_areas(p[["rx", "ry"]].to_numpy(), width, height)})

    u = ties.uniformity(flagged.where("retained").groupBy("job").applyInPandas(areas, "job bigint, area double"), ["job"])
    kept = F.col("retained")
    only = lambda c: F.when(kept, F.col(c))
    q = flagged.groupBy("job").agg(
        F.count(F.lit(1)).alias("refined"), F.count_if("inlier").alias("inliers"), F.count_if(kept).alias("retained"),
        (ties.spans_plane(only("sx"), only("sy")) & ties.spans_plane(only("rx"), only("ry"))).alias("plane"), F.sqrt(F.avg(F.when(F.col("inlier"), F.col("res") * F.col("res")))).alias("consensus_rmse"),
    )
    n = raw.groupBy("job").agg(F.count(F.lit(1)).alias("candidates"))
    q = px.select("job").distinct().join(n, "job", "left").join(q, "job", "left").join(u, "job", "left").join(broken, "job", "left")
    q = q.fillna({"candidates": 0, "refined": 0, "inliers": 0, "retained": 0, "vsui": 0.0}).withColumn("plane", F.coalesce("plane", F.lit(False)))
    q = q.withColumn("ratio", F.when(F.col("candidates") > 0, F.col("inliers") / F.col("candidates")).otherwise(0.0))
    reasons = ties.gate_reasons(F.col("ratio"), F.col("retained"), F.col("vsui"), F.col("plane"))
    q = cut(q.withColumn("reasons", F.concat_ws(";", F.when(F.col("_broken"), "match contract"), reasons)).drop("_broken"))
    tell(75, "spline")
    passed = q.where("reasons = ''").select("job")
    q = q.join(held_out(flagged.join(passed, "job", "left_semi")), "job", "left").fillna({"withheld": 0})
    # the spline's error at ties left out of it; for a rejected job the consensus's own, which is a diagnosis and no validation
    basis = F.when(F.col("reasons") != "", "rejected").when(F.col("withheld") >= 8, "withheld").otherwise("none")
    q = q.withColumns({"basis": basis, "rmse": F.when(F.col("reasons") == "", F.col("rmse")).otherwise(F.col("consensus_rmse"))}).drop("consensus_rmse")
    return q.withColumn("status", S.quality_status(F.col("reasons") == "", F.col("withheld") >= 8, F.col("rmse"), F.col("vsui")))


def register_pairs(spark, d):
    """Two jobs: the smoothed pixels against themselves moved by (6, -4) and by (-3, 5); a margin that one of the two lacks is cut off."""
    m = image.box_moments(view(spark, d, "px"), 2).select("y", "x", F.col("m").alias("dn"))
    low, high = (v or 0.0 for v in m.agg(F.min("dn"), F.max("dn")).first())
    m = cut(m.withColumn("dn", F.floor((F.col("dn") - low) / max(high - low, 1e-9) * 255).cast("double")))
    parts = None
    for job, (dx, dy) in enumerate(((6, -4), (-3, 5))):
        crop = lambda t: t.where("x >= 8 and x < 92 and y >= 8").select(F.lit(job).cast("bigint").alias("job"), "side", (F.col("y") - 8).cast("int").alias("y"), (F.col("x") - 8).cast("int").alias("x"), "dn")  # noqa: B023, E731
        both = m.withColumn("side", F.lit("r")).unionByName(m.select((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), "dn", F.lit("s").alias("side")))
        parts = crop(both) if parts is None else parts.unionByName(crop(both))
    high_y = m.agg(F.max("y")).first()[0] or 0
    out = register(parts.where(F.col("y") <= high_y - 16), 84.0, float(max(1, high_y - 15)))
    return out.select("job", "candidates", "inliers", "retained", F.round("ratio", 6).alias("ratio"), F.round("vsui", 6).alias("vsui"), "withheld", F.round("rmse", 6).alias("rmse"), "reasons", "status")


Q["register_pairs"] = register_pairs
