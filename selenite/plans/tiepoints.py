"""Queries over tie points and descriptors, with their SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import kernels, match, spread, ties
from .views import duck, view

Q, SQL = {}, {}
r6 = lambda c: F.round(c, 6)
H = [1.03, 0.02, 5.5, -0.015, 1.02, 20.0, 0.0, 0.0, 1.0]
SIDE = 1007.0


def query(f):
    Q[f.__name__] = f
    return f


def _scored(spark, d, numbered: bool = True):
    return ties.consensus(view(spark, d, "tie" if numbered else "tie_unnumbered"), H)


def _distinct(t):
    """Ties without repeated sites, on the canvas."""
    return t.where(f"rx between 0 and {SIDE} and ry between 0 and {SIDE}")


D = lambda x: f"{x}::double"
PROJ = f"""s as (select *, {D(1.03)} * rx + {D(0.02)} * ry + {D(5.5)} px, {D(-0.015)} * rx + {D(1.02)} * ry + {D(20.0)} py from tie),
t as (select *, sqrt((px - sx) * (px - sx) + (py - sy) * (py - sy)) res from s)"""


@query
def project_residual(spark, d):
    return ties.residuals(view(spark, d, "tie"), H).select("job", "i", r6("px").alias("px"), r6("py").alias("py"), r6("res").alias("res"))


SQL["project_residual"] = duck(f"+{PROJ} select job, i, round(px, 6) px, round(py, 6) py, round(res, 6) res from t", "tie")


@query
def consensus(spark, d):
    return _scored(spark, d).where("inlier").select("job", "i", r6("res").alias("res"))


SQL["consensus"] = duck(f"+{PROJ} select job, i, round(res, 6) res from t where res <= 3.5", "tie")

NMS = f"""g as (select *, least(floor(rx / {SIDE}::double * 8), 7) gx, least(floor(ry / {SIDE}::double * 8), 7) gy,
 row_number() over (partition by job, rx, ry order by conf desc, i) one from tie where rx between 0 and {SIDE} and ry between 0 and {SIDE}),
k as (select *, row_number() over (partition by job, gx, gy order by conf desc, i) k from g where one = 1)"""


def _nms(spark, d, k):
    return ties.grid_top(_distinct(view(spark, d, "tie")), SIDE, SIDE, k)


@query
def grid_nms_k1(spark, d):
    return _nms(spark, d, 1).select("job", "i", r6("conf").alias("conf"))


@query
def grid_nms_k3(spark, d):
    return _nms(spark, d, 3).select("job", "i", r6("conf").alias("conf"))


for _n in (1, 3):
    SQL[f"grid_nms_k{_n}"] = duck(f"+{NMS} select job, i, round(conf, 6) conf from k where k <= {_n}", "tie")


@query
def nearest_site_lattice(spark, d):
    return ties.lattice_cells(_nms(spark, d, 1), 1000, 1000, 50).select("job", "i", "area")


LATTICE = f"""{NMS}, la as (select (u + 0.5) * 50 x, (v + 0.5) * 50 y, u, v from (select unnest(range(20)) u), (select unnest(range(20)) v)),
ne as (select job, u, v, arg_min(i, ((x - rx) * (x - rx) + (y - ry) * (y - ry), i)) i from k, la where k = 1 group by 1, 2, 3),
ar as (select job, i, count(*) * 2500.0::double area from ne group by 1, 2)"""
SQL["nearest_site_lattice"] = duck(f"+{LATTICE} select job, i, area from ar", "tie")


@query
def vsui_given_areas(spark, d):
    return ties.uniformity(ties.lattice_cells(_nms(spark, d, 1), 1000, 1000, 50), ["job"]).select("job", r6("vsui").alias("vsui"))


SQL["vsui_given_areas"] = duck(f"+{LATTICE} select job, round(coalesce(greatest(0, least(1, 1 - stddev_pop(area) / (avg(area) + 1e-6))), 0), 6) vsui from ar group by 1", "tie")


def _per_job(t, f, schema):
    """f(arrays of one job) for each job: thinned ties, so a group is bounded by the cells of the grid."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return f(pdf.sort_values("i", ignore_index=True))

    return t.groupBy("job").applyInPandas(run, schema)


@query
def vsui_voronoi(spark, d):
    """Exact cell areas of the thinned sites, and their uniformity."""

    def areas(p):
        a = kernels.voronoi_areas(p[["rx", "ry"]].to_numpy(float), SIDE, SIDE)
        return pd.DataFrame({"job": p.job, "i": p.i, "area": a})

    a = _per_job(_nms(spark, d, 1).select("job", "i", "rx", "ry"), areas, "job bigint, i bigint, area double")
    return ties.uniformity(a, ["job"]).select("job", r6("vsui").alias("vsui"))


@query
def spatial_occupancy(spark, d):
    return ties.occupancy(_distinct(view(spark, d, "tie_unnumbered")), SIDE, SIDE).select("job", "n", "occupied", "share")


SQL["spatial_occupancy"] = duck(f"""+o as (select job, count(*) n, count(distinct (least(floor(rx / {SIDE}::double * 5), 4), least(floor(ry / {SIDE}::double * 5), 4))) occupied
 from tie where rx between 0 and {SIDE} and ry between 0 and {SIDE} group by 1) select job, n, occupied, case when n < 3 then 0 else occupied / 25.0::double end share from o""", "tie")


@query
def spatial_coverage(spark, d):
    """0.55 of the hull's share and 0.45 of the occupied cells' share, within 0..1. Hulls of parts are merged, so no job's ties meet in one task."""
    t = _distinct(view(spark, d, "tie_unnumbered"))

    def part_hull(p):
        h = kernels.hull(p[["rx", "ry"]].to_numpy(float))
        return pd.DataFrame({"job": p.job.iloc[0], "i": 0, "rx": h[:, 0], "ry": h[:, 1]})

    parts = t.select("job", "rx", "ry", F.pmod(F.xxhash64("rx", "ry"), F.lit(16)).alias("_p")).groupBy("job", "_p").applyInPandas(lambda p: part_hull(p), "job bigint, i bigint, rx double, ry double")

    def area(p):
        return pd.DataFrame({"job": [p.job.iloc[0]], "hull": [kernels.polygon_area(kernels.hull(p[["rx", "ry"]].to_numpy(float)))]})

    o = ties.occupancy(t, SIDE, SIDE).join(_per_job(parts, area, "job bigint, hull double"), "job")
    v = F.when(F.col("n") < 3, 0.0).otherwise(F.least(F.lit(1.0), 0.55 * F.col("hull") / (SIDE * SIDE) + 0.45 * F.col("share")))
    return o.select("job", r6(v).alias("coverage"))


@query
def rmse_report(spark, d):
    return ties.report(_scored(spark, d, False)).select("job", "candidates", "inliers", r6("rmse").alias("rmse"))


SQL["rmse_report"] = duck(f"+{PROJ} select job, count(*) candidates, count(*) filter (res <= 3.5) inliers, round(sqrt(avg(res * res) filter (res <= 3.5)), 6) rmse from t group by 1", "tie")


@query
def residual_quantiles(spark, d):
    return ties.error_quantiles(_scored(spark, d, False)).select("job", F.round("median", 4).alias("median"), F.round("p95", 4).alias("p95"))


SQL["residual_quantiles"] = duck(f"+{PROJ} select job, round(quantile_cont(res, 0.5) filter (res <= 3.5), 4) median, round(quantile_cont(res, 0.95) filter (res <= 3.5), 4) p95 from t group by 1", "tie")


@query
def inlier_ratio(spark, d):
    return ties.report(_scored(spark, d, False)).select("job", r6("ratio").alias("ratio"), (F.col("candidates") - F.col("inliers")).alias("rejected"))


SQL["inlier_ratio"] = duck(f"+{PROJ} select job, round(count(*) filter (res <= 3.5) / count(*), 6) ratio, count(*) filter (res > 3.5) rejected from t group by 1", "tie")


@query
def scaled_rmse(spark, d):
    return ties.scaled_rmse(_scored(spark, d, False)).select("job", r6("rmse").alias("rmse"))


SQL["scaled_rmse"] = duck(f"+{PROJ} select job, round(sqrt(avg(res * res)), 6) rmse from t group by 1", "tie")


@query
def report_rollup(spark, d):
    """Counts by job and line of thought (inlier or not), with subtotals."""
    return _scored(spark, d, False).rollup("job", "inlier").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("conf")).alias("conf"))


SQL["report_rollup"] = duck(f"+{PROJ} select job, res <= 3.5 inlier, count(*) n, round(avg(conf), 6) conf from t group by rollup(job, inlier)", "tie")


def _flagged(spark, d):
    s = _scored(spark, d)
    return ties.grid_flag(s, SIDE, SIDE, F.col("inlier") & F.col("rx").between(0, SIDE) & F.col("ry").between(0, SIDE))


def _withheld(spark, d):
    return _flagged(spark, d).where("inlier and not retained")


@query
def withheld_validation(spark, d):
    """Error over inliers that thinning left out, where there are eight of them or more."""
    g = _withheld(spark, d).groupBy("job").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("res") * F.col("res"))).alias("rmse"))
    return g.where("n >= 8").select("job", "n", r6("rmse").alias("rmse"))


GATE = PROJ + f""", inl as (select *, row_number() over (partition by job, rx, ry order by conf desc, i) one from t where res <= 3.5 and rx between 0 and {SIDE} and ry between 0 and {SIDE}),
kk as (select *, row_number() over (partition by job, least(floor(rx / {SIDE}::double * 8), 7), least(floor(ry / {SIDE}::double * 8), 7) order by conf desc, i) k from inl where one = 1),
kept as (select * from kk where k = 1)"""
SQL["withheld_validation"] = duck(f"+{GATE} select job, count(*) n, round(sqrt(avg(res * res)), 6) rmse from t where res <= 3.5 and (job, i) not in (select (job, i) from kept) group by 1 having count(*) >= 8", "tie")


def _quality(spark, d):
    """One row for each job: ratio, thinned ties, their uniformity on a lattice, held-out error, reasons, status."""
    s = _flagged(spark, d)
    kept, out = F.col("retained"), F.col("inlier") & ~F.col("retained")
    only = lambda c: F.when(kept, F.col(c))
    q = s.groupBy("job").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if("inlier").alias("inliers"), (F.count_if("inlier") / F.count(F.lit(1))).alias("ratio"), F.count_if(kept).alias("retained"),
        (ties.spans_plane(only("sx"), only("sy")) & ties.spans_plane(only("rx"), only("ry"))).alias("plane"),
        F.count_if(out).alias("withheld"), F.sqrt(F.avg(F.when(out, F.col("res") * F.col("res")))).alias("rmse"),
    )
    u = ties.uniformity(ties.lattice_cells(s.where(kept).select("job", "i", "rx", "ry"), 1000, 1000, 50), ["job"])
    q = q.join(u, "job", "left").withColumn("vsui", F.coalesce("vsui", F.lit(0.0)))
    reasons = ties.gate_reasons(F.col("ratio"), F.col("retained"), F.col("vsui"), F.col("plane"))
    q = q.withColumn("reasons", F.concat_ws(";", reasons))
    return q.withColumn("status", S.quality_status(F.col("reasons") == "", F.col("withheld") >= 8, F.col("rmse"), F.col("vsui")))


QUALITY = GATE + """, ret as (select job, count(*) retained, var_pop(sx) * var_pop(sy) - covar_pop(sx, sy) ** 2 > 1e-9 and var_pop(rx) * var_pop(ry) - covar_pop(rx, ry) ** 2 > 1e-9 plane from kept group by 1),
la as (select (u + 0.5) * 50 x, (v + 0.5) * 50 y, u, v from (select unnest(range(20)) u), (select unnest(range(20)) v)),
ne as (select job, u, v, arg_min(i, ((x - rx) * (x - rx) + (y - ry) * (y - ry), i)) i from kept, la group by 1, 2, 3),
ar as (select job, i, count(*) * 2500.0::double area from ne group by 1, 2),
un as (select job, greatest(0, least(1, 1 - stddev_pop(area) / (avg(area) + 1e-6))) vsui from ar group by 1),
wi as (select job, count(*) withheld, sqrt(avg(res * res)) rmse from t where res <= 3.5 and (job, i) not in (select (job, i) from kept) group by 1),
re as (select job, count(*) candidates, count(*) filter (res <= 3.5) inliers, count(*) filter (res <= 3.5) / count(*) ratio from t group by 1),
q0 as (select re.*, coalesce(retained, 0) retained, coalesce(plane, false) plane, coalesce(vsui, 0) vsui, coalesce(withheld, 0) withheld, rmse
 from re left join ret using (job) left join un using (job) left join wi using (job)),
q as (select *, concat_ws(';', case when ratio < 0.7 then 'inlier ratio' end, case when retained < 15 then 'retained count' end,
 case when not plane and retained >= 15 then 'no plane' end, case when vsui < 0.75 then 'uniformity' end) reasons from q0)"""


@query
def quality_report(spark, d):
    q = _quality(spark, d)
    return q.select("job", "candidates", "inliers", r6("ratio").alias("ratio"), "retained", r6("vsui").alias("vsui"), "withheld", r6("rmse").alias("rmse"), "reasons", "status")


STATUS = "case when reasons = '' and withheld >= 8 and rmse <= 0.5 and vsui >= 0.75 then 'complete' else 'review_required' end"
SQL["quality_report"] = duck(f"+{QUALITY} select job, candidates, inliers, round(ratio, 6) ratio, retained, round(vsui, 6) vsui, withheld, round(rmse, 6) rmse, reasons, {STATUS} status from q", "tie")


@query
def gate_reasons(spark, d):
    return _quality(spark, d).select("job", "plane", "reasons")


SQL["gate_reasons"] = duck(f"+{QUALITY} select job, plane, reasons from q", "tie")


@query
def quality_status(spark, d):
    return _quality(spark, d).select("job", "status")


SQL["quality_status"] = duck(f"+{QUALITY} select job, {STATUS} status from q", "tie")


@query
def unique_pairs(spark, d):
    """One-to-one endpoints by descending confidence, endpoints on a coarse raster so that they repeat."""
    t = view(spark, d, "tie").select("job", "i", F.floor(F.col("sx") / 50).alias("sx"), F.floor(F.col("sy") / 50).alias("sy"), F.floor(F.col("rx") / 50).alias("rx"), F.floor(F.col("ry") / 50).alias("ry"), "conf")
    return match.unique_pairs(t, ["job"]).select("job", "i", "sx", "sy", "rx", "ry", r6("conf").alias("conf"))


def _desc(spark, d):
    e = view(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return e.where("id % 2 = 0"), e.where("id % 2 = 1")


KNN = """ds as (select vec_id id, embedding v from embeddings where vec_id % 2 = 0), dr as (select vec_id id, embedding v from embeddings where vec_id % 2 = 1),
pd as (select a.id s, b.id r, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))) d from ds a, dr b),
f0 as (select *, row_number() over (partition by s order by d, r) k from pd), b0 as (select *, row_number() over (partition by r order by d, s) k from pd),
fw as (select x.s, x.r, x.d d1, y.d d2 from f0 x join f0 y on x.s = y.s and x.k = 1 and y.k = 2),
bw as (select x.s, x.r, x.d d1, y.d d2 from b0 x join b0 y on x.r = y.r and x.k = 1 and y.k = 2)"""
RATIO = 0.97


@query
def knn2(spark, d):
    return match.nearest_two(*_desc(spark, d)).select("s", "r", r6("d1").alias("d1"), r6("d2").alias("d2"))


SQL["knn2"] = f"with {KNN} select s, r, round(d1, 6) d1, round(d2, 6) d2 from fw"


@query
def ratio_match(spark, d):
    m = match.ratio_test(match.nearest_two(*_desc(spark, d)), RATIO)
    return m.select("s", "r", r6("conf").alias("conf"))


SQL["ratio_match"] = f"with {KNN} select s, r, round(1 - d1 / d2, 6) conf from fw where d1 < {RATIO} * d2"


@query
def mutual_match(spark, d):
    a, b = _desc(spark, d)
    m = match.reciprocal(*(match.ratio_test(n, RATIO) for n in match.nearest_both(a, b)))
    return m.select("s", "r", r6("conf").alias("conf"))


SQL["mutual_match"] = f"with {KNN} select f.s, f.r, round(least(1 - f.d1 / f.d2, 1 - b.d1 / b.d2), 6) conf from fw f join bw b on f.s = b.s and f.r = b.r where f.d1 < {RATIO} * f.d2 and b.d1 < {RATIO} * b.d2"


@query
def tps_eval(spark, d):
    """A spline with fixed weights at every pixel."""
    c = spark.range(16).select(F.col("id").alias("k"), ((F.col("id") * 37) % 100).cast("double").alias("cx"), ((F.col("id") * 53) % 100).cast("double").alias("cy"), ((F.col("id") % 5) - 2).cast("double").alias("w"))
    p = view(spark, d, "px").select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return ties.spline_eval(p, c, (1.5, 1.01, -0.02)).select("x", "y", F.round("v", 4).alias("v"))


SQL["tps_eval"] = duck("""+c as (select (k * 37) % 100 cx, (k * 53) % 100 cy, k % 5 - 2 w from (select unnest(range(16)) k)),
e as (select x, y, w, (x - cx) * (x - cx) + (y - cy) * (y - cy) r2 from px, c)
select x::double x, y::double y, round(1.5::double + 1.01::double * x - 0.02::double * y + sum(case when r2 > 0 then w * 0.5::double * r2 * ln(r2) else 0 end), 4) v from e group by x, y""", "px")


@query
def tps_fit(spark, d):
    """Splines of each job's thinned inliers both ways, with their errors at the ties and at those withheld."""
    s = _scored(spark, d).where("inlier")
    kept = ties.grid_top(_distinct(s), SIDE, SIDE, 1).select("job", "i", "sx", "sy", "rx", "ry")

    def fit(p):
        out = {"job": p.job.iloc[0], "n": len(p)}
        src, ref = p[["sx", "sy"]].to_numpy(float), p[["rx", "ry"]].to_numpy(float)
        for name, a, b in (("forward", src, ref), ("backward", ref, src)):
            ok = len(p) >= 4 and np.linalg.matrix_rank(a - a.mean(0)) == 2
            err = kernels.spline_apply(a, a, *kernels.spline_fit(a, b)) - b if ok else np.full((1, 2), np.nan)
            out[name] = round(float(np.sqrt((err**2).sum(1).mean())), 6)
        return pd.DataFrame([out])

    return _per_job(kept, fit, "job bigint, n bigint, forward double, backward double")


@query
def homography_fit(spark, d):
    """A robust homography of each job's thinned ties, with outliers among them."""
    t = ties.grid_top(_distinct(view(spark, d, "tie")), SIDE, SIDE, 3)

    def fit(p):
        h, ok = kernels.robust_homography(p[["rx", "ry"]].to_numpy(float), p[["sx", "sy"]].to_numpy(float), seed=int(p.job.iloc[0]), tries=500)
        return pd.DataFrame({"job": [p.job.iloc[0]], "n": [len(p)], "inliers": [int(ok.sum())], "h": [[] if h is None else np.round(h, 6).ravel().tolist()]})

    return _per_job(t, fit, "job bigint, n bigint, inliers bigint, h array<double>")


@query
def ties_to_lonlat(spark, d):
    return ties.lonlat(view(spark, d, "tie"), 22.0, 15.0, 0.001).select("job", "i", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


SQL["ties_to_lonlat"] = duck("select job, i, round(22 + (rx + 0.5) * 0.001::double, 9) lon, round(15 - (ry + 0.5) * 0.001::double, 9) lat from tie", "tie")


@query
def ties_fullscene(spark, d):
    """Scene coordinates of ties within a tile at (1000, 2000), with wrapped longitudes."""
    t = view(spark, d, "tie")
    x, y = F.col("rx") + 1000, F.col("ry") + 2000
    return t.select("job", "i", r6(x).alias("x"), r6(y).alias("y"), F.round(S.wrapped(359.0 + (x + 0.5) * 0.001), 6).alias("lon"), F.round(15.0 - (y + 0.5) * 0.001, 6).alias("lat"))


SQL["ties_fullscene"] = duck("""select job, i, round(rx + 1000, 6) x, round(ry + 2000, 6) y, round((359 + (rx + 1000.5) * 0.001::double + 180) % 360 - 180, 6) lon,
 round(15 - (ry + 2000.5) * 0.001::double, 6) lat from tie""", "tie")


@query
def csv_rows(spark, d):
    t = view(spark, d, "tie").select("job", "i", F.format_string("P-%04d", "i").alias("id"), F.concat(F.lit('a "q", '), F.col("job").cast("string")).alias("note"), F.col("i").cast("string").alias("n"))
    return ties.csv_rows(t, ["id", "n", "note"])


SQL["csv_rows"] = duck("""select job, i, printf('P-%04d', i) || ',' || i || ',"a ""q"", ' || job || '"' line from tie""", "tie")


@query
def dossier_json(spark, d):
    q = ties.report(_scored(spark, d, False))
    return q.select("job", F.to_json(F.struct("job", "candidates", "inliers", (F.col("candidates") - F.col("inliers")).alias("rejected"))).alias("dossier"))


SQL["dossier_json"] = duck(f"""+{PROJ}, r as (select job, count(*) c, count(*) filter (res <= 3.5) n from t group by 1)
select job, '{{"job":' || job || ',"candidates":' || c || ',"inliers":' || n || ',"rejected":' || (c - n) || '}}' dossier from r""", "tie")


@query
def nearest_tie(spark, d):
    """The tie nearest to the canvas' middle within 15 pixels, for each job."""
    t = view(spark, d, "tie").withColumn("dist", F.hypot(F.col("rx") - 500, F.col("ry") - 500)).where("dist <= 15")
    return t.groupBy("job").agg(F.min_by("i", F.struct("dist", "i")).alias("i"), r6(F.min("dist")).alias("dist"))


SQL["nearest_tie"] = duck("+n as (select job, i, sqrt((rx - 500) * (rx - 500) + (ry - 500) * (ry - 500)) dist from tie) select job, arg_min(i, (dist, i)) i, round(min(dist), 6) dist from n where dist <= 15 group by 1", "tie")


@query
def shoelace_area(spark, d):
    """Signed area of the closed line through each job's ties in order, by neighbouring vertices; taken positive."""
    t = spread.with_next(view(spark, d, "tie").select("job", "i", "rx", "ry"), ["job"], ["i"], ["rx", "ry"])
    side = lambda x, y, u, v: x * v - u * y
    inner = F.sum(side(F.col("rx"), F.col("ry"), F.col("next.rx"), F.col("next.ry")))
    first, last = (f(F.struct("rx", "ry"), "i") for f in (F.min_by, F.max_by))
    t = t.groupBy("job").agg(F.coalesce(inner, F.lit(0.0)).alias("c"), first.alias("a"), last.alias("z"))
    closed = F.col("c") + side(F.col("z.rx"), F.col("z.ry"), F.col("a.rx"), F.col("a.ry"))
    return t.select("job", F.round(F.abs(closed) / 2, 3).alias("area"))


SQL["shoelace_area"] = duck("""+v as (select job, rx * coalesce(lead(ry) over w, first_value(ry) over w) - coalesce(lead(rx) over w, first_value(rx) over w) * ry c
 from tie window w as (partition by job order by i)) select job, round(abs(sum(c)) / 2, 3) area from v group by 1""", "tie")


@query
def matches_both_ways(spark, d):
    """Cells found as sources and as references (intersection), and sources only (difference)."""
    t = view(spark, d, "tie_unnumbered")
    a = t.select("job", F.floor(F.col("sx") / 20).alias("u"), F.floor(F.col("sy") / 20).alias("v"))
    b = t.select("job", F.floor(F.col("rx") / 20).alias("u"), F.floor(F.col("ry") / 20).alias("v"))
    return a.intersect(b).withColumn("kind", F.lit("both")).unionByName(a.exceptAll(a.intersect(b).select("job", "u", "v")).distinct().subtract(b).withColumn("kind", F.lit("source")))


SQL["matches_both_ways"] = duck("""+a as (select distinct job, floor(sx / 20)::bigint u, floor(sy / 20)::bigint v from tie), b as (select distinct job, floor(rx / 20)::bigint u, floor(ry / 20)::bigint v from tie)
select *, 'both' kind from (select * from a intersect select * from b) union all select *, 'source' kind from (select * from a except select * from b)""", "tie")
