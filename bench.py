"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line of warm medians, their total that of NAMES alone."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
NAMES = """quality_report wallis box_mean_std entropy_by_group route_pairs knn2 mutual_match grid_nms_k1 residual_quantiles vsui_voronoi
tps_fit homography_fit bicubic_gather box_overlap job_state job_sessions tag_first_match odl_parse raw_roundtrip tiff_roundtrip""".split()
#: Timed too, but not part of the total, which stays comparable between rounds.
MORE = "register_pairs unique_pairs spline_warp pds3_records pds4_records window_bundle bundle_export tiff_formats".split()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from selenite import registry

    queries, took = registry.queries(), {}
    for name in NAMES + MORE:
        times = []
        for _ in range(1 + (RUNS if name in NAMES else 1)):
            began = time.time()
            queries[name](spark, SF).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        took[name] = round(statistics.median(times[1:]), 3)  # the first run compiles
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_warm_seconds", "value": round(sum(took[n] for n in NAMES), 3), "unit": "sec", "queries": took, "sf": SF}))
    spark.stop()


if __name__ == "__main__":
    main()
