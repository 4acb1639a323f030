"""Every query against its SQL over the smallest tables; those without SQL run and repeat."""

import math

import duckdb
import pytest

from selenite import registry
from selenite.plans.views import TABLES

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def table(rows, names):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = table(df.collect(), df.columns)
    if name in SQL:
        want = duck.execute(SQL[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(df.columns)
        assert got == table(want.fetchall(), names)
    else:
        again = QUERIES[name](spark, SF)
        assert got == table(again.collect(), again.columns)


@pytest.mark.parametrize("name", ["quality_report", "wallis", "mutual_match", "unique_pairs", "job_state"])
def test_same_for_any_number_of_partitions(spark, name):
    kept, results = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = QUERIES[name](spark, SF)
            results.append(table(df.collect(), df.columns))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert results[0] == results[1]


def test_scans_are_pruned(spark):
    df = QUERIES["scale_gap"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "p_name" not in plan and "p_brand" not in plan
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan
