"""Quantiles and neighbours of groups of any size: the same taken apart as taken whole."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from selenite.operators import spread, ties

SHARES = [0.0, 0.01, 0.5, 0.95, 1.0]


def values(kind):
    r = np.random.default_rng(6)
    return {
        "even": r.random(3000), "ties": np.floor(r.random(3000) * 7), "one": np.full(500, 2.5), "wide": np.exp(r.normal(0, 200, 2000)) * r.choice([-1, 1], 2000), "pair": np.array([-1.7976931348623157e308, 1.7976931348623157e308]),
        "tiny": r.random(800) * 5e-324 * 2**40, "skewed": np.concatenate([np.zeros(2500), r.random(10)]), "few": np.array([3.0]),
    }[kind].tolist()


KINDS = ["even", "ties", "one", "wide", "pair", "tiny", "skewed", "few"]


def test_quantiles_by_ranges(spark):
    """All kinds of values, a group each."""
    data = [(10 + i, v) for i, kind in enumerate(KINDS) for v in values(kind)] + [(10, None)] * 5 + [(2, 1.0), (2, 3.0), (3, None), (None, 7.0), (None, 9.0), (4, float("nan")), (4, 1.0)]
    t = spark.createDataFrame(data, "k int, v double").repartition(5)
    plain = lambda x: {r.k: r.q for r in x.collect()}
    want, got = (plain(spread.quantiles(t, ["k"], "v", SHARES, n)) for n in (10**9, 0))
    assert set(got) == set(want) == {2, 3, 4, None, *range(10, 10 + len(KINDS))}
    for k in {*want} - {3, 4}:
        assert got[k] == pytest.approx(want[k], rel=1e-12)
    assert got[3] is None and want[3] is None and str(got[4]) == str(want[4])
    alone = spread.quantiles(t.where("k = 10"), [], "v", SHARES, 0).collect()
    assert len(alone) == 1 and alone[0].q == pytest.approx(want[10], rel=1e-12)


def test_a_large_group(spark):
    t = spark.range(50_000).select(F.lit(1).alias("k"), F.rand(3).alias("v"))
    q = spread.quantiles(t, ["k"], "v", [0.5], 0)
    (got,), want = q.collect(), t.agg(F.percentile("v", F.lit(0.5)).alias("m")).first().m
    assert got.q[0] == pytest.approx(want, rel=1e-12)


def test_values_are_not_made_anew(spark):
    """However many rounds the ranges take, a value is made for each pass over the table only: two for sizes, one to keep it, one for small groups."""
    made, n = spark.sparkContext.accumulator(0), 2000

    def value(i):
        made.add(1)
        return (i * 7919 % n) ** 3 / 7.0

    t = spark.range(n).repartition(3).select(F.lit(1).alias("k"), F.udf(value, "double")("id").alias("v"))
    (got,) = spread.quantiles(t, ["k"], "v", SHARES, 0).collect()
    assert got.q == pytest.approx(np.quantile([i**3 / 7.0 for i in range(n)], SHARES).tolist(), rel=1e-12)
    assert made.value <= 4 * n


@pytest.mark.parametrize("parts", ["1", "7"])
def test_neighbours_by_ranges(spark, parts):
    r = random.Random(2)
    data = [(0 if r.random() < 0.7 else r.choice([1, 2, None]), i, float(r.randrange(9))) for i in range(1500)] + [(5, 1, 1.0)]
    t = spark.createDataFrame(data, "k int, i int, v double").repartition(9)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = [{(x.k, x.i): x.next and tuple(x.next) for x in spread.with_next(t, ["k"], ["i"], ["i", "v"], n).collect()} for n in (0, 10**9)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    want = {}
    for k in {k for k, *_ in data}:
        own = sorted((i, v) for g, i, v in data if g == k)
        want |= {(k, a[0]): b for a, b in zip(own, [*own[1:], None])}
    assert got[0] == got[1] == want


def test_scaled_errors(spark):
    """Neither overflow nor underflow, and nulls don't count."""
    for own in ([1e200, 2e200, 1e-200], [1e-200, 3e-200], [0.0, 0.0], [3.0, 4.0, None], [5e-324], []):
        t = spark.createDataFrame([(1, v) for v in own], "job int, res double")
        kept = [v for v in own if v is not None]
        got = [r.rmse for r in ties.scaled_rmse(t).collect()]
        peak = max(kept, default=0)
        want = peak * math.sqrt(sum((v / peak) ** 2 for v in kept) / len(kept)) if peak else 0.0
        assert got == ([pytest.approx(want, rel=1e-12, abs=0)] if own else [])
