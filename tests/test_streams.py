"""The stream of jobs with timers: claims, expiry, late and repeated events; the same as the batch."""

import datetime
import random

import pytest

from selenite.streaming import jobs

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
START = datetime.datetime(2024, 1, 1)
KINDS = "job bigint, ts timestamp, event_id bigint, kind string"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    kept = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    yield spark
    spark.conf.set(name, kept)


def run(spark, tmp_path, batches, **options):
    """All changes that the stream tells, batch by batch."""
    src, out = str(tmp_path / "in"), []
    q = None
    for k, rows in enumerate(batches):
        spark.createDataFrame([(j, START + datetime.timedelta(seconds=s), i, kind) for j, s, i, kind in rows], KINDS).coalesce(1).write.mode("append").parquet(src)
        s = jobs.job_stream(spark.readStream.schema(KINDS).parquet(src), **options)
        q = s.writeStream.foreachBatch(lambda df, n: out.extend(map(tuple, df.collect()))).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(240)
        assert q.exception() is None
    return out


def test_claims_and_expiry(rocks, tmp_path):
    """One claim wins; a silent job fails; results after that change nothing; a job that goes on doesn't expire."""
    first = [(1, 0, 10, "queued"), (1, 5, 11, "processing"), (1, 5, 12, "processing"), (2, 0, 20, "queued"), (2, 3, 21, "processing"), (2, 6, 22, "progress"), (3, 1, 30, "processing")]
    more = [(2, 900, 23, "progress"), (2, 6, 22, "progress"), (9, 1100, 90, "queued")]  # a repeated delivery among them
    late = [(1, 1200, 13, "complete"), (2, 1300, 24, "complete"), (9, 5000, 91, "processing")]
    got = run(rocks, tmp_path, [first, more, late, [(8, 5100, 80, "queued")]], stall="15 minutes", keep="1 hour", late="10 seconds")
    of = lambda j: [r[1:] for r in got if r[0] == j]
    assert of(1) == [("processing", 5, 11, "events"), ("failed", 100, 11, "silence")]
    assert of(2) == [("processing", 10, 21, "events"), ("processing", 15, 21, "events"), ("complete", 100, 21, "events")]
    assert of(3) == [] and of(9)[0] == ("queued", 0, None, "events")


def test_stream_equals_batch(rocks, tmp_path):
    r = random.Random(4)
    events = [(r.randrange(30), t + r.random(), i, r.choice(["queued", "processing", "processing", "progress", "progress", "progress", "complete", "failed"])) for i, t in enumerate(range(0, 3000, 5))]
    batches = [events[:200] + events[190:200], events[200:420] + events[400:405], events[420:]]  # some are delivered again
    got = {j: rest for j, *rest in run(rocks, tmp_path, [[b for b in x] for x in batches], stall="10 days", keep="10 days", late="2 minutes")}
    t = rocks.createDataFrame([(j, START + datetime.timedelta(seconds=s), i, kind) for j, s, i, kind in events], KINDS)
    assert {j: tuple(v[:2]) for j, v in got.items()} == {x.job: (x.status, x.progress) for x in jobs.states(t).collect()}
    claims = {x.job: x.event_id for x in jobs.claims(t).collect()}
    assert all(v[2] in (None, claims[j]) for j, v in got.items() if j in claims) and any(v[2] is not None for v in got.values())
