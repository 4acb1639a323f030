"""The job state machine: as batch queries over its events, and as a stream with keyed state.

Events: job, ts, event_id, kind (queued, processing, progress, complete, failed), ordered by (ts, event_id).
A job exists from its first `queued` on; the first `processing` after it claims it; progress counts while
it is processing; the first terminal event after `queued` absorbs everything later.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupStateTimeout

TERMINAL = ("complete", "failed")


def _at():
    """The place of an event in its job's order."""
    return F.struct("ts", "event_id")


def latest(events: DataFrame) -> DataFrame:
    return events.groupBy("job").agg(F.max_by("kind", _at()).alias("kind"), F.max_by("event_id", _at()).alias("event_id"), F.max("ts").alias("ts"))


def _since_queued(events: DataFrame) -> DataFrame:
    q = events.where("kind = 'queued'").groupBy("job").agg(F.min(_at()).alias("_q"))
    return events.join(q, "job").where(_at() >= F.col("_q"))


def claims(events: DataFrame) -> DataFrame:
    e = _since_queued(events).where("kind = 'processing'")
    return e.groupBy("job").agg(F.min_by("event_id", _at()).alias("event_id"))


def states(events: DataFrame) -> DataFrame:
    """job, status, progress. Partial aggregation only: first claim and first end are minima, then progress between them is counted."""
    e = _since_queued(events)
    first = lambda cond: F.min(F.when(cond, _at()))
    m = e.groupBy("job").agg(first(F.col("kind") == "processing").alias("_c"), first(F.col("kind").isin(*TERMINAL)).alias("_t"), F.min_by("kind", F.when(F.col("kind").isin(*TERMINAL), _at())).alias("_k"))
    p = e.where("kind = 'progress'").join(m, "job").where((_at() > F.col("_c")) & (F.col("_t").isNull() | (_at() < F.col("_t")))).groupBy("job").agg(F.count(F.lit(1)).alias("_n"))
    s = m.join(p, "job", "left")
    done, claimed = F.col("_t").isNotNull(), F.col("_c").isNotNull()
    status = F.when(done, F.col("_k")).when(claimed, "processing").otherwise("queued")
    progress = F.when(done, 100).when(claimed, F.least(5 + 5 * F.coalesce("_n", F.lit(0)), F.lit(95))).otherwise(0)
    return s.select("job", status.alias("status"), progress.cast("int").alias("progress"))


def _ended(events: DataFrame) -> DataFrame:
    end = F.broadcast(events.agg(F.max("ts").alias("_end")))  # one row
    return events.crossJoin(end)


def expired(events: DataFrame, seconds: int) -> DataFrame:
    """Jobs that have stalled: no terminal event, and none at all for so long before the log's end."""
    g = _ended(events).groupBy("job").agg(F.max("ts").alias("ts"), F.max_by("kind", _at()).alias("kind"), F.bool_or(F.col("kind").isin(*TERMINAL)).alias("_done"), F.max("_end").alias("_end"))
    return g.where(~F.col("_done") & (F.col("ts") < F.col("_end") - F.make_dt_interval(secs=F.lit(seconds))))


def older_than(events: DataFrame, days: int) -> DataFrame:
    g = _ended(events).groupBy("job").agg(F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n"), F.max("_end").alias("_end"))
    return g.where(F.col("ts") < F.col("_end") - F.make_dt_interval(days=F.lit(days)))


STATE = "status string, progress int"


def step(status: str | None, progress: int, kind: str) -> tuple[str | None, int]:
    """The state after one event."""
    if status is None:
        return ("queued", 0) if kind == "queued" else (None, 0)
    if status in TERMINAL:
        return status, progress
    if kind in TERMINAL:
        return kind, 100
    if status == "queued" and kind == "processing":
        return "processing", 5
    if status == "processing" and kind == "progress":
        return status, min(progress + 5, 95)
    return status, progress


def state_stream(events: DataFrame, stall: str | None = "15 minutes") -> DataFrame:
    """A stream of states from a stream of events; jobs without news for `stall` of event time fail.

    Repeated deliveries are dropped within the watermark. Events of one micro-batch are applied in their order.
    """
    limit = int(pd.Timedelta(stall).total_seconds() * 1000) if stall else None

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, progress = state.get if state.exists else (None, 0)
        if state.hasTimedOut:
            if status in TERMINAL or status is None:
                state.remove()
                return
            status, progress = "failed", 100
            state.update((status, progress))
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
            for kind in rows["kind"]:
                status, progress = step(status, progress, kind)
            if status is None:
                return
            state.update((status, progress))
            if limit and status not in TERMINAL:
                now = max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + limit
                state.setTimeoutTimestamp(now)
        yield pd.DataFrame({"job": [key[0]], "status": [status], "progress": [progress]})

    e = events.withWatermark("ts", stall or "15 minutes").dropDuplicatesWithinWatermark(["event_id"])
    timeout = GroupStateTimeout.EventTimeTimeout if stall else GroupStateTimeout.NoTimeout
    return e.groupBy("job").applyInPandasWithState(run, "job bigint, status string, progress int", STATE, "update", timeout)


CHANGES = "job bigint, status string, progress int, claimed_by bigint, cause string"


class JobProcessor(StatefulProcessor):
    """One job's state: what it has come to, which event claimed it, and a timer that fails it when it falls silent.

    A job that has ended is kept for `keep` of event time, so that late results meet it and change nothing, and then
    forgotten. cause says what made a row: events, or silence.
    """

    def __init__(self, stall_ms: int, keep_ms: int):
        self.stall, self.keep = stall_ms, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, progress int, claimed_by bigint, last bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        status, progress, claimed, last = self.state.get() if self.state.exists() else (None, 0, None, 0)
        before = (status, progress, claimed)
        for event in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples():
            was = status
            status, progress = step(status, progress, event.kind)
            if was == "queued" and status == "processing":
                claimed = int(event.event_id)  # the first one has it, whoever asks later
            last = max(last, int(event.ts.timestamp() * 1000))
        if status is None:
            return
        self.state.update((status, progress, claimed, last))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(last + (self.keep if status in TERMINAL else self.stall) + 1)
        if (status, progress, claimed) != before:
            yield self._row(key, status, progress, claimed, "events")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, _, claimed, last = self.state.get() if self.state.exists() else (None, 0, None, 0)
        if status is None or status in TERMINAL:
            self.state.clear()
            return
        self.state.update(("failed", 100, claimed, last))
        self.handle.registerTimer(last + self.stall + self.keep + 1)
        yield self._row(key, "failed", 100, claimed, "silence")

    @staticmethod
    def _row(key, status, progress, claimed, cause) -> pd.DataFrame:
        return pd.DataFrame({"job": [key[0]], "status": [status], "progress": [progress], "claimed_by": pd.array([claimed], "Int64"), "cause": [cause]})

    def close(self) -> None:
        pass


def job_stream(events: DataFrame, stall: str = "15 minutes", keep: str = "1 day", late: str = "1 minute") -> DataFrame:
    """CHANGES of jobs from a stream of events: claims, progress, ends, and the expiry of jobs without news for `stall`.

    Events may come late by `late`; repeated deliveries are dropped within the watermark. Needs Spark's RocksDB state
    store (spark.sql.streaming.stateStore.providerClass).
    """
    ms = lambda x: int(pd.Timedelta(x).total_seconds() * 1000)
    e = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return e.groupBy("job").transformWithStateInPandas(JobProcessor(ms(stall), ms(keep)), CHANGES, "Update", "EventTime")
