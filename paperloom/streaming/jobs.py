"""Streaming twins of the batch rules over jobs: status changes, rate windows, lockouts, field upserts.

State is one small tuple a key, in Spark's state store; it is dropped when a key is
silent for ``idle``.  Rows of one key within a batch are taken in the order of time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import files

IDLE = 7 * 24 * 3600 * 1000


def _stateful(events: DataFrame, key: str, out: str, state: str, begin: tuple, step: Callable, idle: int) -> DataFrame:
    """Rows of ``step(state, row) -> (state, output or None)``; input needs ts and event_id."""
    names = [x.split()[0] for x in out.split(", ")]

    def run(k, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        own = held.get if held.exists else begin
        rows = []
        for row in pd.concat(list(parts)).sort_values(["ts", "event_id"]).itertuples(index=False):
            own, said = step(own, row)
            if said is not None:
                rows.append((k[0], *said))
        held.update(own)
        held.setTimeoutDuration(idle)
        yield pd.DataFrame(rows, columns=names)

    return events.groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.ProcessingTimeTimeout)


def status_changes(events: DataFrame, *, idle: int = IDLE) -> DataFrame:
    """(job_id, event_id, status): events (job_id, event_id, status, ts) whose status is another than the job's last one."""
    def step(own, row):
        return ((row.status,), (int(row.event_id), row.status)) if row.status != own[0] else (own, None)

    return _stateful(events, "job_id", "job_id long, event_id long, status string", "status string", (None,), step, idle)


def rate_limited(events: DataFrame, *, limit: int = 60, seconds: int = 60, idle: int = IDLE) -> DataFrame:
    """(key, event_id, n, allowed) of events (key, event_id, ts): windows open at a key's first event."""
    def step(own, row):
        t = pd.Timestamp(row.ts).value // 1000
        start, n = own
        if start < 0 or t >= start + seconds * 1_000_000:
            start, n = t, 0
        return (start, n + 1), (int(row.event_id), n + 1, n + 1 <= limit)

    return _stateful(events, "key", "key long, event_id long, n int, allowed boolean", "start long, n int", (-1, 0), step, idle)


def lockouts(events: DataFrame, *, failures: int = 5, minutes: int = 15, idle: int = IDLE) -> DataFrame:
    """(key, event_id, state) of sign-ins (key, event_id, ok, ts)."""
    def step(own, row):
        t = pd.Timestamp(row.ts).value // 1000
        n, until = own
        if t < until:
            return own, (int(row.event_id), "refused")
        if row.ok:
            return (0, until), (int(row.event_id), "ok")
        if n + 1 >= failures:
            return (n + 1, t + minutes * 60_000_000), (int(row.event_id), "locked")
        return (n + 1, until), (int(row.event_id), "failed")

    return _stateful(events, "key", "key long, event_id long, state string", "n int, until long", (0, -1), step, idle)


def store_fields(fields: DataFrame, path: str, checkpoint: str):
    """Writes a stream of fields to a field store.  A batch that runs again replaces the same jobs, so it leaves the store as it was."""
    return (fields.writeStream.foreachBatch(lambda batch, _: files.write_fields(batch, path)).option("checkpointLocation", checkpoint).outputMode("append"))


def windowed_counts(events: DataFrame, *, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n): events by windows of time; rows later than ``late`` are left out, as the watermark says."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
