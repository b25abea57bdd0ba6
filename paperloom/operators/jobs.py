"""The document register and its jobs: dashboard, numbering, access, status, limits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import patterns as P


def dashboard(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: documents, success rate in percent, documents of low confidence, the most frequent type (the first by name of equals)."""
    live = docs.filter("not is_deleted")
    by_type = live.groupBy("doc_type").agg(
        F.count("*").alias("n"), F.count("confidence_score").alias("known"), F.count_if(F.col("confidence_score") >= threshold).alias("good"), F.count_if(F.col("confidence_score") < threshold).alias("low"))
    # counts by type are few; everything else is summed from them
    rate = F.round(F.lit(100.0) * F.sum("good") / F.sum("known"), 2)
    top = F.min_by("doc_type", F.when(F.col("doc_type").isNotNull(), F.struct(-F.col("n"), F.col("doc_type"))))
    return by_type.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_documents"), F.when(F.sum("known") > 0, rate).otherwise(0.0).alias("success_rate"),
                       F.coalesce(F.sum("low"), F.lit(0)).alias("low_confidence"), top.alias("top_doc_type"))


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, user_id, doc_number): a user's documents counted in the order of upload, deleted ones too."""
    return docs.select("doc_id", "user_id", F.row_number().over(W.partitionBy("user_id").orderBy("uploaded_at", "doc_id")).alias("doc_number"))


def owned(docs: DataFrame, user: int) -> DataFrame:
    return docs.filter((F.col("user_id") == user) & ~F.col("is_deleted"))


def live(docs: DataFrame) -> DataFrame:
    return docs.filter(~F.col("is_deleted"))


def access(docs: DataFrame, user: int) -> DataFrame:
    """(doc_id, code): 404 for a deleted document, 403 for another user's, 200 else."""
    return docs.select("doc_id", F.when(F.col("is_deleted"), 404).when(F.col("user_id") != user, 403).otherwise(200).alias("code"))


def latest_status(events: DataFrame) -> DataFrame:
    """(job_id, status, progress)."""
    last = events.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))
    return last.withColumn("progress", progress(F.col("status")))


# fixed values: how far a job is, in percent
PROGRESS = {"queued": 0, "ocr_running": 25, "ai_running": 75, "done": 100, "failed": 0}


def progress(status: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in PROGRESS.items() for x in kv])[status]


def startable(docs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Documents without a job that is queued or running; ``jobs``: (doc_id, status)."""
    return docs.join(jobs.filter(F.col("status").isin(*P.ACTIVE_STATUSES)).select("doc_id").distinct(), "doc_id", "left_anti")


def status_changes(events: DataFrame) -> DataFrame:
    """(job_id, event_id, status, ts): events whose status is not that of the event before."""
    w = W.partitionBy("job_id").orderBy("ts", "event_id")
    marked = events.withColumn("_was", F.lag("status").over(w))
    return marked.filter(~F.col("status").eqNullSafe(F.col("_was"))).select("job_id", "event_id", "status", "ts")


def _in_order(events: DataFrame, columns: list[str], begin, step, schema: str) -> DataFrame:
    """Rows (key, *columns) of each key in their order, with a state that each row changes.

    The rule is sequential by key, so a key's rows go through one task; but they
    stream through it, sorted by the shuffle, and only the state is held.
    """
    def run(parts):
        key = state = None
        for pdf in parts:
            out = []
            for row in zip(*(pdf[c] for c in ["key", *columns])):
                if state is None or row[0] != key:
                    key, state = row[0], begin()
                out.append((key, *step(state, *row[1:])))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])

    rows = events.select("key", *columns).repartition("key").sortWithinPartitions("key", *columns[:2])
    return rows.mapInPandas(run, schema)


def rate_limited(events: DataFrame, *, limit: int = 60, seconds: int = 60) -> DataFrame:
    """(key, event_id, window_start, n, allowed): a window opens at a key's first event and, once over, at the next one.

    ``events``: (key, event_id, ts).  ``window_start`` is in microseconds.
    """
    def step(state: list, t: int, event: int) -> tuple:
        if state[0] is None or t >= state[0] + seconds * 1_000_000:
            state[0], state[1] = t, 0
        state[1] += 1
        return event, state[0], state[1], state[1] <= limit

    timed = events.select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id")
    return _in_order(timed, ["t", "event_id"], lambda: [None, 0], step, "key long, event_id long, window_start long, n int, allowed boolean")


def lockouts(events: DataFrame, *, failures: int = 5, minutes: int = 15) -> DataFrame:
    """(key, event_id, state) of sign-ins (key, event_id, ok, ts): refused while locked, else ok or failed; the last failure of a row locks.

    Only a success resets the count, so after a lock the next failure locks again.
   """
    def step(state: list, t: int, event: int, ok: bool) -> tuple:
        if t < state[1]:
            return event, "refused"
        if ok:
            state[0] = 0
            return event, "ok"
        state[0] += 1
        if state[0] >= failures:
            state[1] = t + minutes * 60_000_000
            return event, "locked"
        return event, "failed"

    timed = events.select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id", "ok")
    return _in_order(timed, ["t", "event_id", "ok"], lambda: [0, -1], step, "key long, event_id long, state string")


def duration_ms(start: Column, end: Column) -> Column:
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1000).cast("bigint")


def soft_deleted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The register with these documents marked deleted."""
    marked = docs.join(ids.select("doc_id", F.lit(True).alias("_gone")).distinct(), "doc_id", "left")
    return marked.withColumn("is_deleted", F.col("is_deleted") | F.coalesce("_gone", F.lit(False))).drop("_gone").select(*docs.columns)
