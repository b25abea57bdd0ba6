from pyspark.sql import functions as F

from paperloom.operators import jobs
from paperloom.streaming import jobs as stream


def events(spark):
    rows = [(i % 7, i, ["queued", "ocr_running", "done"][(i // 9) % 3], i % 5 == 0, 1_700_000_000 + 20 * i) for i in range(300)]
    return spark.createDataFrame(rows, "key long, event_id long, status string, ok boolean, t long").select("key", F.col("key").alias("job_id"), "event_id", "status", "ok", F.timestamp_seconds("t").alias("ts"))


def streamed(spark, tmp_path, df, build, name):
    src = str(tmp_path / name)
    for k in range(3):  # three batches, in order
        df.filter(f"event_id >= {k * 100} and event_id < {(k + 1) * 100}").coalesce(1).write.mode("append").parquet(src)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = build(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def test_streams_say_what_batches_say(spark, tmp_path):
    df = events(spark)
    got = {tuple(r) for r in streamed(spark, tmp_path, df, stream.status_changes, "s_status").collect()}
    assert got == {(r.job_id, r.event_id, r.status) for r in jobs.status_changes(df).collect()}
    got = {tuple(r) for r in streamed(spark, tmp_path, df, lambda e: stream.rate_limited(e, limit=2, seconds=500), "s_rate").collect()}
    assert got == {(r.key, r.event_id, r.n, r.allowed) for r in jobs.rate_limited(df, limit=2, seconds=500).collect()}
    got = {tuple(r) for r in streamed(spark, tmp_path, df, lambda e: stream.lockouts(e, failures=3, minutes=10), "s_lock").collect()}
    assert got == {(r.key, r.event_id, r.state) for r in jobs.lockouts(df, failures=3, minutes=10).collect()}
