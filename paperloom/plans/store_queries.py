"""Queries over the field store, the document register, jobs, limits and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import eav, jobs, retrieval
from ..sources import rendered as R
from .registry import query


@query(R.with_ctes(R.EAV_SQL, query=r"SELECT job_id, field_name, array_to_string(list_transform(regexp_extract_all(field_name, '[^.\[\]]+|\[\d+\]'), lambda p: regexp_replace(p, '[\[\]]', '', 'g')), '/') AS parts, regexp_extract(field_name, '^([^.\[]*)', 1) AS category FROM eav_fields"))
def path_parts(spark, sf_dir):
    return R.eav_fields(spark, sf_dir).select("job_id", "field_name", F.array_join(eav.path_parts(F.col("field_name")), "/").alias("parts"), eav.category(F.col("field_name")).alias("category"))


@query(R.with_ctes(R.EAV_SQL, query="SELECT job_id, field_name, CASE field_name WHEN 'personal_info.name' THEN 'Full Name' WHEN 'personal_info.active' THEN 'Personal Info > Active' WHEN 'items[0].total' THEN 'Items[0] > Total' WHEN 'items[1].quantity' THEN 'Items[1] > Quantity' WHEN 'items[1].note' THEN 'Items[1] > Note' ELSE 'Skills > Node > Js' END AS label FROM eav_fields"))
def field_label(spark, sf_dir):
    return R.eav_fields(spark, sf_dir).select("job_id", "field_name", eav.label(F.col("field_name")).alias("label"))


EXPORT = ("e AS (SELECT job_id, field_name, data_type, CASE WHEN is_validated AND normalized_value IS NOT NULL THEN normalized_value ELSE raw_value END AS v FROM eav_fields)")


@query(R.with_ctes(R.EAV_SQL, EXPORT, query="SELECT job_id, field_name, CASE data_type WHEN 'string' THEN CAST(to_json(v) AS VARCHAR) WHEN 'boolean' THEN CASE WHEN lower(trim(v)) IN ('true', '1', 'yes') THEN 'true' ELSE 'false' END WHEN 'integer' THEN coalesce(CAST(TRY_CAST(v AS BIGINT) AS VARCHAR), CAST(to_json(v) AS VARCHAR)) "
                   "WHEN 'number' THEN CAST(TRY_CAST(v AS DOUBLE) AS VARCHAR) ELSE CAST(to_json(v) AS VARCHAR) END AS value FROM e WHERE v IS NOT NULL AND v <> ''"))
def coerce_typed(spark, sf_dir):
    return eav.export_values(R.eav_fields(spark, sf_dir))


@query(None)
def unflatten_export(spark, sf_dir):
    return eav.export_json(R.eav_fields(spark, sf_dir))


@query(R.with_ctes(R.EAV_SQL, query="SELECT job_id, round(avg(confidence), 9) AS confidence, count(*) AS n_fields FROM eav_fields GROUP BY job_id"))
def job_mean_confidence(spark, sf_dir):
    return eav.mean_confidence(R.eav_fields(spark, sf_dir)).withColumn("confidence", F.round("confidence", 9))


@query(R.with_ctes(R.EAV_SQL, "c AS (SELECT c_custkey AS job_id, 'items[0].total' AS field_name, 'new ' || c_nationkey AS nv FROM customer WHERE c_custkey % 3 = 1)",
                   query="SELECT f.job_id, f.field_name, coalesce(c.nv, f.normalized_value) AS normalized_value, f.is_validated OR c.nv IS NOT NULL AS is_validated, coalesce(CASE WHEN c.nv IS NOT NULL THEN false END, f.is_skipped) AS is_skipped FROM eav_fields f LEFT JOIN c ON f.job_id = c.job_id AND f.field_name = c.field_name"))
def field_corrections(spark, sf_dir):
    c = R.table(spark, sf_dir, "customer").filter("c_custkey % 3 = 1")
    base = [F.col("c_custkey").alias("job_id"), F.lit("items[0].total").alias("field_name")]
    old = c.select(*base, F.lit("old").alias("normalized_value"), F.lit(True).alias("is_skipped"), F.lit(1).alias("ts"))
    new = c.select(*base, F.concat(F.lit("new "), F.col("c_nationkey").cast("string")).alias("normalized_value"), F.lit(False).alias("is_skipped"), F.lit(2).alias("ts"))
    return eav.corrected(R.eav_fields(spark, sf_dir), old.unionByName(new)).select("job_id", "field_name", "normalized_value", "is_validated", "is_skipped")


@query(R.with_ctes(R.META_SQL, "live AS (SELECT * FROM doc_meta WHERE NOT is_deleted)", query="SELECT CAST(count(*) AS BIGINT) AS total_documents, coalesce(round(100.0::DOUBLE * count(*) FILTER (WHERE confidence_score >= 0.5) / count(confidence_score), 2), 0.0) AS success_rate, count(*) FILTER (WHERE confidence_score < 0.5) AS low_confidence, "
                   "(SELECT doc_type FROM live GROUP BY doc_type ORDER BY count(*) DESC, doc_type LIMIT 1) AS top_doc_type FROM live"))
def dashboard_stats(spark, sf_dir):
    return jobs.dashboard(R.doc_meta(spark, sf_dir))


@query(R.with_ctes(R.META_SQL, query="SELECT doc_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY uploaded_at, doc_id) AS INT) AS doc_number FROM doc_meta"))
def doc_number(spark, sf_dir):
    return jobs.numbered(R.doc_meta(spark, sf_dir))


@query(R.with_ctes(R.META_SQL, query="SELECT doc_id, doc_type FROM doc_meta WHERE NOT is_deleted AND user_id = 7"))
def documents_owned(spark, sf_dir):
    return jobs.owned(R.doc_meta(spark, sf_dir), 7).select("doc_id", "doc_type")


@query(R.with_ctes(R.META_SQL, query="SELECT doc_id, user_id, doc_type FROM doc_meta WHERE NOT is_deleted"))
def documents_live(spark, sf_dir):
    return jobs.live(R.doc_meta(spark, sf_dir)).select("doc_id", "user_id", "doc_type")


@query(R.with_ctes(R.META_SQL, query="SELECT doc_id, CASE WHEN is_deleted THEN 404 WHEN user_id <> 7 THEN 403 ELSE 200 END AS code FROM doc_meta"))
def access_codes(spark, sf_dir):
    return jobs.access(R.doc_meta(spark, sf_dir), 7)


@query(R.with_ctes(R.META_SQL, query="SELECT doc_id, is_deleted OR doc_id % 17 = 0 AS is_deleted FROM doc_meta"))
def soft_delete(spark, sf_dir):
    docs = R.doc_meta(spark, sf_dir)
    return jobs.soft_deleted(docs, docs.filter("doc_id % 17 = 0")).select("doc_id", "is_deleted")


@query(R.with_ctes(R.JOB_SQL, "l AS (SELECT job_id, arg_max(status, ts) AS status FROM job_events GROUP BY job_id)", query="SELECT job_id, status, CASE status WHEN 'ocr_running' THEN 25 WHEN 'ai_running' THEN 75 WHEN 'done' THEN 100 ELSE 0 END AS progress FROM l"))
def job_status(spark, sf_dir):
    return jobs.latest_status(R.job_events(spark, sf_dir))


@query(R.with_ctes(R.JOB_SQL, "l AS (SELECT job_id, arg_max(status, ts) AS status FROM job_events GROUP BY job_id)", query="SELECT o_orderkey AS doc_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.job_id = o_orderkey AND status IN ('queued', 'ocr_running', 'ai_running'))"))
def active_job_anti(spark, sf_dir):
    docs = R.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return jobs.startable(docs, jobs.latest_status(R.job_events(spark, sf_dir)).withColumnRenamed("job_id", "doc_id"))


@query(R.with_ctes(R.JOB_SQL, "c AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS was FROM job_events)", query="SELECT job_id, event_id, status FROM c WHERE status IS DISTINCT FROM was"))
def status_change_feed(spark, sf_dir):
    return jobs.status_changes(R.job_events(spark, sf_dir)).drop("ts")


def _rate_events(spark, sf_dir):
    return R.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", "ts")


RATE = """WITH RECURSIVE o AS (SELECT user_id AS key, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT key, event_id, t, k, t AS open, 1 AS n FROM o WHERE k = 1 UNION ALL SELECT o.key, o.event_id, o.t, o.k, CASE WHEN o.t >= f.open + 86400000000 THEN o.t ELSE f.open END, CASE WHEN o.t >= f.open + 86400000000 THEN 1 ELSE f.n + 1 END FROM f JOIN o ON o.key = f.key AND o.k = f.k + 1)
SELECT key, event_id, open AS window_start, CAST(n AS INT) AS n, n <= 3 AS allowed FROM f"""


@query(RATE)
def rate_window(spark, sf_dir):
    return jobs.rate_limited(_rate_events(spark, sf_dir), limit=3, seconds=86_400)


LOCK = """WITH RECURSIVE o AS (SELECT user_id AS key, event_id, epoch_us(ts) AS t, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('purchase', 'error', 'click')),
f AS (SELECT key, event_id, t, k, CASE WHEN ok THEN 0 ELSE 1 END AS n, -1::BIGINT AS until_, CASE WHEN ok THEN 'ok' ELSE 'failed' END AS state FROM o WHERE k = 1 UNION ALL
 SELECT o.key, o.event_id, o.t, o.k, CASE WHEN o.t < f.until_ THEN f.n WHEN o.ok THEN 0 ELSE f.n + 1 END, CASE WHEN o.t >= f.until_ AND NOT o.ok AND f.n + 1 >= 5 THEN o.t + 172800000000 ELSE f.until_ END,
 CASE WHEN o.t < f.until_ THEN 'refused' WHEN o.ok THEN 'ok' WHEN f.n + 1 >= 5 THEN 'locked' ELSE 'failed' END FROM f JOIN o ON o.key = f.key AND o.k = f.k + 1)
SELECT key, event_id, state FROM f"""


@query(LOCK)
def lockout(spark, sf_dir):
    e = R.table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "error", "click"))
    return jobs.lockouts(e.select(F.col("user_id").alias("key"), "event_id", "ts", (F.col("event_type") == "purchase").alias("ok")), minutes=2880)


TOPK = """WITH e AS (SELECT vec_id, embedding::DOUBLE[64] AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(array_cosine_similarity(q.v, e.v), 9) AS score FROM q, e WHERE q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
"""


@query(TOPK + 'SELECT query_id, id, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5')
def cosine_topk(spark, sf_dir):
    v = R.table(spark, sf_dir, "embeddings")
    return retrieval.top_k(v, v.filter("vec_id % 20 = 0"), k=5).select("query_id", "id", "rank")


@query(TOPK + 'SELECT query_id, id, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3 AND score >= 0.25')
def retrieval_threshold(spark, sf_dir):
    v = R.table(spark, sf_dir, "embeddings")
    return retrieval.top_k(v, v.filter("vec_id % 20 = 0"), k=3, least=0.25).select("query_id", "id", "rank")
