"""Queries over summaries, entities, single fields, scripts, accounts and field-store snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounts, eav, summary
from ..sources import rendered as R
from .registry import query
from .text_queries import lines_sql


def _structured(spark, sf_dir):
    k = F.col("c_custkey")
    j = (F.when(k % 4 == 0, F.to_json(F.struct(F.col("c_name").alias("name"), F.lit("a@b.cd").alias("email"), F.array(F.lit("x"), F.lit("y")).alias("skills"))))
         .when(k % 4 == 1, F.concat(F.lit('{"person": {"name": "'), "c_name", F.lit('"}, "contact": {"phone": "12", "location": "Lyon"}, "skills": "one"}'))).when(k % 4 == 2, F.concat(F.lit('{"full_name": "", "customer": "'), "c_name", F.lit('"}'))).otherwise("not json"))
    return R.table(spark, sf_dir, "customer").select(k.alias("doc_id"), j.alias("json"))


@query("SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 4 < 3 THEN c_name END AS person_name, CASE WHEN c_custkey % 4 = 0 THEN 'a@b.cd' END AS email, CASE WHEN c_custkey % 4 = 1 THEN '12' END AS phone, CASE WHEN c_custkey % 4 = 1 THEN 'Lyon' END AS address, "
       "CASE c_custkey % 4 WHEN 0 THEN 'x;y' WHEN 1 THEN 'one' ELSE '' END AS skills FROM customer")
def key_entities(spark, sf_dir):
    e = _structured(spark, sf_dir).select("doc_id", summary.key_entities(F.col("json")).alias("e"))
    return e.select("doc_id", "e.person_name", "e.contact.email", "e.contact.phone", "e.contact.address", F.array_join("e.skills", ";").alias("skills"))


@query(R.with_ctes(R.META_SQL, query="SELECT doc_id, CASE doc_type WHEN 'cv' THEN 'Job application curriculum vitae' WHEN 'invoice' THEN 'Payment or billing document' WHEN 'contract' THEN 'Agreement terms document' END AS purpose FROM doc_meta"))
def purposes(spark, sf_dir):
    return R.doc_meta(spark, sf_dir).select("doc_id", summary.purpose(F.col("doc_type")).alias("purpose"))


ENTITIES = '{"person_name":"x","contact":{},"experience":[],"education":[],"skills":[],"languages_spoken":[]}'


@query(R.with_ctes(R.INVOICE_SQL, lines_sql("invoice_docs"), query=f"""
SELECT doc_id, 'invoice' AS document_type, 'Payment or billing document' AS purpose, left(string_agg(line, ' ' ORDER BY pos) FILTER (WHERE pos < 3), 700) AS summary,
  '{ENTITIES}' AS key_entities, 0.5::DOUBLE AS confidence
FROM lines GROUP BY doc_id"""))
def document_summary(spark, sf_dir):
    docs = R.invoice_docs(spark, sf_dir).select("doc_id", F.lit("invoice").alias("doc_type"), "text", F.lit('{"name": "x"}').alias("json"), F.lit(0.5).alias("confidence"))
    s = summary.build(docs)
    return s.select("doc_id", "document_type", "purpose", "summary", F.to_json("key_entities").alias("key_entities"), "confidence")


HITS = "h AS (SELECT l_orderkey AS query_id, l_partkey AS id, l_discount * 10 AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS rank FROM lineitem)"


@query(R.with_ctes(HITS, "g AS (SELECT * FROM h WHERE rank <= 3 AND score >= 0.25 AND id % 3 <> 0)", query="SELECT query_id, 'total' AS field, id || '.50 EUR' AS value, id AS region FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) = 1"))
def retrieved_field(spark, sf_dir):
    from pyspark.sql.window import Window as W

    li = R.table(spark, sf_dir, "lineitem")
    w = W.partitionBy("l_orderkey").orderBy(F.desc("l_discount"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    part = F.col("l_partkey")
    hits = li.select(F.col("l_orderkey").alias("query_id"), part.alias("id"), (F.col("l_discount") * 10).alias("score"), F.row_number().over(w).alias("rank"), F.when(part % 3 == 0, "nothing").otherwise(F.concat(F.lit("due: "), part.cast("string"), F.lit(".50 EUR"))).alias("text"))
    return summary.retrieved_field(hits, "total")


@query("WITH a AS (SELECT o_orderkey AS doc_id, 'latin' AS script, (o_orderkey % 10) / 10.0::DOUBLE AS a FROM orders), b AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'latin' ELSE 'cjk' END AS script, 0.6::DOUBLE AS b FROM orders) "
       "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.script, b.script) AS script, round(0.7::DOUBLE * coalesce(a, 0) + (1 - 0.7::DOUBLE) * coalesce(b, 0), 9) AS score FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.script = b.script WHERE 0.7::DOUBLE * coalesce(a, 0) + (1 - 0.7::DOUBLE) * coalesce(b, 0) >= 0.15")
def script_merge(spark, sf_dir):
    o, k = R.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    a = o.select(k.alias("doc_id"), F.lit("latin").alias("script"), ((k % 10) / F.lit(10.0)).alias("share"))
    b = o.select(k.alias("doc_id"), F.when(k % 2 == 0, "latin").otherwise("cjk").alias("script"), F.lit(0.6).alias("share"))
    return summary.merged_scripts(a, b).withColumn("score", F.round("score", 9))


@query("SELECT c_custkey AS doc_id, CASE c_custkey % 3 WHEN 0 THEN 'ar,en,fr' WHEN 1 THEN 'ch' ELSE 'fr,en' END AS langs FROM customer")
def recognition_languages(spark, sf_dir):
    k = F.col("c_custkey")
    scripts = F.when(k % 3 == 0, F.array(F.lit("arabic"), F.lit("latin"), F.lit("arabic"))).when(k % 3 == 1, F.array(F.lit("cjk"))).otherwise(F.array(F.lit("other")))
    return R.table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.array_join(summary.recognition_languages(scripts), ",").alias("langs"))


USERS = "users AS (SELECT c_custkey AS user_id, 'u' || (c_custkey % 400) || '@x.org' AS email, c_name AS full_name, c_custkey % 3 = 0 AS account_enabled, c_custkey % 7 = 0 AS is_deleted FROM customer)"


def _users(spark, sf_dir):
    k = F.col("c_custkey")
    return R.table(spark, sf_dir, "customer").select(k.alias("user_id"), F.concat(F.lit("u"), (k % 400).cast("string"), F.lit("@x.org")).alias("email"), F.col("c_name").alias("full_name"), (k % 3 == 0).alias("account_enabled"), (k % 7 == 0).alias("is_deleted"))


@query(R.with_ctes(USERS, query="SELECT user_id, email FROM users WHERE NOT account_enabled AND NOT is_deleted"))
def users_pending(spark, sf_dir):
    return accounts.pending(_users(spark, sf_dir)).select("user_id", "email")


@query(R.with_ctes(USERS, query="SELECT user_id, full_name FROM users WHERE NOT is_deleted"))
def users_current(spark, sf_dir):
    return accounts.current(_users(spark, sf_dir)).select("user_id", "full_name")


@query(R.with_ctes(USERS, query="SELECT user_id, email, CASE WHEN user_id % 5 = 0 THEN 'renamed' ELSE full_name END AS full_name, account_enabled, is_deleted FROM users"))
def user_partial_update(spark, sf_dir):
    users = _users(spark, sf_dir)
    return accounts.updated(users, users.filter("user_id % 5 = 0").select("user_id", F.lit(None).cast("string").alias("email"), F.lit("renamed").alias("full_name")))


@query(R.with_ctes(USERS, query="SELECT DISTINCT c.user_id, 'U7@x.org' AS email FROM (SELECT user_id FROM users WHERE user_id < 20) c JOIN users u ON u.email = 'u7@x.org' AND u.user_id <> c.user_id"))
def email_conflicts(spark, sf_dir):
    users = _users(spark, sf_dir)
    return accounts.email_conflicts(users, users.filter("user_id < 20").select("user_id", F.lit("U7@x.org").alias("email")))


@query("SELECT event_id FROM events WHERE event_type <> 'error' AND ts > TIMESTAMP '2024-01-10 00:00:00'")
def usable_tokens(spark, sf_dir):
    t = R.table(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "error").alias("is_used"), F.col("ts").alias("expires_at"))
    return accounts.usable(t, F.expr("timestamp_ntz'2024-01-10 00:00:00'")).select("event_id")


@query("SELECT event_id, event_type = 'error' OR user_id < 3 AS is_used FROM events")
def revoked_tokens(spark, sf_dir):
    t = R.table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_type") == "error").alias("is_used"))
    return accounts.revoked(t, t.filter("user_id < 3")).select("event_id", "is_used")


@query(R.with_ctes(USERS, query="SELECT 't' || user_id AS token, user_id, email FROM users WHERE user_id % 9 = 0"))
def token_owner(spark, sf_dir):
    users = _users(spark, sf_dir)
    token = F.concat(F.lit("t"), F.col("user_id").cast("string"))
    tokens = users.select("user_id", F.sha2(token, 256).alias("token_hash"))
    return accounts.token_owner(tokens, users, users.filter("user_id % 9 = 0").select(token.alias("token")))


@query(R.with_ctes(R.EAV_SQL, query="SELECT job_id AS doc_id, count(*) FILTER (WHERE raw_value IS NOT NULL AND raw_value <> '') AS n FROM eav_fields GROUP BY job_id"))
def filled_leaves(spark, sf_dir):
    f = R.eav_fields(spark, sf_dir).select(F.col("job_id").alias("doc_id"), F.col("field_name").alias("path"), F.col("raw_value").alias("value"))
    return summary.filled_leaves(f)


@query("SELECT p_partkey AS doc_id, sha256(p_name) AS key FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_partkey < 10) QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1".replace("p_partkey AS doc_id, sha256(p_name) AS key", "sha256(p_name) AS key, p_name AS text"))
def embedding_cache_misses(spark, sf_dir):
    p = R.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))
    cache = p.filter("doc_id < 10").select(F.sha2("text", 256).alias("key"), F.lit(0).alias("embedding")).dropDuplicates(["key"])
    return summary.cached(p, cache)[1]


@query(R.with_ctes(R.EAV_SQL, query="SELECT job_id, CASE WHEN avg(confidence) IS NULL THEN 0.4::DOUBLE ELSE round(avg(confidence), 9) END AS confidence FROM eav_fields GROUP BY job_id"))
def document_confidence(spark, sf_dir):
    m = eav.mean_confidence(R.eav_fields(spark, sf_dir))
    return m.select("job_id", F.coalesce(F.round("confidence", 9), F.lit(0.4)).alias("confidence"))
