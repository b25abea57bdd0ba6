"""Queries over files, providers and recognition measures, on bytes made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality
from ..sources import files, providers
from ..sources import rendered as R
from .registry import query

UPLOADS_SQL = """
uploads AS (
  SELECT o_orderkey AS doc_id, (['pdf', 'png', 'exe', 'jpg', 'svg', NULL])[o_orderkey % 6 + 1] AS ext,
    CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN '%PDF-' || repeat('x', o_orderkey % 50) WHEN 2 THEN 'MZ' ELSE '%PDF' END AS content
  FROM orders
)"""


def uploads(spark, sf_dir):
    k = F.col("o_orderkey")
    ext = F.element_at(F.array(F.lit("pdf"), F.lit("png"), F.lit("exe"), F.lit("jpg"), F.lit("svg"), F.lit(None)), (k % 6 + 1).cast("int"))
    content = F.when(k % 7 == 0, "").when(k % 7 == 1, F.concat(F.lit("%PDF-"), F.repeat(F.lit("x"), (k % 50).cast("int")))).when(k % 7 == 2, "MZ").otherwise("%PDF")
    return R.table(spark, sf_dir, "orders").select(k.alias("doc_id"), ext.alias("ext"), content.cast("binary").alias("content"))


@query(R.with_ctes(UPLOADS_SQL, query="SELECT doc_id, CASE WHEN ext IS NULL OR ext NOT IN ('pdf', 'png', 'jpg', 'jpeg', 'svg') THEN 'extension' WHEN content = '' THEN 'empty' WHEN NOT ((ext = 'pdf' AND starts_with(content, '%PDF')) OR ext = 'svg') THEN 'content' WHEN length(content) > 30 THEN 'size' END AS reject_reason FROM uploads"))
def upload_validation(spark, sf_dir):
    return files.validated(uploads(spark, sf_dir), most_bytes=30).select("doc_id", "reject_reason")


@query(R.with_ctes(UPLOADS_SQL, query="SELECT doc_id, CASE WHEN ext = 'pdf' THEN 'native' ELSE 'image' END AS path FROM uploads"))
def upload_routing(spark, sf_dir):
    native, image = files.route(uploads(spark, sf_dir))
    return native.select("doc_id", F.lit("native").alias("path")).unionByName(image.select("doc_id", F.lit("image").alias("path")))


@query("SELECT o_orderkey AS doc_id, least(w, h) >= 80 AND greatest(w, h) <= 6000 AND w * h <= 25000000 AS ok FROM (SELECT o_orderkey, o_orderkey * 7 % 7000 AS w, o_orderkey * 13 % 6500 AS h FROM orders)")
def image_limits(spark, sf_dir):
    k = F.col("o_orderkey")
    return R.table(spark, sf_dir, "orders").select(k.alias("doc_id"), files.within_limits((k * 7 % 7000).cast("int"), (k * 13 % 6500).cast("int")).alias("ok"))


@query(r"SELECT doc_id, length(regexp_replace(text, '\s+', '', 'g')) < 24 AS needs_ocr FROM documents")
def page_needs_ocr(spark, sf_dir):
    return R.table(spark, sf_dir, "documents").select("doc_id", files.needs_ocr(F.col("text")).alias("needs_ocr"))


@query("SELECT p_partkey AS doc_id, CAST(0 AS INT) AS line_idx, p_name AS text, 40 AS x1, 40 + 9 * length(p_name) AS x2 FROM part UNION ALL SELECT p_partkey, 1, p_type, 40, 40 + 9 * length(p_type) FROM part")
def provider_text_lines(spark, sf_dir):
    rows = R.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat("p_name", F.lit("\n\n"), "p_type").cast("binary").alias("content"))
    return providers.apply(rows, providers.TextLines, providers.LINE_SCHEMA).select("doc_id", "line_idx", "text", "x1", "x2")


@query(None)
def provider_embeddings(spark, sf_dir):
    rows = R.table(spark, sf_dir, "documents").select("doc_id", "text")
    return providers.apply(rows, providers.HashEmbeddings, providers.HashEmbeddings.schema).select("doc_id", F.array_join(F.transform("embedding", lambda x: F.round(x, 6).cast("string")), ",").alias("embedding"))


MEASURES = "m AS (SELECT l_orderkey AS doc_id, l_linenumber AS candidate, l_quantity * 5 AS brightness, l_discount * 700 AS contrast, l_tax * 3000 AS sharpness, l_discount AS foreground FROM lineitem)"
SCORE = ("greatest(0.0, 0.32::DOUBLE * least(1.0, contrast / 70.0::DOUBLE) + 0.30::DOUBLE * least(1.0, sharpness / 450.0::DOUBLE) + 0.23::DOUBLE * (1 - least(1.0, abs(brightness - 172.0::DOUBLE) / 172.0::DOUBLE)) "
         "+ 0.15::DOUBLE * (1 - least(1.0, abs(foreground - 0.18::DOUBLE) / 0.35::DOUBLE)))")


def _measures(spark, sf_dir):
    li = R.table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("candidate"), (F.col("l_quantity") * 5).alias("brightness"), (F.col("l_discount") * 700).alias("contrast"),
                     (F.col("l_tax") * 3000).alias("sharpness"), F.col("l_discount").alias("foreground"))


@query(R.with_ctes(MEASURES, f"s AS (SELECT doc_id, candidate, round({SCORE}, 9) AS score FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, candidate) AS k FROM s)", query="SELECT doc_id, candidate, score FROM r WHERE k = 1"))
def best_image_candidate(spark, sf_dir):
    c = F.col
    scored = _measures(spark, sf_dir).withColumn("score", F.round(quality.image_score(c("contrast"), c("sharpness"), c("brightness"), c("foreground")), 9))
    return quality.best_of(scored)


@query(R.with_ctes(MEASURES, query="SELECT doc_id, candidate, brightness, array_to_string(list_filter([CASE WHEN brightness < 85 THEN 'dark' END, CASE WHEN brightness > 210 THEN 'bright' END, CASE WHEN contrast < 38 THEN 'low_contrast' END, CASE WHEN sharpness < 90 THEN 'blurred' END], lambda x: x IS NOT NULL), ',') AS flags FROM m"))
def image_flags(spark, sf_dir):
    m = _measures(spark, sf_dir)
    return m.select("doc_id", "candidate", "brightness", F.array_join(quality.flags(m), ",").alias("flags"))


@query(R.with_ctes(R.BOX_SQL, query="SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE confidence < 0.75) AS n_uncertain, coalesce(string_agg(text, chr(10) ORDER BY line_idx) FILTER (WHERE confidence >= 0.85), '') AS verified_text FROM line_boxes GROUP BY doc_id"))
def ocr_report(spark, sf_dir):
    return quality.ocr_report(R.line_boxes(spark, sf_dir)).drop("mean_confidence")


@query(R.with_ctes(R.BOX_SQL, query="SELECT doc_id, CASE WHEN count(*) < 2 THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END AS consensus, count(*) < 4 OR sum(length(text)) < 40 OR round(avg(confidence), 6) < 0.60 AS fallback FROM line_boxes GROUP BY doc_id"))
def ocr_consensus_fallback(spark, sf_dir):
    lines = R.line_boxes(spark, sf_dir)
    own = lines.groupBy("doc_id").agg(quality.needs_fallback(F.count("*"), F.sum(F.char_length("text")), F.round(F.avg("confidence"), 6)).alias("fallback"))
    return quality.consensus(lines).join(own, "doc_id").select("doc_id", "consensus", "fallback")
