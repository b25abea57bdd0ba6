"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, fingerprints, language_id, line_dedup, quality, sentencepiece_fst, simhash, substring_dedup, toxicity, warc

#: Where the public tokenizers are on the driver; executors get the model's bytes.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
PIECE_MODEL = "piece_bpe_32k.model"


def piece_model(folder: str = TOKENIZERS) -> bytes:
    return Path(folder, PIECE_MODEL).read_bytes()


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return (sentencepiece_fst.encode(docs, piece_model())
            .select("doc_id", F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"), "piece_ids", "round_trip"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup_substrings(docs).select("doc_id", "text", "n_sentences_dropped")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = language_id.train(docs)
    return language_id.identify(docs, model).select("doc_id", common.in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score", "probabilities")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "equal_tokens", "overlap_tokens", "first_token")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return (line_dedup.dedup_lines(docs)
            .select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.fingerprint_edits(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprints.written(F.col("fingerprint")).alias("fingerprint"),
                        fingerprints.written(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next", "contained_edited")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    return (quality.score_documents(docs, model)
            .select("doc_id", common.in_fold(F.col("doc_id"), 3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(common.table(spark, sf_dir, "pages"), path)
    # payloads are verified where they are read; what is kept of a record is narrow, so archives are read once
    found = warc.resolve(common.cut(warc.read(spark, path, payload=False).drop("payload")))
    return found.select(F.col("row_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to", "problem")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return (toxicity.score_documents(docs, model)
            .select("doc_id", common.in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_substring_dedup, op3_language_id, op4_decontamination, op5_line_dedup,
                                    op6_fingerprints, op7_quality, op8_simhash, op9_warc, op10_toxicity)}


OP5_SQL = """
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), often AS (
  SELECT key, min(doc_id) AS keeper FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT l.doc_id, l.pos, l.line, (o.key IS NOT NULL AND l.doc_id <> o.keeper) AS gone FROM lines l LEFT JOIN often o ON l.key = o.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP9_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to,
       CAST(NULL AS VARCHAR) AS problem
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": OP5_SQL, "op9_warc": OP9_SQL}
