"""Queries over typed blocks and provider payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import payloads, schema
from ..sources import rendered as R
from .registry import query
from .text_queries import PAIRS, RANGE, lines_sql, section_sql


def _cv(spark, sf_dir, *parts):
    return schema.cv_of_texts(R.cv_docs(spark, sf_dir), parts or None)


@query(R.with_ctes(R.CV_SQL, lines_sql("cv_docs"), query="SELECT doc_id, max(CASE WHEN pos = 0 THEN line END) AS name, max(CASE WHEN pos = 0 THEN line END) IS NULL AS no_headline, max(CASE WHEN pos = 1 THEN regexp_extract(line, '[A-Za-z0-9]+@.*') END) AS email, max(CASE WHEN pos = 2 THEN line END) AS phone, 'Works with care' AS summary FROM lines GROUP BY doc_id"))
def schema_cv_person(spark, sf_dir):
    d = _cv(spark, sf_dir, "person", "contact", "summary")
    return d.select("doc_id", F.col("data.person.name").alias("name"), F.col("data.person.headline").isNotNull().alias("no_headline"), F.col("data.contact.email").alias("email"), F.col("data.contact.phone").alias("phone"), F.col("data.summary").alias("summary"))


@query(R.with_ctes(R.CV_SQL, query="SELECT doc_id, 0 AS pos, 'Acme ' || (doc_id % 50) AS title, (['Data Engineer', 'Software Developer', 'Project Manager'])[doc_id % 3 + 1] AS organization, (2000 + doc_id % 15) || ' - ' || (2016 + doc_id % 8) AS date_range, 'Paris, France' AS description, '' AS bullets FROM cv_docs "
                   "UNION ALL SELECT doc_id, 1, 'Other Corp', 'Consultant', NULL, 'Somewhere', 'Built reports for clients;short one' FROM cv_docs UNION ALL SELECT doc_id, 2, 'More long duties done here', NULL, NULL, NULL, NULL FROM cv_docs WHERE false").replace("'Somewhere', 'Built reports for clients;short one'", "'Somewhere;More long duties done here;mars 2001 to mai 2003', 'Built reports for clients;short one'"))
def schema_cv_entries(spark, sf_dir):
    rows = X.exploded(_cv(spark, sf_dir, "experience"), F.col("data.experience"), "pos", "e", "doc_id")
    return rows.select("doc_id", "pos", "e.title", "e.organization", "e.date_range", F.array_join("e.description", ";").alias("description"), F.array_join("e.bullets", ";").alias("bullets"))


@query("WITH " + section_sql("Education", "Skills") + f"""
SELECT doc_id, 0 AS pos, max(CASE WHEN pos = 0 THEN line END) AS title, max(CASE WHEN pos = 1 THEN line END) AS organization,
  max(nullif(regexp_extract(line, {RANGE}, 0, 'i'), '')) AS date_range
FROM part GROUP BY doc_id""")
def schema_cv_education(spark, sf_dir):
    rows = X.exploded(_cv(spark, sf_dir, "education"), F.col("data.education"), "pos", "e", "doc_id")
    return rows.select("doc_id", "pos", "e.title", "e.organization", "e.date_range")


def _invoice(spark, sf_dir, *parts):
    return schema.invoice_of_texts(R.invoice_docs(spark, sf_dir), parts)


@query(R.with_ctes(R.INVOICE_SQL, PAIRS, "f AS (SELECT doc_id, key, arg_min(value, pos) AS value FROM kv GROUP BY doc_id, key)", query="SELECT doc_id, max(CASE WHEN key = 'invoice' THEN value END) AS invoice_number, max(CASE WHEN key = 'date' THEN value END) AS issue_date, 'Acme Trading Ltd' AS seller, "
                   "max(CASE WHEN key = 'subtotal' THEN value END) AS subtotal, max(CASE WHEN key = 'total' THEN value END) AS total, '30 days' AS terms FROM f GROUP BY doc_id"))
def schema_invoice(spark, sf_dir):
    return _invoice(spark, sf_dir, "invoice_number", "issue_date", "seller", "totals", "payment").select("doc_id", "data.invoice_number", "data.issue_date", F.col("data.seller.name").alias("seller"), "data.totals.subtotal", "data.totals.total", "data.payment.terms")


@query(R.with_ctes(R.INVOICE_SQL, lines_sql("invoice_docs"), "b AS (SELECT doc_id, min(pos) AS p FROM lines WHERE line LIKE '%Bill To%' GROUP BY doc_id)", query="SELECT l.doc_id, string_agg(line, ';' ORDER BY pos) AS buyer_lines FROM lines l JOIN b ON l.doc_id = b.doc_id AND pos BETWEEN p + 1 AND p + 6 GROUP BY l.doc_id"))
def schema_party_lines(spark, sf_dir):
    return _invoice(spark, sf_dir, "buyer").select("doc_id", F.array_join("data.buyer.raw_lines", ";").alias("buyer_lines"))


@query(None)
def schema_legal(spark, sf_dir):
    d = schema.legal(schema.text_blocks(R.table(spark, sf_dir, "documents").select("doc_id", "text")))
    return d.select("doc_id", F.to_json("data").alias("json"))


@query(None)
def schema_generic(spark, sf_dir):
    d = schema.generic(schema.text_blocks(R.table(spark, sf_dir, "documents").select("doc_id", "text")))
    return d.select("doc_id", F.to_json("data").alias("json"))


def _payloads(spark, sf_dir):
    """Recognition answers of both shapes, one an order."""
    k = F.col("o_orderkey").cast("string")
    modern = F.concat(F.lit('{"rec_texts": ["Order '), k, F.lit('", " ", "Total"], "rec_scores": [0.9, 0.8], "rec_boxes": [[1, 2, 30, 12], [0, 0, 1, 1], [5, 20, 40, 31]]}'))
    legacy = F.concat(F.lit('[[[[1, 2], [30, 2], [30, 12], [1, 12]], ["Order '), k, F.lit('", 0.9]], [[[5, 20], [40, 20], [40, 31], [5, 31]], ["Total", 0]]]'))
    return R.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 2 == 0, modern).otherwise(legacy).alias("payload"))


@query("SELECT o_orderkey AS doc_id, 0 AS n, 'Order ' || o_orderkey AS text, 0.9::DOUBLE AS confidence, 1.0::DOUBLE AS x1, 12.0::DOUBLE AS y2 FROM orders UNION ALL SELECT o_orderkey, 1, 'Total', 0.0::DOUBLE, 5.0::DOUBLE, 31.0::DOUBLE FROM orders")
def ocr_payload_lines(spark, sf_dir):
    return payloads.lines(_payloads(spark, sf_dir)).select("doc_id", F.col("line_idx").alias("n"), "text", "confidence", "x1", "y2")


@query("SELECT o_orderkey AS doc_id, 0 AS region_idx, 'table_section' AS region_type, 0.85::DOUBLE AS confidence, 1.0::DOUBLE AS x1, 2.0::DOUBLE AS y1, (10 + o_orderkey % 7)::DOUBLE AS x2, 9.0::DOUBLE AS y2 FROM orders")
def layout_payload_regions(spark, sf_dir):
    p = F.concat(F.lit('{"boxes": [{"label": " Table", "score": 85, "coordinate": [1, 2, '), (10 + F.col("o_orderkey") % 7).cast("string"), F.lit(', 9]}, {"label": "text", "score": 1, "coordinate": [1]}]}'))
    return payloads.regions(R.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), p.alias("payload")))


@query("SELECT event_id AS doc_id, CASE WHEN event_id % 3 = 0 THEN props WHEN event_id % 3 = 1 THEN props END AS answer FROM events")
def model_answers(spark, sf_dir):
    fenced = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.concat(F.lit("Sure: "), "props"))
    return R.table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), payloads.answer(fenced).alias("answer"))


@query("SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN '{\"total\":\"5\"}' ELSE '{\"line_items\": \"text\"}' END AS data, CASE WHEN c_custkey % 2 = 1 THEN 'does not fit the schema' END AS warning FROM customer")
def schema_validation(spark, sf_dir):
    j = F.when(F.col("c_custkey") % 2 == 0, '{"total": "5", "extra": 1}').otherwise('{"line_items": "text"}')
    return payloads.checked(R.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), j.alias("json")), payloads.INVOICE)


VIEW = """s AS (SELECT *, max(x2) OVER (PARTITION BY doc_id) AS w, max(y2) OVER (PARTITION BY doc_id) AS h FROM line_boxes
), d AS (
  SELECT doc_id, x1, y1, x2, y2, text, format('<div title="{}" style="left:{:.2f}%;top:{:.2f}%;width:{:.2f}%;height:{:.2f}%"></div>',
    text, x1 * 100.0::DOUBLE / w, y1 * 100.0::DOUBLE / h, (x2 - x1) * 100.0::DOUBLE / w, (y2 - y1) * 100.0::DOUBLE / h) AS box FROM s
)"""


@query(R.with_ctes(R.BOX_SQL, VIEW, query="""SELECT doc_id, '<!doctype html><div class="page">' || string_agg(box, '' ORDER BY y1, x1, x2, y2, text) || '</div>' AS html FROM d GROUP BY doc_id"""))
def layout_viewer(spark, sf_dir):
    return payloads.viewer_html(R.line_boxes(spark, sf_dir))


@query(R.with_ctes(R.BOX_SQL, query="SELECT doc_id, '{\"status\":\"success\",\"doc_type\":\"invoice\",\"lines\":' || count(*) || '}' AS report FROM line_boxes GROUP BY doc_id"))
def run_report(spark, sf_dir):
    lines = R.line_boxes(spark, sf_dir)
    r = payloads.report(lines, lines.select("doc_id", F.lit("invoice").alias("doc_type")).distinct())
    return r.select("doc_id", F.regexp_replace("report", ',"confidence":[0-9.]+', "").alias("report"))
