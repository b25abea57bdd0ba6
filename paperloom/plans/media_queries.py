"""Queries over drawings, text PDFs, raw images and table shapes, on bytes made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import images
from ..operators import layout as L
from ..sources import pdf, vector
from ..sources import rendered as R
from .registry import query

# --- images: each embedding is one of 8 x 8 pixels ---

IMAGES = """
p AS (
  SELECT vec_id AS image_id, i - 1 AS i, (i - 1) // 8 AS r, (i - 1) % 8 AS c,
    CAST(least(255, greatest(0, floor(128 + 300 * CAST(embedding[i] AS DOUBLE)))) AS INT) AS v
  FROM embeddings, range(1, 65) t(i)
), l AS (
  SELECT a.image_id, a.i, u.v + d.v + le.v + ri.v - 4 * a.v AS lap
  FROM p a
  JOIN p u ON u.image_id = a.image_id AND u.c = a.c AND u.r = abs(a.r - 1)
  JOIN p d ON d.image_id = a.image_id AND d.c = a.c AND d.r = 7 - abs(7 - (a.r + 1))
  JOIN p le ON le.image_id = a.image_id AND le.r = a.r AND le.c = abs(a.c - 1)
  JOIN p ri ON ri.image_id = a.image_id AND ri.r = a.r AND ri.c = 7 - abs(7 - (a.c + 1))
), m AS (
  SELECT image_id, avg(v) AS brightness, stddev_pop(v) AS contrast, avg(CASE WHEN v < 210 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ink,
    (avg(CASE WHEN v < 35 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE r < 2) + avg(CASE WHEN v < 35 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE r > 5)
     + avg(CASE WHEN v < 35 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE c < 2) + avg(CASE WHEN v < 35 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE c > 5)) / 4 AS border
  FROM p GROUP BY image_id
), s AS (SELECT image_id, var_pop(lap) AS blur FROM l GROUP BY image_id)
"""


def raw_images(spark, sf_dir):
    cell = lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + 300 * x.cast("double")))).cast("int")
    hexed = F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(cell(x)), 2, "0")), "")
    return R.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), F.unhex(hexed).alias("pixels"))


@query(f"""WITH {IMAGES}
SELECT image_id, round(brightness, 6) AS brightness, round(contrast, 6) AS contrast, round(blur + 1e-7::DOUBLE, 3) AS blur_score, round(border, 6) AS border_score,
  round(0.32::DOUBLE * least(1.0::DOUBLE, contrast / 70) + 0.30::DOUBLE * least(1.0::DOUBLE, blur / 450) + 0.23::DOUBLE * (1 - least(1.0::DOUBLE, abs(brightness - 172) / 172))
    + 0.15::DOUBLE * (1 - least(1.0::DOUBLE, abs(ink - 0.18::DOUBLE) / 0.35::DOUBLE)), 6) AS score
FROM m JOIN s USING (image_id)""")
def image_measures(spark, sf_dir):
    found = images.profile(raw_images(spark, sf_dir))
    # a variance of 64 whole numbers may lie just between two rounded values
    return found.select("image_id", *(F.round(c, 6).alias(c) for c in ("brightness", "contrast", "border_score", "score")), F.round(F.col("blur_score") + 1e-7, 3).alias("blur_score"))


@query()
def image_decisions(spark, sf_dir):
    found = images.flagged(raw_images(spark, sf_dir))
    return found.select("image_id", F.array_join("flags", ",").alias("flags"), *(c for c in found.columns if c.startswith("needs_")))


# --- text PDFs: a page for each fifth of a customer's key, a line each ---

def pdf_files(spark, sf_dir):
    k, name = F.col("c_custkey"), F.col("c_name")
    n = (k % 4 + 1).cast("int")
    kids = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat((10 * i).cast("string"), F.lit(" 0 R"))), " ")

    def page(i):
        at = (10 * i).cast("string")
        content = F.concat(F.lit("BT /F1 12 Tf 72 700 Td ("), name, F.lit(") Tj 0 -20 Td [(page) -300 ("), i.cast("string"), F.lit(")] TJ ET"))
        return F.concat(at, F.lit(" 0 obj << /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents "), (10 * i + 1).cast("string"), F.lit(" 0 R >> endobj\n"),
                        (10 * i + 1).cast("string"), F.lit(" 0 obj << /Length 1 >> stream\n"), content, F.lit("\nendstream endobj\n"))

    body = F.concat(F.lit("%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids ["), kids, F.lit("] >> endobj\n"), F.array_join(F.transform(F.sequence(F.lit(1), n), page), ""))
    return R.table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.when(k % 9 == 0, F.lit("no pdf")).otherwise(body).cast("binary").alias("content"))


@query("SELECT c_custkey AS doc_id, CAST(CASE WHEN c_custkey % 9 = 0 THEN 1 ELSE c_custkey % 4 + 1 END AS INT) AS n_pages FROM customer")
def pdf_pages(spark, sf_dir):
    return pdf.page_counts(pdf_files(spark, sf_dir))


@query("""SELECT c_custkey AS doc_id, CAST(p AS INT) AS page, CAST(l AS INT) AS line_idx, CASE l WHEN 0 THEN c_name ELSE 'page ' || p END AS text,
72 AS x1, CASE l WHEN 0 THEN 80 ELSE 100 END AS y1, CASE l WHEN 0 THEN 92 ELSE 112 END AS y2
FROM customer, range(1, 5) a(p), range(0, 2) b(l) WHERE c_custkey % 9 <> 0 AND p <= c_custkey % 4 + 1""")
def pdf_text_lines(spark, sf_dir):
    return pdf.lines(pdf_files(spark, sf_dir)).select("doc_id", "page", "line_idx", "text", "x1", "y1", "y2")


# --- drawings: a supplier's name and phone on one row, far apart or near, and a note below ---

def drawings(spark, sf_dir):
    k = F.col("s_suppkey")
    near = F.when(k % 2 == 0, 130).otherwise(400).cast("string")
    body = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 595 842"><style>.big { font-size: 20px; }</style><g transform="translate(10, 20)"><text class="big" x="5" y="30">'),
                    F.lit("No "), k.cast("string"), F.lit('</text><text class="big" x="'), near, F.lit('" y="32">('), F.lit('</text><text class="big" x="'), near.cast("int").cast("string"), F.lit('" y="33">'),
                    F.col("s_nationkey").cast("string"), F.lit('</text></g><text x="15" y="100" font-size="10">end</text><text x="60" y="101" font-size="10">.</text></svg>'))
    return R.table(spark, sf_dir, "supplier").select(k.alias("doc_id"), body.cast("binary").alias("content"))


@query("""WITH n AS (SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 2 = 0 THEN ['No ' || s_suppkey || ' (' || s_nationkey, 'end.'] ELSE ['No ' || s_suppkey, '(' || s_nationkey, 'end.'] END AS ls FROM supplier)
SELECT doc_id, CAST(i - 1 AS INT) AS line_idx, ls[i] AS text, 1.0::DOUBLE AS confidence, 'vector' AS language FROM n, range(1, 4) t(i) WHERE i <= len(ls)""")
def svg_text_lines(spark, sf_dir):
    return vector.svg_lines(drawings(spark, sf_dir)).select("doc_id", "line_idx", "text", "confidence", "language")


# --- tables and labels ---

@query(R.with_ctes(R.BOX_SQL, query="SELECT doc_id, page, CASE WHEN count(*) >= 2 AND avg(x2 - x1) < 400 THEN 'grid' ELSE 'spacing' END AS kind FROM (SELECT doc_id, page, x1, x1 + (x2 - x1) * 2 AS x2 FROM line_boxes) GROUP BY doc_id, page"))
def table_kinds(spark, sf_dir):
    return L.table_kind(R.line_boxes(spark, sf_dir).withColumn("x2", F.col("x1") + (F.col("x2") - F.col("x1")) * 2))


@query(R.with_ctes(R.BOX_SQL, query="SELECT doc_id, CASE WHEN bool_or(x1 < 41) THEN 'sidebar-main' WHEN count(*) >= 4 AND max((x1 + x2) / 2.0) - min((x1 + x2) / 2.0) > 420 THEN 'two-column' ELSE 'single-column' END AS layout FROM line_boxes GROUP BY doc_id"))
def layout_sidebar_label(spark, sf_dir):
    return L.sidebar_label(R.line_boxes(spark, sf_dir).withColumn("column_role", F.when(F.col("x1") < 41, "sidebar").otherwise("main")))


@query("SELECT o_custkey AS doc_id, string_agg(o_orderkey || ' | ' || o_orderstatus, chr(10) ORDER BY o_orderkey) AS preview FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 8 GROUP BY o_custkey")
def table_previews(spark, sf_dir):
    rows = R.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("r"))
    return rows.select(F.col("o_custkey").alias("doc_id"), L.table_preview(F.transform("r", lambda x: F.array(x["o_orderkey"].cast("string"), x["o_orderstatus"]))).alias("preview"))


@query("SELECT n_nationkey AS doc_id, k AS key, v AS value FROM (SELECT n_nationkey, unnest(['item', 'qty', 'col_2', 'raw']) AS k, unnest([n_name, CAST(n_regionkey AS VARCHAR), 'x', n_name || ' | ' || n_regionkey || ' | x']) AS v FROM nation)")
def keyed_items(spark, sf_dir):
    n = R.table(spark, sf_dir, "nation")
    rows = F.array(F.array(F.lit(" "), F.lit("")), F.array(F.col("n_name"), F.col("n_regionkey").cast("string"), F.lit("x")))
    return n.select(F.col("n_nationkey").alias("doc_id"), F.explode(L.keyed_rows(F.array(F.lit(" Item"), F.lit("QTY ")), rows)).alias("m")).select("doc_id", F.explode("m"))


@query(r"SELECT c_custkey AS doc_id, CASE c_custkey % 4 WHEN 0 THEN c_name || '.v2' WHEN 1 THEN '.profile' WHEN 2 THEN c_name ELSE '' END AS stem FROM customer")
def path_stems(spark, sf_dir):
    k, name = F.col("c_custkey"), F.col("c_name")
    path = F.when(k % 4 == 0, F.concat(F.lit("/a.b/c/"), name, F.lit(".v2.pdf"))).when(k % 4 == 1, F.lit("x\\.profile")).when(k % 4 == 2, F.concat(name, F.lit(".png"))).otherwise("")
    return R.table(spark, sf_dir, "customer").select(k.alias("doc_id"), X.stem(path).alias("stem"))
