"""Documents rendered from the star-schema tables: invoices, curricula, boxes, fields, jobs.

Every function takes (spark, sf_dir) and returns a DataFrame; ``SQL`` holds the
same tables as SQL over the same Parquet files, for checking one with the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c) -> F.Column:
    return c.cast("decimal(15,2)").cast("string")


def invoice_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): one invoice an order.  One shuffle: items are gathered by order, an order's few items at a time.

    Orders are dealt by their key as that join deals them: where Spark broadcasts the items, a file of few orders would be one task's.
    """
    item = F.struct("l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), F.col("l_extendedprice").cast("decimal(15,2)").alias("p"))
    items = (table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
             .agg(F.array_sort(F.collect_list(item)).alias("items"), F.sum(F.col("l_extendedprice").cast("decimal(15,2)")).alias("sub")))
    o = table(spark, sf_dir, "orders").repartition("o_orderkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rows = F.array_join(F.transform(F.coalesce("items", F.array().cast(items.schema["items"].dataType)), lambda i: F.concat(
        F.lit("\nPart "), i["l_partkey"].cast("string"), F.lit(" | "), i["q"].cast("string"), F.lit(" | "), i["p"].cast("string"))), "")
    text = F.concat(
        F.lit("INVOICE\nInvoice: INV-"), F.col("o_orderkey").cast("string"), F.lit("\nDate: "), F.date_format("o_orderdate", "dd/MM/yyyy"),
        F.lit("\nVendor:\nAcme Trading Ltd\nBill To:\n"), F.when(F.col("o_orderkey") % 3 == 0, "sales@acme.example.com\n").otherwise(""),
        F.lit("Client "), F.col("o_custkey").cast("string"), F.lit("\nE-mail: client"), F.col("o_custkey").cast("string"), F.lit("@example.com\nTel: +33 12 34 45 "),
        F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"), F.lit(" 78\nwww.client"), F.col("o_custkey").cast("string"), F.lit(".example.com\n12 rue de Paris\nDescription | Qty | Total"),
        rows, F.lit("\nSubtotal: "), F.coalesce(F.col("sub"), F.lit(0)).cast("decimal(15,2)").cast("string"), F.lit(" EUR\nTVA: 20.00\nTotal: "), money(F.col("o_totalprice")),
        F.lit("\nTerms: 30 days\nTerms: net\nPayment by transfer\n1234 5678 9012 "), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"))
    return o.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


INVOICE_SQL = r"""
items AS (
  SELECT l_orderkey, string_agg(chr(10) || 'Part ' || l_partkey || ' | ' || CAST(l_quantity AS INT) || ' | ' || CAST(l_extendedprice AS DECIMAL(15,2)), ''
           ORDER BY l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS INT), CAST(l_extendedprice AS DECIMAL(15,2))) AS rows_,
         sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS sub
  FROM lineitem GROUP BY l_orderkey
), invoice_docs AS (
  SELECT o_orderkey AS doc_id,
    'INVOICE' || chr(10) || 'Invoice: INV-' || o_orderkey || chr(10) || 'Date: ' || strftime(o_orderdate, '%d/%m/%Y') || chr(10) || 'Vendor:' || chr(10) || 'Acme Trading Ltd' || chr(10) || 'Bill To:' || chr(10)
    || CASE WHEN o_orderkey % 3 = 0 THEN 'sales@acme.example.com' || chr(10) ELSE '' END || 'Client ' || o_custkey || chr(10) || 'E-mail: client' || o_custkey || '@example.com' || chr(10) || 'Tel: +33 12 34 45 '
    || lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0') || ' 78' || chr(10) || 'www.client' || o_custkey || '.example.com' || chr(10) || '12 rue de Paris' || chr(10) || 'Description | Qty | Total'
    || coalesce(rows_, '') || chr(10) || 'Subtotal: ' || CAST(coalesce(sub, 0) AS DECIMAL(15,2)) || ' EUR' || chr(10) || 'TVA: 20.00' || chr(10) || 'Total: ' || CAST(o_totalprice AS DECIMAL(15,2))
    || chr(10) || 'Terms: 30 days' || chr(10) || 'Terms: net' || chr(10) || 'Payment by transfer' || chr(10) || '1234 5678 9012 ' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS text
  FROM orders LEFT JOIN items ON o_orderkey = l_orderkey
)"""

# the parts that curricula are put together from, picked by the customer's key
FIRST = ("Jean", "Marie", "Ana", "Peter")
LAST = ("Dupont", "Martin", "Silva", "Novak", "Weber")
ROLES = ("Data Engineer", "Software Developer", "Project Manager")
SCHOOLS = ("University of Lyon", "Technical School")
SKILLS = ("Python, SQL; Java", "Spark | Scala", "python  Excel, EXCEL")


def cv_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): one curriculum a customer.

    Their keys are dealt to all cores: a file of so narrow a table is read by one or a few tasks.
    """
    k = F.col("c_custkey")

    def pick(values: tuple[str, ...], by) -> F.Column:
        return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))

    year = (F.lit(2000) + k % 15).cast("string")
    text = F.concat(
        pick(FIRST, k), F.lit(" "), pick(LAST, k), F.lit("\nmail: c"), k.cast("string"), F.lit("@example.org\n+33 6 12 34 56 "), F.lpad((k % 100).cast("string"), 2, "0"),
        F.lit("\nPROFILE\nWorks with care\nExperience\nAcme "), (k % 50).cast("string"), F.lit("\n"), pick(ROLES, k), F.lit("\nParis, France\n"), year, F.lit(" - "), (F.lit(2016) + k % 8).cast("string"),
        F.lit("\nOther Corp\nConsultant\nSomewhere\n- Built reports for clients\n- short one\nMore long duties done here\nmars 2001 to mai 2003\nEducation\nMaster of Science\n"), pick(SCHOOLS, k), F.lit("\n"), year,
        F.lit("\nSkills\n"), pick(SKILLS, k), F.lit("\nLanguages\nFrench: native\nEnglish - fluent\nGerman basic\nCertifications\nCloud Expert - Big Vendor\nScrum Master, Org\nProjects\nPipeline\nMoves data daily\nHobbies\nchess; running\nProjects\nSecond"))
    keys = table(spark, sf_dir, "customer").select("c_custkey").repartition(max(16, 4 * spark.sparkContext.defaultParallelism), "c_custkey")
    return keys.select(k.alias("doc_id"), text.alias("text"))


def _sql_pick(values: tuple[str, ...], by: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[{by} % {len(values)} + 1]"


CV_SQL = (r"""
cv_docs AS (
  SELECT c_custkey AS doc_id, """ + _sql_pick(FIRST, "c_custkey") + " || ' ' || " + _sql_pick(LAST, "c_custkey") + r""" || replace('|mail: c', '|', chr(10)) || c_custkey || replace('@example.org~+33 6 12 34 56 ', '~', chr(10)) || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0')
    || replace('~PROFILE~Works with care~Experience~Acme ', '~', chr(10)) || (c_custkey % 50) || chr(10) || """ + _sql_pick(ROLES, "c_custkey") + r""" || replace('~Paris, France~', '~', chr(10)) || (2000 + c_custkey % 15) || ' - ' || (2016 + c_custkey % 8)
    || replace('~Other Corp~Consultant~Somewhere~- Built reports for clients~- short one~More long duties done here~mars 2001 to mai 2003~Education~Master of Science~', '~', chr(10)) || """ + _sql_pick(SCHOOLS, "c_custkey") + r""" || chr(10) || (2000 + c_custkey % 15)
    || replace('~Skills~', '~', chr(10)) || """ + _sql_pick(SKILLS, "c_custkey") + r""" || replace('~Languages~French: native~English - fluent~German basic~Certifications~Cloud Expert - Big Vendor~Scrum Master, Org~Projects~Pipeline~Moves data daily~Hobbies~chess; running~Projects~Second', '~', chr(10)) AS text
  FROM customer
)""")


def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, line_idx, text, x1, y1, x2, y2, confidence): a line box for each row of lineitem."""
    li = table(spark, sf_dir, "lineitem")
    part, line, qty = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_quantity").cast("int")
    cents = F.col("l_extendedprice").cast("decimal(15,2)")
    x1 = F.when(part % 2 == 0, 40 + part % 20).otherwise(520 + part % 30).cast("int")
    y1 = (60 + line * 40 + part % 25).cast("int")
    idx = F.struct("l_partkey", "l_suppkey", "l_linenumber", qty.alias("q"), cents.alias("p"))
    rows = li.select(F.col("l_orderkey").alias("doc_id"), F.struct(idx.alias("i"), F.concat(F.lit("Part "), part.cast("string"), F.lit(" qty "), qty.cast("string")).alias("text"), x1.alias("x1"), y1.alias("y1"),
                                                                  (x1 + 120 + qty * 4).cast("int").alias("x2"), (y1 + 18 + part % 9).cast("int").alias("y2"), (F.lit(0.5) + (part % 50) / F.lit(100.0)).alias("confidence")).alias("l"))
    packed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    return packed.select("doc_id", F.lit(1).alias("page"), F.posexplode("ls").alias("line_idx", "l")).select("doc_id", "page", "line_idx", "l.text", "l.x1", "l.y1", "l.x2", "l.y2", "l.confidence")


BOX_SQL = """
line_boxes AS (
  SELECT l_orderkey AS doc_id, 1 AS page,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS INT), CAST(l_extendedprice AS DECIMAL(15,2))) - 1 AS INT) AS line_idx,
    'Part ' || l_partkey || ' qty ' || CAST(l_quantity AS INT) AS text,
    CAST(CASE WHEN l_partkey % 2 = 0 THEN 40 + l_partkey % 20 ELSE 520 + l_partkey % 30 END AS INT) AS x1,
    CAST(60 + l_linenumber * 40 + l_partkey % 25 AS INT) AS y1,
    CAST(CASE WHEN l_partkey % 2 = 0 THEN 40 + l_partkey % 20 ELSE 520 + l_partkey % 30 END + 120 + CAST(l_quantity AS INT) * 4 AS INT) AS x2,
    CAST(60 + l_linenumber * 40 + l_partkey % 25 + 18 + l_partkey % 9 AS INT) AS y2,
    0.5 + (l_partkey % 50) / 100.0::DOUBLE AS confidence
  FROM lineitem
)"""


def layout_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, region_idx, region_type, x1, y1, x2, y2): three fixed regions an order, the last two overlap."""
    regions = F.array(*[F.struct(F.lit(i).alias("region_idx"), F.lit(t).alias("region_type"), F.lit(a).alias("x1"), F.lit(b).alias("y1"), F.lit(c).alias("x2"), F.lit(d).alias("y2"))
                        for i, t, a, b, c, d in REGIONS])
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.inline(regions))


REGIONS = ((0, "title", 0, 0, 1000, 120), (1, "text", 0, 110, 480, 600), (2, "table", 300, 200, 900, 400))
REGION_SQL = "layout_regions AS (SELECT o_orderkey AS doc_id, r.* FROM orders, (VALUES " + ", ".join(repr(r) for r in REGIONS) + ") r(region_idx, region_type, x1, y1, x2, y2))"


def eav_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, field_name, raw_value, normalized_value, data_type, confidence, is_validated, is_skipped): six fields a customer."""
    k = F.col("c_custkey")
    conf = F.when(k % 7 == 0, None).otherwise((k % 100) / F.lit(100.0))

    def row(name, raw, kind, fixed=F.lit(None).cast("string"), valid=F.lit(False)):
        return F.struct(F.lit(name).alias("field_name"), raw.alias("raw_value"), fixed.alias("normalized_value"), F.lit(kind).cast("string").alias("data_type"), conf.alias("confidence"),
                        valid.alias("is_validated"), (k % 5 == 0).alias("is_skipped"))

    rows = F.array(row("personal_info.name", F.col("c_name"), "string", F.upper("c_name"), k % 2 == 0), row("personal_info.active", F.when(k % 3 == 0, "True").otherwise("0"), "boolean"),
                   row("items[0].total", F.col("c_acctbal").cast("decimal(15,2)").cast("string"), "number"), row("items[1].quantity", (k % 9).cast("string"), "integer"),
                   row("items[1].note", F.when(k % 4 == 0, "").otherwise("n/a"), "integer"), row("skills.node.js", F.lit("True"), None))
    return table(spark, sf_dir, "customer").select(k.alias("job_id"), F.inline(rows))


EAV_SQL = """
eav_fields AS (
  SELECT c_custkey AS job_id, f.field_name, CASE f.field_name WHEN 'personal_info.name' THEN c_name WHEN 'personal_info.active' THEN CASE WHEN c_custkey % 3 = 0 THEN 'True' ELSE '0' END
      WHEN 'items[0].total' THEN CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS VARCHAR) WHEN 'items[1].quantity' THEN CAST(c_custkey % 9 AS VARCHAR)
      WHEN 'items[1].note' THEN CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'n/a' END ELSE 'True' END AS raw_value,
    CASE WHEN f.field_name = 'personal_info.name' THEN upper(c_name) END AS normalized_value, f.data_type,
    CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE (c_custkey % 100) / 100.0::DOUBLE END AS confidence,
    f.field_name = 'personal_info.name' AND c_custkey % 2 = 0 AS is_validated, c_custkey % 5 = 0 AS is_skipped
  FROM customer, (VALUES ('personal_info.name', 'string'), ('personal_info.active', 'boolean'), ('items[0].total', 'number'), ('items[1].quantity', 'integer'), ('items[1].note', 'integer'), ('skills.node.js', NULL)) f(field_name, data_type)
)"""


def doc_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, user_id, doc_type, confidence_score, is_deleted, uploaded_at): the document register, one row an order."""
    k = F.col("o_orderkey")
    kinds = F.element_at(F.array(*[F.lit(x) for x in DOC_TYPES]), (k % len(DOC_TYPES) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.col("o_custkey").alias("user_id"), kinds.alias("doc_type"), F.when(k % 11 == 0, None).otherwise((k * 7 % 100) / F.lit(100.0)).alias("confidence_score"),
                                                 (k % 13 == 0).alias("is_deleted"), F.col("o_orderdate").alias("uploaded_at"))


DOC_TYPES = ("invoice", "cv", "invoice", "contract", "unknown")
META_SQL = ("doc_meta AS (SELECT o_orderkey AS doc_id, o_custkey AS user_id, " + _sql_pick(DOC_TYPES, "o_orderkey") +
            " AS doc_type, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey * 7 % 100) / 100.0::DOUBLE END AS confidence_score, o_orderkey % 13 = 0 AS is_deleted, o_orderdate AS uploaded_at FROM orders)")


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, job_id, status, ts): the status stream of jobs, one job a user."""
    names = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("job_id"), names[F.col("event_type")].alias("status"), "ts")


STATUS = {"view": "queued", "click": "ocr_running", "signup": "ai_running", "purchase": "done", "error": "failed"}
JOB_SQL = "job_events AS (SELECT event_id, user_id AS job_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " END AS status, ts FROM events)"


def with_ctes(*ctes: str, query: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + query
