import json

import pytest
from pyspark.sql import functions as F

from paperloom.operators import classify, eav, exports, fields, grounding, jobs, layout, quality, retrieval
from paperloom.sources import files, providers

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("flat, want", [
    ([("personal_info.name", "A"), ("personal_info.contact.email", "e")], {"personal_info": {"name": "A", "contact": {"email": "e"}}}),
    ([("education.formation[0].name", "x"), ("education.formation[1].name", "y")], {"education": {"formation": [{"name": "x"}, {"name": "y"}]}}),
    ([("items[2]", "c"), ("items[0]", "a")], {"items": ["a", "c"]}),
    ([("a", ""), ("b", None), ("c", False), ("d", 0)], {"c": False, "d": 0}),
    ([("a", "text"), ("a.b", 1)], {"a": "text"}),
    ([("skills.node.js", True)], {"skills": {"node": {"js": True}}}), ([], {})])
def test_nested(flat, want):
    assert eav.nested(flat) == want


def test_prune_looks_before_it_goes_in():
    assert eav.prune({"a": {"b": {}, "c": 1}}) == {"a": {"c": 1}}
    assert eav.prune({"a": [None, "", [], {}, {"k": 1}]}) == {"a": [{"k": 1}]}
    assert eav.prune({"a": {"b": {}}}) == {"a": {}}


@pytest.mark.parametrize("text, kind, want", [("True", "boolean", True), ("1", "boolean", True), ("0", "boolean", False), ("no idea", "boolean", False), ("42", "integer", 42), ("12.50", "number", 12.5), ("[1, 2]", "array", [1, 2]), ('{"a": 1}', "object", {"a": 1}),
                                              ("not a number", "integer", "not a number"), (None, "string", None), ("x", None, "x"), ("7", None, 7), ("7", "string", "7")])
def test_coerce(text, kind, want):
    got = eav.coerce(text, kind)
    assert got == want and type(got) is type(want)


def test_flatten_and_export(spark):
    docs = spark.createDataFrame([(1, json.dumps({"b": {"c": [1, {"d": True}]}, "a": 1.5, "e": [], "n": None})), (2, "no json"), (3, None)], "doc_id long, json string")
    got = [tuple(r) for r in eav.flatten_json(docs).orderBy("doc_id", "pos").collect()]
    assert got == [(1, 0, "b.c[0]", "1", "integer"), (1, 1, "b.c[1].d", "True", "boolean"), (1, 2, "a", "1.5", "number"), (1, 3, "n", None, "string")]
    rows = [(1, "a.b", "x", "fixed", "string", 0.5, True, False), (1, "a.c[0]", "3", None, "integer", None, False, True), (2, "z", "", None, "string", None, False, False)]
    f = spark.createDataFrame(rows, "job_id long, field_name string, raw_value string, normalized_value string, data_type string, confidence double, is_validated boolean, is_skipped boolean")
    assert {r.job_id: json.loads(r.exported_data) for r in eav.export_json(f).collect()} == {1: {"a": {"b": "fixed", "c": [3]}}, 2: {}}
    assert {r.job_id: r.confidence for r in eav.mean_confidence(f).collect()} == {1: 0.5, 2: None}
    assert eav.export_json(f.limit(0)).count() == 0


@pytest.mark.parametrize("value, source, want", [("INV-123", "Invoice INV-123 Total: 100.00 USD", True), ("INV-999", "Invoice INV-123", False), ("Tech Solutions Inc", "Tech Solutions Incorporated", True), ("JOHN DOE", "john doe was here", True),
                                                 ("فاتورة", "anything", True), ("ab", "zzz", True), (None, "x", True), ("Long Company Namex", "the long company name is", True)])
def test_grounding(spark, value, source, want):
    df = spark.createDataFrame([(value, source)], "v string, s string")
    assert df.select(grounding.is_grounded(F.col("v"), F.col("s")).alias("r")).first().r is want


def test_document_types(spark):
    docs = spark.createDataFrame([(1, "Invoice total vat"), (2, "nothing to see"), (3, None), (4, "Curriculum vitae: experience, skills"), (5, "The medicine")], DOCS)
    got = {r.doc_id: r for r in classify.document_type(docs).collect()}
    assert [got[i].doc_type for i in (1, 2, 3, 4, 5)] == ["invoice", "unknown", "unknown", "cv", "id_card"]
    assert got[2].confidence == 0.0 and got[5].confidence == 1.0
    assert {r.doc_id: r.doc_type for r in classify.document_type(docs, floor=1.01).collect()}[1] == "unknown"


def test_languages(spark):
    docs = spark.createDataFrame([(1, "La facture été payée"), (2, "invoice total"), (3, "فاتورة"), (4, ""), (5, "发票"), (6, None)], DOCS)
    got = {r.doc_id: (r.language, r.direction) for r in classify.language(docs).collect()}
    assert got == {1: ("fr", "ltr"), 2: ("en", "ltr"), 3: ("ar", "rtl"), 4: ("unknown", "ltr"), 5: ("zh", "ltr"), 6: ("unknown", "ltr")}


BOX = "doc_id long, page int, line_idx int, text string, x1 int, y1 int, x2 int, y2 int, confidence double"


def boxes(spark, rows):
    return spark.createDataFrame([(1, 1, i, *r) for i, r in enumerate(rows)], BOX)


def test_table_rows_follow_the_first_line(spark):
    got = layout.table_rows(boxes(spark, [("a", 0, y - 5, 10, y + 5, 1.0) for y in (10, 25, 40)])).orderBy("line_idx").collect()
    assert [r.row for r in got] == [0, 0, 1]


def test_duplicates_keep_the_better_in_place(spark):
    rows = [("short", 0, 0, 100, 20, 0.8), ("better", 1, 1, 101, 21, 0.9), ("other", 0, 200, 100, 220, 0.9), ("othre!", 0, 201, 100, 221, 0.9)]
    got = {r.text for r in layout.drop_duplicates(boxes(spark, rows)).collect()}
    assert got == {"better", "othre!"}


def test_blocks_break_at_gaps_sections_and_edges(spark):
    rows = [("one", 0, 0, 100, 10, 1.0), ("two", 0, 12, 100, 22, 1.0), ("Skills", 0, 24, 100, 34, 1.0), ("far", 0, 100, 100, 110, 1.0), ("aside", 300, 120, 400, 130, 1.0), ("- bullet", 0, 140, 100, 150, 1.0)]
    got = layout.blocks(boxes(spark, rows)).orderBy("line_idx").collect()
    assert [r.block for r in got] == [0, 0, 1, 2, 3, 3]


def test_columns(spark):
    left = [(f"skills email {i}", 0, 30 * i, 150, 30 * i + 20, 1.0) for i in range(5)]
    right = [(f"text {i}", 400, 30 * i, 990, 30 * i + 20, 1.0) for i in range(5)]
    got = layout.columns(boxes(spark, left + right)).orderBy("line_idx").collect()
    assert [(r.column_id, r.role) for r in got] == [(0, "sidebar")] * 5 + [(1, "main")] * 5
    assert {r.role for r in layout.columns(boxes(spark, left)).collect()} == {"main"}


def test_table_grid(spark):
    rows = [("H1", 0, 0, 50, 20, 1.0), ("H2", 100, 0, 150, 20, 1.0), ("a", 2, 40, 52, 60, 1.0), ("b", 101, 41, 149, 61, 1.0)]
    got = {(r.row, r.col): r.cell for r in layout.table_grid(boxes(spark, rows)).collect()}
    assert got == {(0, 0): "H1", (0, 2): "H2", (1, 0): "a", (1, 2): "b"}


def test_top_k(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(999, None), (1000, [0.0] * 8)], "vec_id long, embedding array<double>")
    got = retrieval.top_k(df, df.filter("vec_id < 20"), k=4).orderBy("query_id", "rank").collect()
    unit = np.vstack([vectors / np.linalg.norm(vectors, axis=1, keepdims=True), np.zeros((1, 8))])
    ids = [*range(300), 1000]
    for q in range(20):
        s = np.round(unit @ unit[q], 9)
        s[q] = -9
        want = [ids[i] for i in sorted(range(301), key=lambda i: (-s[i], ids[i]))[:4]]
        assert [r.id for r in got if r.query_id == q] == want
    assert retrieval.top_k(df, df.limit(0)).count() == 0


def test_lockout_and_rate(spark):
    e = spark.createDataFrame([(1, i, i == 7, 1_700_000_000 + 30 * i) for i in range(12)], "key long, event_id long, ok boolean, t long").select("key", "event_id", "ok", F.timestamp_seconds("t").alias("ts"))
    got = [r.state for r in jobs.lockouts(e, failures=3, minutes=1).orderBy("event_id").collect()]
    # a lock leaves the count as it is, so the next failure locks again; a success that comes while locked is refused
    assert got == ["failed", "failed", "locked", "refused", "locked", "refused", "locked", "refused", "locked", "refused", "locked", "refused"]
    reset = [r.state for r in jobs.lockouts(e.withColumn("ok", F.col("event_id") == 4), failures=3, minutes=1).orderBy("event_id").collect()]
    assert reset == ["failed", "failed", "locked", "refused", "ok", "failed", "failed", "locked", "refused", "locked", "refused", "locked"]
    rate = [(r.n, r.allowed) for r in jobs.rate_limited(e, limit=2, seconds=90).orderBy("event_id").collect()]
    assert rate == [(1, True), (2, True), (3, False)] * 4


def test_uploads(spark):
    rows = [("pdf", b"%PDF-1.7"), ("pdf", b"not it"), ("png", b"\x89PNG\r\n\x1a\n.."), ("exe", b"MZ"), ("jpg", b""), ("svg", b"<svg/>"), (None, b"x"), ("pdf", b"%PDF" + b"x" * 50)]
    df = spark.createDataFrame([(i, e, bytearray(c)) for i, (e, c) in enumerate(rows)], "i int, ext string, content binary")
    got = [r.reject_reason for r in files.validated(df, most_bytes=40).orderBy("i").collect()]
    assert got == [None, "content", None, "extension", "empty", None, "extension", "size"]


def test_field_store_replaces_jobs(spark, tmp_path):
    schema = "job_id long, field_name string, raw_value string"
    a = spark.createDataFrame([(1, "x", "old"), (1, "y", "old"), (2, "x", "two")], schema)
    b = spark.createDataFrame([(1, "x", "new"), (3, "x", "three")], schema)
    path = str(tmp_path / "fields")
    for part in (a, b, b):
        files.write_fields(part, path)
    got = {(r.job_id, r.field_name, r.raw_value) for r in spark.read.parquet(path).collect()}
    assert got == {(1, "x", "new"), (2, "x", "two"), (3, "x", "three")}


def test_providers(spark):
    df = spark.createDataFrame([(1, bytearray(b"a line\n\nb")), (2, bytearray(b"\xff\xfe"))], "doc_id long, content binary")
    got = providers.apply(df, providers.TextLines, providers.LINE_SCHEMA).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == [(1, "a line"), (1, "b"), (2, "")] and [r.error[:12] for r in got if r.doc_id == 2] == ["UnicodeDecod"]
    svg = b'<svg xmlns="http://www.w3.org/2000/svg"><g transform="translate(10,20) scale(2)"><text x="5" y="10" font-size="8">Hi you</text></g></svg>'
    line = providers.apply(spark.createDataFrame([(3, bytearray(svg))], "doc_id long, content binary"), providers.SvgText, providers.LINE_SCHEMA).first()
    assert (line.text, line.x1, line.y2) == ("Hi you", 20, 40)
    text = spark.createDataFrame([(1, "same words"), (2, "words same"), (3, None)], DOCS)
    e = {r.doc_id: r.embedding for r in providers.apply(text, providers.HashEmbeddings, providers.HashEmbeddings.schema).collect()}
    assert e[1] == e[2] and set(e[3]) == {0.0}


def test_ocr_report(spark):
    got = quality.ocr_report(boxes(spark, [("sure", 0, 0, 1, 1, 0.9), ("maybe", 0, 1, 1, 2, 0.8), ("no", 0, 2, 1, 3, 0.5)])).first()
    assert (got.n_lines, got.n_uncertain, got.mean_confidence, got.verified_text) == (3, 1, 0.7333, "sure")


def test_exports_take_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x: 1")], DOCS)
    for build in (exports.cv, exports.invoice, exports.generic):
        assert exports.as_json(build(docs)).count() == 3
    assert {r.doc_id: r.total for r in fields.invoice_totals(docs).collect()} == {1: None, 2: None, 3: None}
