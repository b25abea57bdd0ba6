"""What batches make of ASCII texts, held against the expressions that other texts go through."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions import documents as D
from paperloom.functions import plain as A
from paperloom.functions import text as X
from paperloom.operators import classify, fields

PIECES = ("Invoice: INV-7", "ref. A/12-b", "n° 55", "a.b+c@d-e.org", "A@B.co x@y", "+33 12 34 45 67 78", "(12) 34-56 78", "www.Site.org/a?b", "HTTP://www.x.net,", "01/02/2003", "mars 2001 to mai 2003", "March 1999", "2004",
          "Total: 1,234.50 EUR", "sous total 5..6", "TVA: $ 20.", "3.4.5,6", "|", " | ", "\t", "  ", ":", " : ", "Key_x :  y z ", "Description | Qty | Unit Price | Total", "Part 1 | 2 | | 3.5 | 9", "| |", "\r\n", "\n", "\n", "\x0b", "\x1c", "\x1f", "amount due", "e-mail: Q@w.org", "a", "A", "e", "E", "7")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PIECES) + rng.choice(("", " ", "\n")) for _ in range(rng.randint(0, 25))).replace("°", rng.choice("°o")) for _ in range(600)]
    return spark.createDataFrame([*enumerate(texts), (9001, None), (9002, ""), (9003, "é: 5\né | 6\nnaïve 2001\nÀ@b.org x@y.org")], "doc_id long, text string").cache()


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("made, other", [
    (fields.dates, lambda ls: F.transform(X.date_ranges(ls), lambda v: F.struct(v.alias("value")))), (fields.invoice_items, lambda ls: fields.table_items(fields.pipe_table(ls))),
    (fields.numbers, lambda ls: F.transform(D.pairs(ls), lambda p: F.struct(p["pos"].alias("at"), X.number(p["value"]).alias("number"))))])
def test_batches_equal_the_expressions(docs, made, other):
    want = X.exploded(docs, other(X.nonempty_lines(F.col("text"))), "pos", "r", "doc_id").select("doc_id", "pos", "r.*")
    want = want.select("doc_id", F.col("at").alias("pos"), "number") if "at" in want.columns else want
    got = made(docs)
    assert rows(got) == rows(want.select(got.columns)) and got.count() > 100
    assert "ArrowEvalPython" in got._jdf.queryExecution().toString()


def test_points_equal_the_expression(docs):
    marked = docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\né")).alias("text"))  # a letter that no other rule sees, in a line too short to count
    assert rows(fields.important_points(docs.filter("doc_id < 9000"))) == rows(fields.important_points(marked.filter("doc_id < 9000")))


def test_document_candidates_equal_those_of_line_rows(docs):
    line = lambda x, i: F.struct((i % 2).alias("page"), i.cast("int").alias("pos"), x.alias("line"), F.when(i % 5 == 4, 0.6).otherwise(0.90004).alias("confidence"), F.when(F.contains(x, F.lit("|")), "table_section").alias("block_type"))
    packed = docs.select("doc_id", F.transform(X.nonempty_lines(F.col("text")), line).alias("ls"))
    got, want = fields.document_candidates(packed), fields.candidates(packed.select("doc_id", F.inline("ls")))
    assert sorted(got.columns) == sorted(want.columns) and rows(got.select(want.columns)) == rows(want) and got.count() > 1000
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_keywords_are_found_in_texts_of_any_script(spark):
    texts = ["Invoice TOTAL", "فاتورة المبلغ الإجمالي", "", None, "EXPÉRIENCE compétences", "loi tribunal contract"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [[sum(k.lower() in (t or "").lower() for k in ks) for ks in classify.P.TYPE_KEYWORDS.values()] for t in texts]
    got = classify.type_scores(docs).orderBy("doc_id", "type_order").collect()
    assert [[r.hits for r in got if r.doc_id == i] for i in range(len(texts))] == want
    assert "ArrowEvalPython" in classify.type_scores(docs)._jdf.queryExecution().toString()
    assert [(r.doc_type, r.pos, r.keyword) for r in classify.evidence(docs).filter("doc_id = 5").collect()] == [
        (t, n, k) for t, ks in classify.P.TYPE_KEYWORDS.items() for n, k in enumerate([k for k in ks if k.lower() in texts[5]][:8])]


def test_nothing_but_ascii_goes_to_a_batch(spark):
    text = spark.createDataFrame([("a",), ("é",), (None,)], "t string")
    assert [r[0] for r in text.select(A.of_text(F.col("t"), "string", lambda t: "batch", lambda t: F.lit("other"))).collect()] == ["batch", "other", "batch"]


def test_lines_that_differ_in_digits_alone_are_searched_once(monkeypatch):
    searched, whole = [], A.line_candidates
    monkeypatch.setattr(A, "line_candidates", lambda x, table: searched.append(x) or whole(x, table))
    A._of_shape.cache_clear()
    lines = [f"Part {k} | {k % 7} | {k}.5{k % 10}" for k in range(1000, 1900)] + [f"Key {k}: a{k}@b.org" for k in range(10, 30)]
    row = ("\0".join(lines), " ".join(["1"] * 920), " ".join(map(str, range(920))), " ".join(["0.90005"] * 920), "1" * 900 + "0" * 20, None)
    columns, ends = A.candidates([row, row])
    got = list(zip(*(c.to_pylist() for c in columns)))
    assert ends[1] * 2 == ends[2] and got[:ends[1]] == got[ends[1]:]
    assert len([x for x in searched if x.startswith("Part")]) == 1  # what is in a field's name is the line's own
    assert (1, "amount", 0, "1000.50", "amount", "ocr_pattern", 0.9001, "1000.50") in got and (1, "table_amount", 899, "1899", "amount", "ocr_table", 0.9001, "1899") in got
    assert {r[1] for r in got if r[5] == "ocr_key_value"} == {f"key_{k}" for k in range(10, 30)}


def test_invoices_are_dealt_to_more_tasks_than_files(spark, tmp_path):
    from paperloom.sources import rendered as R

    spark.range(400_000).selectExpr("xxhash64(id) o_orderkey", "xxhash64(-id) o_custkey", "1.5D o_totalprice", "date'2001-02-03' o_orderdate").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(10).selectExpr("id l_orderkey", "id l_partkey", "id l_suppkey", "1 l_linenumber", "2D l_quantity", "3D l_extendedprice").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    dealt = R.invoice_docs(spark, str(tmp_path)).select(F.spark_partition_id().alias("p"), F.length("text").alias("n")).groupBy("p").agg(F.sum("n")).count()
    assert dealt > 1
