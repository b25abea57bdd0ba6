"""What whole documents give in batches, held against the expressions that other texts go through."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import exports, schema
from paperloom.sources import rendered as R

LINES = (
    "Jean Dupont", "JEAN ÉRIC", "mail: c1@example.org", "+33 6 12 34 56 07", "Client 1234567890", "ref 123456789", "(12) 34-56 78 x", "www.Site.org/a?b www.é.fr", "linkedin x", "Skype: jean", "Profile", "PROFIL", "Experience", "Expérience", "Work experience :",
    "Education", "FORMATION", "Études", "Skills", "Compétences", "COMPÉTENCES", "Languages", "Langues", "Certifications", "Projects", "PROJETS", "Hobbies", "Centres d'intérêt", "Contact", "Strengths", "Summary", "ÆØ ÞÐ", "ABCD", "Abc",
    "Acme 7", "Data Engineer", "Paris, France", "2001 - 2016", "mars 2001 to mai 2003", "FÉVRIER 1999 à présent", "Jan 2010 - Present", "2019", "01/02/2003", "- Built reports for clients", "* short", "1) one", "More long duties done here",
    "Master of Science", "university of lyon", "Suède", "SUÈDE", "Python, SQL; Java", "python  Excel, EXCEL | x", "French: native", "English - fluent", "German basic", ": x", "Cloud Expert - Big Vendor", "Scrum Master, Org", ", Org",
    "INVOICE", "Invoice: INV-7", "Invoice No: 8", "Date: 01/02/2003", "Due date: 3", "échéance: demain", "Vendor:", "From: me", "Acme Trading Ltd", "NAUDIN", "Bill To:", "attention: x", "à l'attention de", "12 rue de Paris", "5 Main st. x",
    "Description | Qty | Total", "Désignation | Quantité | Prix | Montant", "Part 1 | 2 | 3.5", "| |", "Subtotal: 1,234.50 EUR", "TVA: 20.00", "tax: none", "Total: $ 5..6", "grand total: 9", "Terms: 30 days", "terms: net", "Payment by transfer",
    "1234 5678 9012 0003", "é1234 5678 9012 12", "x\t1234\t5678\t9012", "Ünï: wert", "a_b: c: d", "a\x1fb c", "x\x0by", "ßa Öb", "\x1f", "  ", "é", "7", "x." * 40)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(("", "", " ", "\t")) + rng.choice(LINES) + rng.choice(("\n", "\n", "\r\n", " \n")) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    return spark.createDataFrame([*enumerate(texts), (9001, None), (9002, "")], "doc_id long, text string").repartition(2).cache()


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("made, other", [
    (exports.cv, exports.cv_data), (exports.invoice, exports.invoice_data), (exports.generic, exports.generic_data), (schema.cv_of_texts, lambda t: schema.cv_data(F.col("b"))), (schema.invoice_of_texts, lambda t: schema.invoice_data(F.col("b")))])
def test_batches_equal_the_expressions(docs, made, other):
    got = made(docs)
    want = docs.withColumn("b", schema.blocks_of(F.col("text"))).select("doc_id", other(F.col("text")).alias("data"))
    assert got.schema.simpleString() == want.schema.simpleString()
    got, want = ({r.doc_id: r.data for r in df.collect()} for df in (got, want))
    assert len(got) == 402 and {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}
    assert "ArrowEvalPython" in made(docs)._jdf.queryExecution().toString()


def test_parties_and_routes_equal_the_expressions(docs):
    want = docs.select("doc_id", exports.parties_data(F.col("text")).alias("p")).select("doc_id", "p.*")
    assert rows(exports.invoice_parties(docs)) == rows(want)
    kinds = docs.withColumn("doc_type", F.element_at(F.array(F.lit("cv"), F.lit("invoice"), F.lit("contract"), F.lit(None)), (F.col("doc_id") % 4 + 1).cast("int")))
    text, kind = F.col("text"), F.col("doc_type")
    json = F.when(kind == "cv", F.to_json(exports.cv_data(text))).when(kind == "invoice", F.to_json(exports.invoice_data(text))).otherwise(F.to_json(exports.generic_data(text)))
    assert {r.doc_id: r.json for r in exports.route(kinds).collect()} == {r.doc_id: r.json for r in kinds.select("doc_id", json.alias("json")).collect()}


def test_other_scripts_go_through_the_expressions(spark):
    docs = spark.createDataFrame([(1, "Skills\nPython; İstanbul\nKelvin K"), (2, "Skills\nPython\nx²")], "doc_id long, text string").repartition(1)
    want = docs.select("doc_id", exports.cv_data(F.col("text"), ("skills",)).alias("data"))
    assert rows(exports.cv(docs, ("skills",))) == rows(want)
