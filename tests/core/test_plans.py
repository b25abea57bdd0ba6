"""Plans that compute a thing once."""

from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators import exports, fields, payloads


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_payload_is_parsed_once(spark):
    rows = spark.range(2).select(F.col("id").alias("doc_id"), F.lit('{"rec_texts": ["a"]}').alias("payload")).repartition(1)
    # modern payloads once, legacy ones once and the two parts of a line once
    assert plan(payloads.lines(rows)).count("from_json") <= 4


def test_an_exploded_array_is_computed_once(spark):
    docs = spark.createDataFrame([(1, "Jean Dupont\nSkills\nSQL; Java\nLanguages\nFrench: native"), (2, ""), (3, None)], "doc_id long, text string").repartition(1)
    assert plan(fields.lines(docs)).count("split(") <= 2  # its two branches
    assert [tuple(r) for r in fields.lines(docs).filter("pos = 1").collect()] == [(1, 1, "Skills")]


def test_parts_of_a_curriculum_alone(spark):
    docs = spark.createDataFrame([(1, "Jean Dupont\nSkills\nSQL; Java\nLanguages\nFrench: native\nProjects"), (2, ""), (3, None)], "doc_id long, text string")
    whole = {r.doc_id: r.data for r in exports.cv(docs).collect()}
    for part in exports.CV_PARTS:
        alone = exports.cv(docs, (part,))
        assert alone.schema["data"].dataType.names == [part]
        assert {r.doc_id: r.data[part] for r in alone.collect()} == {k: v[part] for k, v in whole.items()}


def test_lines_of_odd_blanks(spark):
    texts = ["a\n\n b \r\nc", " a", "a \x0b\x1c b  c 　d ", "\n \n", "é\t\n\tb", "one   two\n", "\r\n\r\nx\x85y"]
    for t in texts:
        got = spark.createDataFrame([(t,)], "t string").select(X.nonempty_lines(F.col("t")).alias("l")).first().l
        assert got == [x.strip() for x in t.splitlines() if x.strip()]
