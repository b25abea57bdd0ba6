"""The pipeline's stages, one after the other, against plain rules."""

import random

import corpus_pipeline
import __spark_entry__
from paperloom.llm import queries


def corpus(spark, folder):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    item = prose(20)
    rows = [(k, prose(rng.randint(60, 160)), "en", "s", 0) for k in range(400)]
    for k in range(0, 400, 5):  # toxic ones
        rows[k] = (k, " ".join(w if i % 12 else "worthless idiot" for i, w in enumerate(rows[k][1].split())), "en", "s", 0)
    rows += [(1000 + k, rows[k][1], "en", "s", 0) for k in range(1, 5)]  # copies
    rows += [(1010, prose(40) + " " + item + " " + prose(40), "en", "s", 0), (1011, "A line for two documents\n" + prose(70), "en", "s", 0), (1012, prose(70) + "\nA line for two documents", "en", "s", 0), (1013, None, "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    rows = corpus(spark, folder)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns and out.schema == docs.schema
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    every = {r[0] for r in rows}
    toxic = {k for k in range(0, 400, 5)}
    assert len(toxic & ids[0]) <= 2 and len(every - toxic - ids[0]) <= 2
    assert ids[1] == ids[0]
    text = {r.doc_id: r for r in spark.read.parquet(f"{folder}/line_dedup").collect()}
    assert "A line for two documents" in text[1011].text and "A line for two documents" not in text[1012].text and text[1012].n_chars == len(text[1012].text)
    # copies of one line lose it and are empty; empty texts are one group, of which the least id stays
    assert text[1001].text == "" and not ids[2] & {1002, 1003, 1004, 1013} and ids[2] == ids[1] - {1002, 1003, 1004, 1013}
    assert ids[3] == ids[2] - {1010}
    final = docs.collect()
    assert ids[4] == ids[3] and all(r.round_trip is not False for r in final) and sum(r.n_pieces for r in final) > 10_000
    whole = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in whole.select("doc_id").collect()} == ids[4]


def test_every_query_is_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(queries.oracle_sql()) <= set(names)
