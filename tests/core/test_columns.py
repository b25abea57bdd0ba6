"""Where columns part, against the rule said plainly; and blocks of lines that have theirs."""

import random

from pyspark.sql import functions as F

from paperloom.operators import layout as L

LINE = "doc_id long, page int, line_idx int, text string, x1 int, y1 int, x2 int, y2 int, confidence double"


def plain(boxes):
    w, found = float(max(b for _, b in boxes)), []
    for i in range(41):
        sep = w * (0.18 + 0.40 * i / 40)
        left, right = [b for b in boxes if (b[0] + b[1]) / 2 <= sep], [b for b in boxes if (b[0] + b[1]) / 2 > sep]
        few, many = sorted((len(left), len(right)))
        if few >= 3 and (gap := min(a for a, _ in right) - max(b for _, b in left)) >= max(45.0, 0.035 * w):
            crossing = sum(0.25 if max(1, b - a) > 0.62 * w else 1.0 for a, b in boxes if a < sep < b) / len(boxes)
            found.append((gap / w * 2.4 + few / many * 0.25 - crossing * 1.8, -i, sep))
    return max(found)[2] if found else None


def pages(n):
    rng = random.Random(8)
    for k in range(n):
        boxes = [(a := rng.choice((rng.randint(0, 60), rng.randint(400, 560))), a + rng.randint(-5, 330)) for _ in range(rng.randint(1, 14))]
        yield k, boxes


def test_separators_equal_the_rule_and_no_expression_tries_the_places(spark):
    made = dict(pages(400))
    lines = spark.createDataFrame([(k, 1, i, "x", a, 10 * i, b, 10 * i + 8, 0.5) for k, boxes in made.items() for i, (a, b) in enumerate(boxes)], LINE)
    out = L.column_separator(lines)
    got = {r.doc_id: r.separator for r in out.collect()}
    assert got == {k: plain(boxes) for k, boxes in made.items()} and 20 < sum(v is not None for v in got.values()) < 380
    assert "ArrowEvalPython" in out._jdf.queryExecution().toString()


def test_blocks_of_lines_that_have_theirs_need_no_join(spark):
    rows = [(k, 1, i, t, 10, 40 * i, 200, 40 * i + 18, 0.5) for k in range(3) for i, t in enumerate(("Experience", "did this", "Skills now", "Work history x", "- a", "Experienced"))]
    lines = spark.createDataFrame(rows, LINE).repartition(2)
    of = F.floor(F.col("y1") / 100).cast("int").alias("block")
    alone, joined = L.block_rows(lines.withColumn("block", of)), L.block_rows(lines, lines.select("doc_id", "page", "line_idx", of))
    assert sorted(map(repr, alone.collect())) == sorted(map(repr, joined.collect()))
    assert [r.section for r in alone.filter("doc_id = 1").orderBy("block").collect()] == ["experience", "experience", None]
    assert "Join" not in alone._jdf.queryExecution().optimizedPlan().toString()
