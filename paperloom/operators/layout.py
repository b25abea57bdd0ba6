"""Page layout from line boxes: regions, duplicates, columns, blocks, reading order, tables, graph.

Input rows are (doc_id, page, line_idx, text, x1, y1, x2, y2, confidence).
Rules that run along a page, where each step depends on the one before, are
folds over the page's lines, gathered once by (doc_id, page); a page holds as
many lines as a page does.  The fold stays in the JVM; where columns part is
tried for many pages at once.  Final ties go to the lesser line_idx.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import geometry as G
from ..functions import patterns as P
from ..functions import text as X

PAGE = ["doc_id", "page"]
BOX = ("x1", "y1", "x2", "y2")


def pages_of(lines: DataFrame, *order: str) -> DataFrame:
    """(doc_id, page, ls): each page's lines as an array, by ``order``, then line_idx."""
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(order)]
    line = F.struct(*keys, "line_idx", "text", *BOX, "confidence")
    return lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list(line)).alias("ls"))


def box(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in BOX])


def assign_regions(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, page, line_idx, region_idx): the first region, by (y1, x1, region_idx), that holds a line's centre; null for none.

    Regions are gathered by document, so this is one equi-join and no pair is made.
    """
    packed = regions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("y1", "x1", "region_idx", "x2", "y2"))).alias("rs"))
    cx, cy = G.centre_x(box()), G.centre_y(box())
    boxed = lines.select(*PAGE, "line_idx", cx.alias("cx"), cy.alias("cy"))
    held = F.filter("rs", lambda r: (F.col("cx") >= r["x1"]) & (F.col("cx") <= r["x2"]) & (F.col("cy") >= r["y1"]) & (F.col("cy") <= r["y2"]))
    return boxed.join(packed, "doc_id", "left").select(*PAGE, "line_idx", F.try_element_at(held, F.lit(1))["region_idx"].alias("region_idx"))


def drop_duplicates(lines: DataFrame) -> DataFrame:
    """Lines found twice by several passes, once each: in order (y1, x1), a line that doubles a kept one takes its place if it has more confidence, or as much and more text."""
    kind = "array<struct<line_idx:int,text:string,x1:int,y1:int,x2:int,y2:int,confidence:double>>"

    def plain(x: Column) -> Column:
        return F.struct(x["line_idx"].cast("int").alias("line_idx"), x["text"].alias("text"), *[x[c].cast("int").alias(c) for c in BOX], x["confidence"].cast("double").alias("confidence"))

    def step(kept: Column, x: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda k: G.is_duplicate(x, k)), F.lit(True))
        better = lambda k: (x["confidence"] > k["confidence"]) | ((x["confidence"] == k["confidence"]) & (F.char_length(x["text"]) > F.char_length(k["text"])))
        return F.when(at == 0, F.concat(kept, F.array(plain(x)))).otherwise(F.transform(kept, lambda k, i: F.when((i + 1 == at) & better(k), plain(x)).otherwise(k)))

    folded = pages_of(lines, "y1", "x1").select(*PAGE, F.aggregate("ls", F.array().cast(kind), step).alias("kept"))
    return folded.select(*PAGE, F.inline("kept"))


def duplicate_pairs(lines: DataFrame) -> DataFrame:
    """(doc_id, page, a, b): pairs of a page's lines, a < b, that overlap enough to be one."""
    ls = pages_of(lines).select(*PAGE, "ls")
    pair = F.flatten(F.transform("ls", lambda a: F.transform(F.filter("ls", lambda b: (b["line_idx"] > a["line_idx"]) & G.is_duplicate(a, b)), lambda b: F.struct(a["line_idx"].alias("a"), b["line_idx"].alias("b")))))
    return ls.select(*PAGE, F.inline(pair))


def _part_columns(x1s: pa.Array, x2s: pa.Array) -> pa.Array:
    """Of pages' left and right edges: the best of 41 places, between 18 and 58 % of the width, to part two columns; null without one, the first of equals."""
    n = np.array(x1s.value_lengths().fill_null(0), dtype=np.int64)
    used = n > 0
    best, place = np.full(len(n), -np.inf), np.full(len(n), np.nan)
    if used.any():
        x1, x2 = (np.asarray(x.flatten().to_numpy(zero_copy_only=False), dtype=np.float64) for x in (x1s, x2s))
        n = n[used]
        starts, page = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
        w, c = np.fmax.reduceat(x2, starts), (x1 + x2) / 2
        weight = np.where(np.fmax(1, x2 - x1) > 0.62 * w[page], 0.25, 1.0)
        top, at = np.full(len(n), -np.inf), np.full(len(n), np.nan)
        for i in range(41):
            sep = w * (0.18 + 0.40 * i / 40)
            line = sep[page]
            left, right = c <= line, c > line
            gap = np.fmin.reduceat(np.where(right, x1, np.nan), starts) - np.fmax.reduceat(np.where(left, x2, np.nan), starts)
            crossing = np.add.reduceat(np.where((x1 < line) & (line < x2), weight, 0.0), starts) / n
            n_left, n_right = (np.add.reduceat(side.astype(np.int64), starts) for side in (left, right))
            few, many = np.minimum(n_left, n_right), np.maximum(n_left, n_right)
            with np.errstate(divide="ignore", invalid="ignore"):
                score = gap / w * 2.4 + few / many * 0.25 - crossing * 1.8
            better = (few >= 3) & (gap >= np.fmax(45.0, 0.035 * w)) & (w != 0) & (score > top)
            top[better], at[better] = score[better], sep[better]
        best[used], place[used] = top, at
    return pa.array(place, mask=best == -np.inf)


def _separator(ls: Column) -> Column:
    """The best place between two columns of a page's lines, null without one.  A column has three lines, so pages of fewer than six are passed over."""
    enough = F.size(ls) >= 6
    left, right = F.transform(ls, lambda x: x["x1"].cast("double")), F.transform(ls, lambda x: x["x2"].cast("double"))
    return F.arrow_udf(_part_columns, "double")(F.when(enough, left), F.when(enough, right))


def column_separator(lines: DataFrame) -> DataFrame:
    """(doc_id, page, separator): the best place between two columns, null without one; the width is the greatest right edge."""
    return pages_of(lines).select(*PAGE, _separator(F.col("ls")).alias("separator"))


def columns(lines: DataFrame) -> DataFrame:
    """(doc_id, page, line_idx, column_id, role): one or two columns.

    Under eight lines there is one.  Without a separator the widest gap between
    centres parts, if it is wide enough; a side of under three lines makes one column.
    """
    p = pages_of(lines).withColumn("w", F.array_max(F.transform("ls", lambda x: x["x2"])).cast("double"))
    centres = F.array_sort(F.transform("ls", lambda x: G.centre_x(x)))
    gaps = F.transform(F.sequence(F.lit(1), F.size("ls") - 1), lambda i: F.struct((F.get("c", i) - F.get("c", i - 1)).alias("gap"), (-i).alias("i"), ((F.get("c", i) + F.get("c", i - 1)) / 2).alias("mid")))
    p = p.withColumn("c", centres).withColumn("far", F.when(F.size("ls") >= 8, F.array_max(gaps)))
    sep = F.coalesce(_separator(F.col("ls")), F.when(F.col("far.gap") >= F.greatest(F.lit(90.0), 0.10 * F.col("w")), F.col("far.mid")))
    p = p.withColumn("sep", F.when(F.size("ls") >= 8, sep))
    p = p.withColumn("left", F.filter("ls", lambda x: G.centre_x(x) <= F.col("sep"))).withColumn("right", F.filter("ls", lambda x: G.centre_x(x) > F.col("sep")))
    two = (F.size("left") >= 3) & (F.size("right") >= 3)
    span = lambda c: F.array_max(F.transform(c, lambda x: x["x2"])) - F.array_min(F.transform(c, lambda x: x["x1"]))
    words = F.lower(F.array_join(F.transform("left", lambda x: x["text"]), "\n"))
    hits = sum((F.when(F.contains(words, F.lit(k)), 1).otherwise(0) for k in SIDEBAR_WORDS), F.lit(0))
    side = (span("left") < 0.38 * F.col("w")) & (span("right") > 1.25 * span("left")) & (F.array_min(F.transform("right", lambda x: x["x1"])) > 0.30 * F.col("w")) & (hits >= 2)
    p = p.withColumn("two", F.coalesce(two, F.lit(False))).withColumn("side", F.coalesce(side, F.lit(False)))
    cid = lambda x: F.when(F.col("two") & (G.centre_x(x) > F.col("sep")), 1).otherwise(0)
    role = lambda x: F.when(~F.col("two"), "main").when(~F.col("side"), "column").when(G.centre_x(x) <= F.col("sep"), "sidebar").otherwise("main")
    return p.select(*PAGE, F.inline(F.transform("ls", lambda x: F.struct(x["line_idx"].alias("line_idx"), cid(x).alias("column_id"), role(x).alias("role")))))


# fixed values: what a side column speaks of
SIDEBAR_WORDS = ("contact", "skills", "languages", "hobbies", "address", "phone", "email", "coordonnées", "compétences")


def upper_median(values: Column) -> Column:
    """Of sorted values, the one at half their number, counted from 0."""
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def blocks(lines: DataFrame) -> DataFrame:
    """(doc_id, page, line_idx, block): lines of a page, by (y1, x1), cut into blocks.

    A block ends before a section heading, a gap that is wide for the page's line
    height, or a line that stands away from the block's left edge, unless it is a
    bullet or in one row with the line before.
    """
    p = pages_of(lines, "y1", "x1").withColumn("h", F.greatest(F.lit(1), upper_median(F.transform("ls", lambda x: G.height(x)))))
    start = F.struct(F.lit(0).alias("block"), F.lit(None).cast("int").alias("left"), F.lit(None).cast("int").alias("bottom"), F.lit(None).cast("double").alias("cy"), F.lit(None).cast("int").alias("tall"),
                     F.array().cast("array<struct<line_idx:int,block:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap, h = x["y1"] - acc["bottom"], F.col("h")
        same_row = F.abs(G.centre_y(x) - acc["cy"]) <= 0.65 * F.greatest(G.height(x), acc["tall"])
        away = (gap > 0.7 * h) & (F.abs(x["x1"] - acc["left"]) > F.greatest(F.lit(60.0), 2.5 * h)) & ~F.rlike(x["text"], F.lit(P.BULLET)) & ~same_row
        breaks = F.coalesce(acc["bottom"].isNotNull() & (X.section_of(x["text"]).isNotNull() | (gap > F.greatest(1.8 * h, F.lit(34.0))) | away), F.lit(False))
        block = F.when(breaks, acc["block"] + 1).otherwise(acc["block"])
        left = F.when(breaks | acc["left"].isNull(), x["x1"]).otherwise(F.least(acc["left"], x["x1"]))
        return F.struct(block.alias("block"), left.cast("int").alias("left"), x["y2"].cast("int").alias("bottom"), G.centre_y(x).cast("double").alias("cy"), G.height(x).cast("int").alias("tall"),
                        F.concat(acc["out"], F.array(F.struct(x["line_idx"].cast("int").alias("line_idx"), block.cast("int").alias("block")))).alias("out"))

    return p.select(*PAGE, F.inline(F.aggregate("ls", start, step)["out"]))


def block_rows(lines: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """One row a block: text, box, mean confidence, counts, upper median height, and its type.

    Lines have their block themselves, or by (doc_id, page, line_idx) in ``members``.
    """
    rows = lines if members is None else lines.join(members, [*PAGE, "line_idx"])
    line = F.struct("y1", "x1", "line_idx", "text", "x2", "y2")
    b = rows.groupBy(*PAGE, "block").agg(
        F.array_sort(F.collect_list(line)).alias("ls"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.round(F.avg("confidence"), 4).alias("avg_confidence"),
        F.count("*").alias("n_lines"), F.avg(F.greatest(F.lit(1), F.col("y2") - F.col("y1"))).alias("mean_height"))
    b = b.withColumn("text", F.array_join(F.transform("ls", lambda x: x["text"]), "\n")).withColumn("median_height", upper_median(F.transform("ls", lambda x: G.height(x))))
    section = F.try_element_at(F.filter(F.transform("ls", lambda x: X.section_of(x["text"])), lambda s: s.isNotNull()), F.lit(1))
    return b.withColumn("section", section).withColumn("block_type", block_type()).drop("ls", "mean_height")


def block_type() -> Column:
    """Of a row with text, ls, section, mean_height and n_lines."""
    types = F.create_map(*[F.lit(x) for kv in P.SECTION_TYPES.items() for x in kv])
    steps = F.size(F.array_distinct(F.transform("ls", lambda x: F.bround(x["x1"] / 25) * 25)))
    return (F.when(F.col("section").isNotNull(), F.coalesce(types[F.col("section")], F.concat("section", F.lit("_section"))))
            .when((F.size(X.words(F.col("text"))) <= 8) & ((F.col("mean_height") > 22) | X.is_upper(F.col("text"))), "heading")
            .when(F.forall("ls", lambda x: F.rlike(x["text"], F.lit(P.BULLET))), "list_item")
            .when((F.col("n_lines") >= 3) & (steps >= 3) & F.rlike("text", F.lit("\\d")), "table_section")
            .when(F.rlike("text", F.lit(":\\s+\\S|\\.{4,}")), "key_value").otherwise("paragraph"))


def merge_continuations(rows: DataFrame) -> DataFrame:
    """(doc_id, page, block, merged): blocks that continue the section of the one before are one with it."""
    packed = rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("block", "section", "block_type", "y1", "y2", "median_height"))).alias("bs"))
    start = F.struct(F.lit(None).cast("string").alias("section"), F.lit(None).cast("int").alias("y2"), F.lit(None).cast("int").alias("h"), F.lit(-1).alias("merged"), F.array().cast("array<struct<block:int,merged:int>>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        joins = F.coalesce(acc["section"].isin("experience", "education", "summary", "legal_clause") & b["block_type"].isin("paragraph", "list_item", "table_section", "key_value")
                           & (b["y1"] - acc["y2"] < F.greatest(F.lit(60.0), 2.2 * acc["h"])), F.lit(False))
        merged = F.when(joins, acc["merged"]).otherwise(b["block"])
        return F.struct(F.when(joins, acc["section"]).otherwise(b["section"]).alias("section"), F.when(joins, F.greatest(acc["y2"], b["y2"])).otherwise(b["y2"]).cast("int").alias("y2"),
                        F.when(joins, acc["h"]).otherwise(b["median_height"]).cast("int").alias("h"), merged.cast("int").alias("merged"),
                        F.concat(acc["out"], F.array(F.struct(b["block"].cast("int").alias("block"), merged.cast("int").alias("merged")))).alias("out"))

    return packed.select(*PAGE, F.inline(F.aggregate("bs", start, step)["out"]))


def reading_order(rows: DataFrame, *, page_height: Column | None = None, page_width: Column | None = None) -> DataFrame:
    """Block rows with ``reading_order``: titles first, then by column, then downwards.  Needs column_id and role."""
    w = W.partitionBy(*PAGE)
    high, wide = page_height if page_height is not None else F.max("y2").over(w), page_width if page_width is not None else F.max("x2").over(w)
    title = F.when((F.col("y1") < 0.16 * high) & (F.col("block_type") == "heading") & (F.col("x2") - F.col("x1") > 0.18 * wide), 0).otherwise(1)
    sided = F.max(F.when(F.col("role") == "sidebar", 1).otherwise(0)).over(w) == 1
    rank = F.when(sided, F.when(F.col("role") == "sidebar", 2).otherwise(1)).otherwise(F.col("column_id") + 1)
    ranked = rows.withColumn("_title", title).withColumn("_rank", rank)
    return ranked.withColumn("reading_order", F.row_number().over(w.orderBy("_title", "_rank", "y1", "x1", "block"))).drop("_title", "_rank")


def reading_order_bands(lines: DataFrame, band: int = 10) -> DataFrame:
    """(doc_id, page, line_idx, reading_order): by bands of ``band`` pixels, then from the left."""
    w = W.partitionBy(*PAGE).orderBy(F.floor(F.col("y1") / band), "x1", "line_idx")
    return lines.select(*PAGE, "line_idx", F.row_number().over(w).alias("reading_order"))


def line_order(lines: DataFrame, direction: str = "ltr") -> DataFrame:
    """(doc_id, page, line_idx, line_order): downwards, then from the side where reading starts."""
    across = -F.col("x2") if direction == "rtl" else F.col("x1")
    return lines.select(*PAGE, "line_idx", F.row_number().over(W.partitionBy(*PAGE).orderBy("y1", across, "line_idx")).alias("line_order"))


def table_columns(lines: DataFrame, gap: int = 15) -> DataFrame:
    """(doc_id, page, edge, place): the sorted distinct left and right edges, clustered where gaps are at most ``gap``, at their mean."""
    edges = lines.select(*PAGE, F.explode(F.array("x1", "x2")).alias("x")).distinct()
    w = W.partitionBy(*PAGE).orderBy("x")
    marked = edges.withColumn("new", F.when(F.col("x") - F.lag("x").over(w) <= gap, 0).otherwise(1)).withColumn("edge", F.sum("new").over(w) - 1)
    return marked.groupBy(*PAGE, "edge").agg(F.avg("x").alias("place"))


def table_rows(lines: DataFrame, within: float = 20.0) -> DataFrame:
    """(doc_id, page, line_idx, row): lines by centre height; a row holds what lies within ``within`` of its first line."""
    start = F.struct(F.lit(-1).alias("row"), F.lit(None).cast("double").alias("anchor"), F.array().cast("array<struct<line_idx:int,row:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = acc["anchor"].isNull() | (x["k0"] - acc["anchor"] > within)
        row = F.when(new, acc["row"] + 1).otherwise(acc["row"])
        return F.struct(row.alias("row"), F.when(new, x["k0"]).otherwise(acc["anchor"]).cast("double").alias("anchor"),
                        F.concat(acc["out"], F.array(F.struct(x["line_idx"].cast("int").alias("line_idx"), row.cast("int").alias("row")))).alias("out"))

    packed = pages_of(lines.withColumn("cy", G.centre_y(box())), "cy")
    return packed.select(*PAGE, F.inline(F.aggregate("ls", start, step)["out"]))


def table_grid(lines: DataFrame) -> DataFrame:
    """(doc_id, page, row, col, cell): texts by clustered edges and rows; a centre beyond all edges is in column 0."""
    edges = table_columns(lines).groupBy(*PAGE).agg(F.array_sort(F.collect_list("place")).alias("bs"))
    rows = lines.join(table_rows(lines), [*PAGE, "line_idx"]).join(edges, PAGE)
    inside = F.filter(F.sequence(F.lit(1), F.size("bs") - 1), lambda i: (F.get("bs", i - 1) <= F.col("cx")) & (F.col("cx") < F.get("bs", i)))
    placed = rows.withColumn("cx", G.centre_x(box())).withColumn("col", F.coalesce(F.try_element_at(inside, F.lit(1)) - 1, F.lit(0)))
    return placed.groupBy(*PAGE, "row", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "text"))), lambda x: x["text"]), " ").alias("cell"))


def table_by_spacing(docs: DataFrame) -> DataFrame:
    """(doc_id, row, col, cell): lines cut at tabs or two spaces, padded to the widest row; row 0 is the header."""
    rows = F.transform(X.nonempty_lines(F.col("text")), lambda x: F.transform(F.split(x, "\\s{2,}|\\t"), lambda c: F.trim(c)))
    wide = docs.select("doc_id", rows.alias("rows")).withColumn("w", F.array_max(F.transform("rows", lambda r: F.size(r))))
    padded = F.transform("rows", lambda r: F.concat(r, F.array_repeat(F.lit(""), F.col("w") - F.size(r))))
    return wide.select("doc_id", F.posexplode(padded).alias("row", "r")).select("doc_id", "row", F.posexplode("r").alias("col", "cell"))


def spatial_edges(lines: DataFrame) -> DataFrame:
    """(doc_id, page, source, target, relation, weight): each pair of a page with a dominant axis, both ways.

    Pairs of one page are what the graph consists of; a page's regions are few.
    """
    p = pages_of(lines).select(*PAGE, "ls")
    pair = F.flatten(F.transform("ls", lambda a: F.transform(F.filter("ls", lambda b: b["line_idx"] > a["line_idx"]), lambda b: F.struct(a["line_idx"].alias("a"), b["line_idx"].alias("b"), G.relation(a, b).alias("r")))))
    inverse = F.create_map(*[F.lit(x) for kv in G.INVERSE.items() for x in kv])
    both = F.flatten(F.transform(F.filter(pair, lambda e: e["r"].isNotNull()), lambda e: F.array(
        F.struct(e["a"].alias("source"), e["b"].alias("target"), e["r"].alias("relation"), F.lit(1.0).alias("weight")),
        F.struct(e["b"].alias("source"), e["a"].alias("target"), inverse[e["r"]].alias("relation"), F.lit(1.0).alias("weight")))))
    return p.select(*PAGE, F.inline(both))


def order_edges(ordered: DataFrame) -> DataFrame:
    """(doc_id, page, source, target, relation, weight): each line to the next by reading_order."""
    w = W.partitionBy(*PAGE).orderBy("reading_order")
    return (ordered.select(*PAGE, F.col("line_idx").alias("source"), F.lead("line_idx").over(w).alias("target"), F.lit("next_in_order").alias("relation"), F.lit(1.0).alias("weight"))
            .filter("target is not null"))


def section_edges(rows: DataFrame) -> DataFrame:
    """(doc_id, page, source, target, relation, weight): each line to the next with the same prefix of its type."""
    w = W.partitionBy(*PAGE, F.split_part("region_type", F.lit("_"), F.lit(1))).orderBy("line_idx")
    return (rows.select(*PAGE, F.col("line_idx").alias("source"), F.lead("line_idx").over(w).alias("target"), F.lit("same_section").alias("relation"), F.lit(0.8).alias("weight"))
            .filter("target is not null"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(doc_id, page, source, neighbours): each node's targets, comma-parted, by relation and target."""
    return edges.groupBy(*PAGE, "source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("relation", "target"))), lambda e: F.concat(e["relation"], F.lit(":"), e["target"].cast("string"))), ",").alias("neighbours"))


def layout_summary(regions: DataFrame) -> DataFrame:
    """(doc_id, region_type, n)."""
    return regions.groupBy("doc_id", "region_type").agg(F.count("*").alias("n"))


def layout_label(regions: DataFrame, *, span: float = 450.0, least: int = 4) -> DataFrame:
    """(doc_id, layout): table-based with a table, two-column where centres lie far apart, else single-column."""
    cx = (F.col("x1") + F.col("x2")) / 2
    g = regions.groupBy("doc_id").agg(F.count_if(F.col("region_type") == "table").alias("tables"), (F.max(cx) - F.min(cx)).alias("span"), F.count("*").alias("n"))
    return g.select("doc_id", F.when(F.col("tables") > 0, "table-based").when((F.col("n") >= least) & (F.col("span") > span), "two-column").otherwise("single-column").alias("layout"))


def sidebar_label(regions: DataFrame, *, span: float = 420.0, least: int = 4) -> DataFrame:
    """(doc_id, layout): sidebar-main with a region in that role, two-column where centres lie far apart, else single-column."""
    cx = (F.col("x1") + F.col("x2")) / 2
    g = regions.groupBy("doc_id").agg(F.bool_or(F.coalesce(F.col("column_role") == "sidebar", F.lit(False))).alias("side"), (F.max(cx) - F.min(cx)).alias("span"), F.count(cx).alias("n"))
    return g.select("doc_id", F.when(F.col("side"), "sidebar-main").when((F.col("n") >= least) & (F.col("span") > span), "two-column").otherwise("single-column").alias("layout"))


def looks_like_cells(boxes: Column) -> Column:
    """Whether an array of boxes (x1, x2) holds two or more, and those with a width are under 400 wide on average."""
    widths = F.filter(F.transform(boxes, lambda b: b["x2"] - b["x1"]), lambda w: w > 0)
    mean = F.aggregate(widths, F.lit(0.0), lambda a, w: a + w) / F.size(widths)
    return F.coalesce((F.size(boxes) >= 2) & (F.size(widths) > 0) & (mean < 400), F.lit(False))


def table_kind(lines: DataFrame) -> DataFrame:
    """(doc_id, page, kind): how a page's table lines are read: ``grid`` by their boxes where they look like cells, else ``spacing``; ``empty`` without text."""
    g = lines.groupBy(*PAGE).agg(F.collect_list(F.struct("x1", "x2")).alias("boxes"), F.count_if(F.trim("text") != "").alias("n"))
    return g.select(*PAGE, F.when(F.col("n") == 0, "empty").when(looks_like_cells(F.col("boxes")), "grid").otherwise("spacing").alias("kind"))


def parsed_tables(lines: DataFrame) -> DataFrame:
    """(doc_id, page, row, col, cell) of table lines, each page by its ``table_kind``."""
    own = lines.join(table_kind(lines), PAGE).filter("trim(text) <> ''")
    grid = table_grid(own.filter("kind = 'grid'").drop("kind")).select(*PAGE, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "cell")
    texts = (own.filter("kind = 'spacing'").groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("line_idx", "text"))).alias("ls"))
             .select(F.struct(*PAGE).alias("doc_id"), F.array_join(F.transform("ls", lambda x: x["text"]), "\n").alias("text")))
    spaced = table_by_spacing(texts).select("doc_id.*", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "cell")
    return grid.unionByName(spaced)


def table_preview(rows: Column) -> Column:
    """The first eight rows of an array of arrays of cells, a line each, cells parted by a bar."""
    return F.array_join(F.transform(F.slice(rows, 1, 8), lambda r: F.array_join(r, " | ", "")), "\n")


def keyed_rows(columns: Column, rows: Column) -> Column:
    """A table's rows as maps: header (lower-cased, stripped) or ``col_i`` to cell, the last of equal headers, and the whole row under ``raw``; blank rows go."""
    def one(row: Column) -> Column:
        named = F.transform(row, lambda c, i: F.struct(F.coalesce(F.lower(F.trim(F.get(columns, i))), F.concat(F.lit("col_"), i.cast("string"))).alias("key"), c.alias("value")))
        last = F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.greatest(F.size(named), F.lit(1))), lambda x: x["key"] == e["key"]) & (e["key"] != "raw"))
        return F.map_from_entries(F.concat(last, F.array(F.struct(F.lit("raw").alias("key"), F.array_join(row, " | ", "").alias("value")))))

    return F.transform(F.filter(rows, lambda r: F.exists(r, lambda c: F.trim(c) != "")), one)


def candidate_score(confidence: Column, chars: Column) -> Column:
    """How good an OCR pass is: its confidence and, up to 1200 characters, its length."""
    return 0.72 * confidence + 0.28 * F.least(F.lit(1.0), F.log(F.greatest(chars, F.lit(1)).cast("double")) / F.log(F.lit(1200.0)))
