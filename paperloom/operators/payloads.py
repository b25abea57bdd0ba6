"""Decoding what providers answer: recognition payloads of two shapes, layout payloads, model answers, schema checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions import patterns as P
from ..functions import text as X

MODERN = "struct<rec_texts:array<string>,rec_scores:array<double>,rec_polys:array<array<array<double>>>,rec_boxes:array<array<double>>>"
LINES = "array<struct<text:string,confidence:double,polygon:array<struct<x:double,y:double>>,x1:double,y1:double,x2:double,y2:double>>"


def _corners(b: Column) -> Column:
    x1, y1, x2, y2 = (b[k] for k in ("x1", "y1", "x2", "y2"))
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))])


def modern_lines(payload: Column) -> Column:
    """Lines of a payload of parallel arrays; missing scores are 0, a polygon of under four points is the box, a missing box that of the polygon."""
    def lines_(p: Column) -> Column:
        def line(text: Column, i: Column) -> Column:
            def of(poly: Column, whole: Column, box: Column) -> Column:
                return F.struct(F.trim(text).alias("text"), G.confidence(F.get(p["rec_scores"], i)).alias("confidence"), F.when(whole, F.slice(poly, 1, 4)).otherwise(_corners(box)).alias("polygon"),
                                box["x1"].alias("x1"), box["y1"].alias("y1"), box["x2"].alias("x2"), box["y2"].alias("y2"))

            points = F.transform(F.get(p["rec_polys"], i), lambda q: F.struct(F.get(q, F.lit(0)).alias("x"), F.get(q, F.lit(1)).alias("y")))
            return X.bind(points, lambda poly: X.bind(F.coalesce(F.size(poly) >= 4, F.lit(False)), lambda whole: X.bind(
                F.coalesce(X.bind(F.get(p["rec_boxes"], i), G.from_any), F.when(whole, G.of_polygon(poly))), lambda box: of(poly, whole, box))))

        return F.filter(F.transform(p["rec_texts"], line), lambda x: (x["text"] != "") & x["x1"].isNotNull())

    return X.bind(F.from_json(payload, MODERN), lines_)


def legacy_lines(payload: Column) -> Column:
    """Lines of a payload [[polygon, [text, score]], ...]."""
    rows = F.from_json(payload, "array<array<string>>")

    def line(row: Column) -> Column:
        def of(poly: Column, said: Column, box: Column) -> Column:
            return F.struct(F.trim(F.get(said, F.lit(0))).alias("text"), G.confidence(F.get(said, F.lit(1)).try_cast("double")).alias("confidence"), poly.alias("polygon"), box["x1"].alias("x1"), box["y1"].alias("y1"), box["x2"].alias("x2"), box["y2"].alias("y2"))

        points = X.bind(F.from_json(F.get(row, F.lit(0)), "array<array<double>>"), lambda qs: F.transform(qs, lambda q: F.struct(F.get(q, F.lit(0)).alias("x"), F.get(q, F.lit(1)).alias("y"))))
        return X.bind(points, lambda poly: X.bind(F.from_json(F.get(row, F.lit(1)), "array<string>"), lambda said: X.bind(G.of_polygon(poly), lambda box: of(poly, said, box))))

    return F.filter(F.transform(rows, line), lambda x: (x["text"] != "") & x["x1"].isNotNull())


def lines(rows: DataFrame, *, json_col: str = "payload") -> DataFrame:
    """(doc_id, line_idx, text, confidence, x1, y1, x2, y2) of payloads of either shape; what does not decode has no lines."""
    found = F.when(F.startswith(F.ltrim(json_col), F.lit("[")), legacy_lines(F.col(json_col))).otherwise(modern_lines(F.col(json_col)))
    return X.exploded(rows, found, "line_idx", "l", "doc_id").select("doc_id", "line_idx", "l.text", "l.confidence", "l.x1", "l.y1", "l.x2", "l.y2")


def regions(rows: DataFrame, *, json_col: str = "payload") -> DataFrame:
    """(doc_id, region_idx, region_type, confidence, x1, y1, x2, y2) of layout payloads {"boxes": [{label, score, coordinate}]}."""
    found = F.from_json(json_col, "struct<boxes:array<struct<label:string,score:double,coordinate:array<double>>>>")["boxes"]
    r = X.exploded(rows, found, "region_idx", "r", "doc_id")
    return (r.select("doc_id", "region_idx", region_type(F.col("r.label")).alias("region_type"), G.confidence(F.col("r.score")).alias("confidence"), G.from_any(F.col("r.coordinate")).alias("b"))
            .filter("b is not null").select("doc_id", "region_idx", "region_type", "confidence", "b.*"))


def region_type(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in P.REGION_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(label))), F.lower(F.trim(label)), F.lit("unknown"))


def answer(text: Column) -> Column:
    """A model's answer as JSON text: the fence around it goes, and what is no object is null."""
    body = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), "^```[a-zA-Z]*\\s*", ""), "\\s*```$", ""))
    return F.when(F.startswith(body, F.lit("{")) & F.try_parse_json(body).isNotNull(), body)


INVOICE = T.StructType([T.StructField(n, T.StringType()) for n in ("invoice_number", "issue_date", "due_date", "seller", "buyer", "subtotal", "tax", "total", "currency")]
                       + [T.StructField("line_items", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("description", "quantity", "unit_price", "total")])))])
CV = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "email", "phone", "summary")]
                  + [T.StructField("experience", T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("organization", T.StringType()), T.StructField("date_range", T.StringType()), T.StructField("bullets", T.ArrayType(T.StringType()))]))),
                     T.StructField("education", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("degree", "institution", "date_range")]))), T.StructField("skills", T.ArrayType(T.StringType())), T.StructField("languages", T.ArrayType(T.StringType()))])


def checked(rows: DataFrame, schema: T.StructType, *, json_col: str = "json") -> DataFrame:
    """(doc_id, data, warning): JSON by a schema, unknown keys left out; text that does not fit stays as it is, with a warning."""
    bad = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = rows.select("doc_id", F.col(json_col).alias("json"), F.from_json(json_col, bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("p"))
    fits = F.col("p").isNotNull() & F.col("p._bad").isNull()
    return parsed.select("doc_id", F.when(fits, F.to_json(F.col("p").dropFields("_bad"))).otherwise(F.col("json")).alias("data"), F.when(~fits, "does not fit the schema").alias("warning"))


def report(lines_: DataFrame, types: DataFrame) -> DataFrame:
    """(doc_id, report): a run's report as JSON, from its lines and type."""
    g = lines_.groupBy("doc_id").agg(F.count("*").alias("lines"), F.round(F.avg("confidence"), 4).alias("confidence"))
    return g.join(types, "doc_id").select("doc_id", F.to_json(F.struct(F.lit("success").alias("status"), "doc_type", "lines", F.col("confidence"))).alias("report"))


def escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def viewer_html(lines_: DataFrame) -> DataFrame:
    """(doc_id, html): a page's line boxes as percentages of its extent."""
    packed = lines_.groupBy("doc_id").agg(F.max("x2").alias("w"), F.max("y2").alias("h"), F.array_sort(F.collect_list(F.struct("y1", "x1", "x2", "y2", "text"))).alias("ls"))
    pct = lambda a, of: F.format_number(a * 100.0 / F.col(of), 2)
    div = lambda x: F.concat(F.lit('<div title="'), escape(x["text"]), F.lit('" style="left:'), pct(x["x1"], "w"), F.lit("%;top:"), pct(x["y1"], "h"), F.lit("%;width:"), pct(x["x2"] - x["x1"], "w"), F.lit("%;height:"), pct(x["y2"] - x["y1"], "h"), F.lit('%"></div>'))
    return packed.select("doc_id", F.concat(F.lit('<!doctype html><div class="page">'), F.array_join(F.transform("ls", div), ""), F.lit("</div>")).alias("html"))
