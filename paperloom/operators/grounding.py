"""Evidence for extracted values: is a value in its source, and where.

Values and sources meet by document id; sources that are searched are one text,
or a short array of regions, in the same row as the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def is_grounded(value: Column, source: Column) -> Column:
    """Short values are taken as they are; others must be in the source, both reduced to a-z and 0-9, or their first or last ten letters must."""
    def of(v: Column, s: Column) -> Column:
        near = (F.char_length(v) > 10) & (F.contains(s, F.substring(v, 1, 10)) | F.contains(s, F.right(v, F.lit(10))))
        return (F.char_length(value) < 3) | F.contains(s, v) | near

    return value.isNull() | X.bind(F.struct(X.norm_text(value).alias("v"), X.norm_text(source).alias("s")), lambda b: of(b["v"], b["s"]))


def verify(values: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc_id, path, value, grounded) of values (doc_id, path, value) and sources (doc_id, text)."""
    joined = values.join(sources.select("doc_id", F.coalesce("text", F.lit("")).alias("source")), "doc_id", "left")
    return joined.select("doc_id", "path", "value", is_grounded(F.col("value"), F.coalesce("source", F.lit(""))).alias("grounded"))


def drop_ungrounded(checked: DataFrame) -> DataFrame:
    return checked.filter("grounded").select("doc_id", "path", "value")


def all_grounded(checked: DataFrame) -> DataFrame:
    """(doc_id, is_grounded)."""
    return checked.groupBy("doc_id").agg(F.bool_and("grounded").alias("is_grounded"))


def evidence(values: DataFrame, sources: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, path, value, source, region_idx, confidence): where each value is found.

    Values under two characters, and those that the source does not hold, have no
    evidence.  The first region, by page and place, that holds the value gives box
    and confidence; without one the document's text stands, with confidence 1.
    ``regions`` rows: (doc_id, page, region_idx, text, confidence).
    """
    packed = regions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "region_idx", X.norm_text(F.col("text")).alias("norm"), "confidence"))).alias("rs"))
    rows = (values.filter("value is not null and char_length(value) >= 2").join(sources.select("doc_id", X.norm_text(F.coalesce("text", F.lit(""))).alias("norm_source")), "doc_id")
            .join(packed, "doc_id", "left").withColumn("norm", X.norm_text(F.col("value"))).filter("contains(norm_source, norm)"))
    hit = F.when(F.col("norm") != "", F.try_element_at(F.filter("rs", lambda r: F.contains(r["norm"], F.col("norm"))), F.lit(1)))
    return (rows.withColumn("hit", hit).select("doc_id", "path", "value", F.when(F.col("hit").isNotNull(), "region").otherwise("document_text").alias("source"),
                                              F.col("hit.region_idx").alias("region_idx"), F.coalesce("hit.confidence", F.lit(1.0)).alias("confidence")))


def fields(values: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, path, value, status, confidence): verified with evidence, suggested at 0.5 without."""
    joined = values.filter("value is not null and value <> ''").join(found.select("doc_id", "path", F.col("confidence").alias("c")), ["doc_id", "path"], "left")
    return joined.select("doc_id", "path", "value", F.when(F.col("c").isNotNull(), "verified").otherwise("suggested").alias("status"), F.coalesce("c", F.lit(0.5)).alias("confidence"))


def without_invention(values: DataFrame, sources: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, path, value, data_type): strings that are in the source or among the candidates, ignoring case; all else null."""
    known = candidates.groupBy("doc_id").agg(F.collect_set(F.lower("value")).alias("known"))
    rows = values.join(sources.select("doc_id", F.lower("text").alias("low")), "doc_id", "left").join(known, "doc_id", "left")
    v = F.lower("value")
    kept = (F.col("data_type") == "string") & (F.coalesce(F.contains("low", v), F.lit(False)) | F.coalesce(F.array_contains("known", v), F.lit(False)))
    return rows.select("doc_id", "path", F.when(kept, F.col("value")).alias("value"), "data_type")


def fill_gaps(first: DataFrame, second: DataFrame) -> DataFrame:
    """(doc_id, path, value): the first table's value unless it is blank or missing, else the second's."""
    a, b = first.select("doc_id", "path", F.col("value").alias("a")), second.select("doc_id", "path", F.col("value").alias("b"))
    return a.join(b, ["doc_id", "path"], "full").select("doc_id", "path", F.coalesce(F.nullif("a", F.lit("")), "b").alias("value"))
