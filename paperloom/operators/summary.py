"""Summaries, key entities, retrieval of single fields, and scripts: small assemblies over what other operators give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X

# fixed values: what a document of a type is for
PURPOSES = {"cv": "Job application curriculum vitae", "invoice": "Payment or billing document", "contract": "Agreement terms document", "id_card": "Identity document",
            "form": "Information collection form", "legal": "Legal or regulatory document", "administrative": "Administrative document"}
# fixed values: recognition languages of a script
SCRIPT_LANGUAGES = {"arabic": ("ar",), "latin": ("en", "fr"), "cjk": ("ch",)}


def purpose(doc_type: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in PURPOSES.items() for x in kv]), doc_type)


def _any(json: Column, *paths: str) -> Column:
    """The first of these members of a JSON text that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.get_json_object(json, f"$.{p}"), F.lit("")) for p in paths])


def as_list(json: Column) -> Column:
    """A JSON value as an array of texts: a list's members, else the value alone, nothing for null or blank."""
    many = F.from_json(json, "array<string>")
    return F.when(json.isNull() | (json == ""), F.array().cast("array<string>")).when(F.startswith(json, F.lit("[")), F.coalesce(many, F.array(json))).otherwise(F.array(json))


def key_entities(json: Column) -> Column:
    """Person, contact, experience, education, skills and languages of structured data, by any name that they go by."""
    return F.struct(
        _any(json, "full_name", "name", "customer", "customer_name", "personal_info.name", "person.name").alias("person_name"),
        F.struct(_any(json, "phone", "personal_info.phone", "contact.phone").alias("phone"), _any(json, "email", "email_address", "personal_info.email", "contact.email").alias("email"),
                 _any(json, "address", "personal_info.address", "contact.location").alias("address")).alias("contact"),
        as_list(_any(json, "experience")).alias("experience"), as_list(_any(json, "education")).alias("education"), as_list(_any(json, "skills")).alias("skills"),
        as_list(_any(json, "languages", "languages_spoken")).alias("languages_spoken"))


def build(docs: DataFrame) -> DataFrame:
    """(doc_id, document_type, purpose, summary, key_entities, confidence) of rows (doc_id, doc_type, text, json, confidence)."""
    ls = X.nonempty_lines(F.col("text"))
    return docs.select("doc_id", F.col("doc_type").alias("document_type"), purpose(F.col("doc_type")).alias("purpose"), F.substring(F.array_join(F.slice(ls, 1, 3), " "), 1, 700).alias("summary"),
                       key_entities(F.col("json")).alias("key_entities"), F.round("confidence", 4).alias("confidence"))


AMOUNT = r"[\d,. ]+(?:EUR|USD|GBP|TND|MAD|DZD|€|\$|£)?"


def field_value(field: str, text: Column) -> Column:
    """What a region that was found for a field says: by the field's kind a match, else its first line."""
    pattern = {"email": P.EMAIL, "phone": P.CORE_PHONE, "issue_date": P.CORE_DATE, "due_date": P.CORE_DATE, "total": AMOUNT, "vat": AMOUNT}.get(field)
    if pattern:
        return F.nullif(F.trim(F.regexp_extract(text, pattern, 0)), F.lit(""))
    return F.try_element_at(X.nonempty_lines(text), F.lit(1))


def retrieved_field(hits: DataFrame, field: str, *, least: float = 0.25, depth: int = 3) -> DataFrame:
    """(query_id, field, value, region): of the best hits (query_id, id, score, rank, text), the first that says something."""
    good = hits.filter((F.col("score") >= least) & (F.col("rank") <= depth)).withColumn("value", field_value(field, F.col("text"))).filter("value is not null")
    best = good.groupBy("query_id").agg(F.min_by(F.struct("value", "id"), "rank").alias("b"))
    return best.select("query_id", F.lit(field).alias("field"), F.col("b.value").alias("value"), F.col("b.id").alias("region"))


def merged_scripts(shares: DataFrame, visual: DataFrame, *, weight: float = 0.7, least: float = 0.15) -> DataFrame:
    """(doc_id, script, score): text shares and visual scores (doc_id, script, share) weighed together; low ones are left out."""
    a, b = shares.select("doc_id", "script", F.col("share").alias("a")), visual.select("doc_id", "script", F.col("share").alias("b"))
    both = a.join(b, ["doc_id", "script"], "full").select("doc_id", "script", (weight * F.coalesce("a", F.lit(0.0)) + (1 - weight) * F.coalesce("b", F.lit(0.0))).alias("score"))
    return both.filter(F.col("score") >= least)


def recognition_languages(scripts: Column, fallback: tuple[str, ...] = ("fr", "en")) -> Column:
    """The distinct languages of an array of scripts, in order."""
    table = F.create_map(*[x for k, v in SCRIPT_LANGUAGES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    found = F.array_distinct(F.flatten(F.transform(scripts, lambda s: F.coalesce(F.try_element_at(table, s), F.array().cast("array<string>")))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, fallback)))


def cached(texts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts (doc_id, text) whose embedding is in the cache (key, embedding), with it; and those that are to be embedded, once each."""
    keyed = texts.withColumn("key", F.sha2("text", 256))
    return keyed.join(cache, "key").select("doc_id", "embedding"), keyed.join(cache, "key", "left_anti").dropDuplicates(["key"]).select("key", "text")


def filled_leaves(flat: DataFrame, depth: int = 5) -> DataFrame:
    """(doc_id, n): leaves (doc_id, path, value) down to a depth that are neither null nor blank."""
    level = F.size(F.regexp_extract_all("path", F.lit(r"[^.\[\]]+"), F.lit(0)))
    return flat.groupBy("doc_id").agg(F.count_if(F.col("value").isNotNull() & (F.col("value") != "") & (level <= depth)).alias("n"))


def report_html(reports: DataFrame) -> DataFrame:
    """(doc_id, html): a run's report (doc_id, status, steps array<struct<name,status,elapsed_ms>>) as a page."""
    from .payloads import escape

    row = lambda s: F.concat(F.lit("<tr><td>"), escape(s["name"]), F.lit("</td><td>"), escape(s["status"]), F.lit("</td><td>"), s["elapsed_ms"].cast("string"), F.lit("</td></tr>"))
    return reports.select("doc_id", F.concat(F.lit("<!doctype html><h1>"), escape(F.col("status")), F.lit("</h1><table>"), F.array_join(F.transform("steps", row), ""), F.lit("</table>")).alias("html"))
