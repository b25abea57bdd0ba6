"""Flat field tables: typed decoding, nested JSON export, flattening, labels.

A document's fields are rows (job_id, field_name, raw_value, normalized_value,
data_type, ...), a field's name being its dotted path.  Building nested JSON
from paths has no Spark operator, so a job's rows meet in one grouped-map call;
a job has as many fields as one document.  Flattening is a map over JSON text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P

PART = re.compile(r"[^.\[\]]+|\[\d+\]")


def path_parts(path: Column) -> Column:
    """The keys and indexes of a path; an index without its brackets."""
    return F.transform(F.regexp_extract_all(path, F.lit(r"[^.\[\]]+|\[\d+\]"), F.lit(0)), lambda p: F.regexp_replace(p, r"[\[\]]", ""))


def category(path: Column) -> Column:
    return F.regexp_extract(path, r"^([^.\[]*)", 1)


def label(path: Column) -> Column:
    """A known path's label; else its words with capitals, > between steps."""
    table = F.create_map(*[F.lit(x) for kv in P.FIELD_LABELS.items() for x in kv])
    words = F.replace(F.replace(path, F.lit("_"), F.lit(" ")), F.lit("."), F.lit(" > "))
    return F.coalesce(F.try_element_at(table, path), F.initcap(words))


def decoded(text: Column, kind: Column) -> Column:
    """A value as JSON text by its tag; text that does not decode stays text, null and blank stay as they are."""
    quoted = F.to_json(F.struct(text.alias("v")))
    as_text = F.regexp_replace(F.regexp_replace(quoted, '^\\{"v":', ""), "\\}$", "")
    low = F.lower(F.trim(text))
    whole = F.trim(text).try_cast("bigint")
    real = F.trim(text).try_cast("double")
    return (F.when(text.isNull(), None).when(kind == "string", as_text)
            .when(kind == "boolean", F.when(low.isin("true", "1", "yes"), "true").otherwise("false"))
            .when(kind == "integer", F.coalesce(whole.cast("string"), as_text)).when(kind == "number", F.coalesce(real.cast("string"), as_text))
            .when(kind.isNull() | ~kind.isin("string", "boolean", "integer", "number"), F.when(F.try_parse_json(text).isNotNull(), text).otherwise(as_text)))


def value_text(value: object) -> str | None:
    if value is None:
        return None
    return json.dumps(value, ensure_ascii=False) if isinstance(value, (dict, list)) else str(value)


def tag(value: object) -> str:
    """The type tag of a plain value; a boolean is no integer."""
    for kind, name in ((bool, "boolean"), (int, "integer"), (float, "number"), (list, "array"), (dict, "object")):
        if isinstance(value, kind):
            return name
    return "string"


def leaves(value: object, path: str = "") -> Iterator[tuple[str, object]]:
    """(path, leaf) in order; empty objects and lists have none."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from leaves(v, f"{path}.{k}" if path else str(k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from leaves(v, f"{path}[{i}]")
    else:
        yield path, value


def flatten_json(docs: DataFrame, *, id_col: str = "doc_id", json_col: str = "json") -> DataFrame:
    """(id, pos, path, value, data_type): the leaves of each JSON text, in its order; text that is no JSON has none."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(parts):
        for pdf in parts:
            rows = []
            for i, text in zip(pdf[id_col], pdf[json_col]):
                try:
                    data = json.loads(text) if isinstance(text, str) else {}
                except ValueError:
                    data = {}
                rows += [(i, n, p, value_text(v), tag(v)) for n, (p, v) in enumerate(leaves(data)) if p]
            yield pd.DataFrame(rows, columns=[id_col, "pos", "path", "value", "data_type"])

    return docs.select(id_col, json_col).mapInPandas(run, f"`{id_col}` {kind}, pos int, path string, value string, data_type string")


def coerce(text: object, kind: object) -> object:
    """A stored text as the value its tag says; text that does not fit stays text, an untagged one may be JSON."""
    if text is None or (isinstance(text, float) and text != text):
        return None
    text = str(text)
    low = text.strip().lower()
    try:
        if kind == "boolean":
            return low in ("true", "1", "yes")
        if kind == "integer":
            return int(text)
        if kind == "number":
            return float(text)
        if kind == "string":
            return text
        return json.loads(text)
    except ValueError:
        return text


def _place(root: dict, path: str, value: object) -> None:
    """Puts a value at a path, making what is missing; a path that crosses another kind of value is passed over."""
    parts = [int(p[1:-1]) if p[0] == "[" else p for p in PART.findall(path)]
    at: object = root
    for p, after in zip(parts, [*parts[1:], None]):
        fresh: object = value if after is None else [] if isinstance(after, int) else {}
        if isinstance(p, int):
            if not isinstance(at, list):
                return
            at.extend([None] * (p + 1 - len(at)))
            if after is None or at[p] is None:
                at[p] = fresh
        else:
            if not isinstance(at, dict):
                return
            if after is None or at.get(p) is None:
                at[p] = fresh
        at = at[p]


def prune(value: object) -> object:
    """Without empty members: they are told before their own members are pruned, and lists close up."""
    empty = lambda x: x is None or x == "" or x == [] or x == {}
    if isinstance(value, dict):
        return {k: prune(v) for k, v in value.items() if not empty(v)}
    if isinstance(value, list):
        return [prune(v) for v in value if not empty(v)]
    return value


def nested(fields: list[tuple[str, object]]) -> dict:
    root: dict = {}
    for path, value in fields:
        if value is not None and value != "":
            _place(root, path, value)
    return prune(root)


def export_json(fields: DataFrame, *, order: str = "field_name") -> DataFrame:
    """(job_id, exported_data): each job's fields as nested JSON.

    A validated field gives its normalised value, any other its raw one; skipped
    fields are there too.  Fields take their places in ``order``.
    """
    kind = fields.schema["job_id"].dataType.simpleString()
    used = fields.select("job_id", F.col(order).alias("_order"), "field_name", "data_type",
                         F.when(F.col("is_validated") & F.col("normalized_value").isNotNull(), F.col("normalized_value")).otherwise(F.col("raw_value")).alias("v"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["_order", "field_name"], kind="stable")
        data = nested([(p, coerce(v, k if isinstance(k, str) else None)) for p, v, k in zip(rows["field_name"], rows["v"], rows["data_type"])])
        return pd.DataFrame({"job_id": [pdf["job_id"].iloc[0]], "exported_data": [json.dumps(data, ensure_ascii=False)]})

    return used.groupBy("job_id").applyInPandas(run, f"job_id {kind}, exported_data string")


def export_values(fields: DataFrame) -> DataFrame:
    """(job_id, field_name, value): what an export puts at each path, as JSON text; blank values are left out."""
    v = F.when(F.col("is_validated") & F.col("normalized_value").isNotNull(), F.col("normalized_value")).otherwise(F.col("raw_value"))
    return fields.select("job_id", "field_name", v.alias("v"), "data_type").filter("v is not null and v <> ''").select("job_id", "field_name", decoded(F.col("v"), F.col("data_type")).alias("value"))


def mean_confidence(fields: DataFrame) -> DataFrame:
    """(job_id, confidence, n_fields): the mean of what is known, null without any."""
    return fields.groupBy("job_id").agg(F.avg("confidence").alias("confidence"), F.count("*").alias("n_fields"))


def corrected(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """Fields with the latest correction (job_id, field_name, normalized_value, is_skipped, ts) of each applied."""
    last = corrections.groupBy("job_id", "field_name").agg(F.max_by(F.struct("normalized_value", "is_skipped"), "ts").alias("c"))
    joined = fields.join(last, ["job_id", "field_name"], "left")
    return (joined.withColumn("is_validated", F.col("is_validated") | F.col("c.normalized_value").isNotNull())
            .withColumn("normalized_value", F.coalesce("c.normalized_value", "normalized_value"))
            .withColumn("is_skipped", F.coalesce("c.is_skipped", "is_skipped")).drop("c").select(*fields.columns))
