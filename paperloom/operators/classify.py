"""Document type, language and direction from text, by keyword and script counts.

Keywords are looked for in one pass without a join; nothing shuffles.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import plain as A
from ..functions import text as X

TYPES = tuple(P.TYPE_KEYWORDS)


#: every keyword in lower case, once; and of each type, which of them count and how often: a keyword listed twice counts twice
WORDS = tuple(dict.fromkeys(k.lower() for ks in P.TYPE_KEYWORDS.values() for k in ks))
TIMES = {t: tuple((WORDS.index(k), n) for k, n in Counter(k.lower() for k in ks).items()) for t, ks in P.TYPE_KEYWORDS.items()}


def keyword_hits(low: Column) -> Column:
    """How many of each type's keywords a lower-cased text contains, as an array in the order of the types; texts are searched in batches."""
    rows = tuple(TIMES[t] for t in TYPES)

    def count(text: str) -> list[int]:
        said = [w in text for w in WORDS]
        return [sum(n for at, n in row if said[at]) for row in rows]

    return A.batch("array<int>", count)(low)


def _scores(text: Column, more: dict[str, Column] | None = None) -> Column:
    """(hits, -order, type) of every type, as an array; ``more`` is added to the hits."""
    more, found = more or {}, keyword_hits(F.lower(F.coalesce(text, F.lit(""))))
    return F.array(*[F.struct((F.get(found, F.lit(i)).cast("double") + more.get(t, F.lit(0.0))).alias("hits"), F.lit(-i).alias("o"), F.lit(t).alias("type")) for i, t in enumerate(TYPES)])


def _total(scores: Column) -> Column:
    return F.aggregate(scores, F.lit(0.0), lambda a, x: a + x["hits"])


def type_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, type_order, doc_type, hits, share): share of all hits, 0 without any."""
    rows = docs.select("doc_id", _scores(F.col("text")).alias("s")).select("doc_id", _total(F.col("s")).alias("total"), F.inline("s"))
    return rows.select("doc_id", (-F.col("o")).alias("type_order"), F.col("type").alias("doc_type"), F.col("hits").cast("int").alias("hits"), F.when(F.col("total") > 0, F.col("hits") / F.col("total")).otherwise(0.0).alias("share"))


def with_type(docs: DataFrame) -> DataFrame:
    """``docs`` with doc_type, computed in the row."""
    return docs.withColumn("doc_type", X.bind(F.array_max(_scores(F.col("text"))), lambda b: F.when(b["hits"] > 0, b["type"]).otherwise("unknown")))


def document_type(docs: DataFrame, *, floor: float | None = None, visual: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, doc_type, confidence): the type of the most hits, the first of equals, and its share of all.

    Under ``floor`` the type is unknown, with the confidence it had.  ``visual`` adds
    scores from image metrics: type -> column of ``docs``.
    """
    best = X.bind(_scores(F.col("text"), visual), lambda s: F.struct(F.array_max(s).alias("best"), _total(s).alias("total")))
    found = docs.select("doc_id", best.alias("b")).select(
        "doc_id", F.when(F.col("b.best.hits") > 0, F.col("b.best.type")).otherwise("unknown").alias("doc_type"),
        F.when(F.col("b.best.hits") > 0, F.col("b.best.hits") / F.col("b.total")).otherwise(0.0).alias("confidence"))
    return found if floor is None else found.withColumn("doc_type", F.when(F.col("confidence") < floor, "unknown").otherwise(F.col("doc_type")))


def evidence(docs: DataFrame, most: int = 8) -> DataFrame:
    """(doc_id, doc_type, pos, keyword): the first keywords of each type that the text contains."""
    def said(text: str) -> list[tuple[str, int, str]]:
        held = {w for w in WORDS if w in text}
        return [(t, n, k) for t in TYPES for n, k in enumerate([k for k in P.TYPE_KEYWORDS[t] if k.lower() in held][:most])]

    found = A.batch("array<struct<doc_type:string,pos:int,keyword:string>>", said)(F.lower(F.coalesce("text", F.lit(""))))
    return X.exploded(docs.select("doc_id", found.alias("k")), F.col("k"), "_i", "_r", "doc_id").select("doc_id", "_r.*")


def override(docs: DataFrame, types: DataFrame, tables: Column) -> DataFrame:
    """(doc_id, doc_type): an unknown or form type with tables and invoice words is an invoice, an unknown one with CV words a cv.

    ``tables`` is the number of tables, a column of ``docs``.
    """
    both = docs.select("doc_id", F.lower("text").alias("low"), tables.alias("tables")).join(types.select("doc_id", "doc_type"), "doc_id")
    first = F.when(F.col("doc_type").isin("unknown", "form") & (F.col("tables") > 0) & F.rlike("low", F.lit(P.INVOICE_OVERRIDE)), "invoice").otherwise(F.col("doc_type"))
    return both.select("doc_id", F.when((first == "unknown") & F.rlike("low", F.lit(P.CV_OVERRIDE)), "cv").otherwise(first).alias("doc_type"))


def letters(text: Column, kind: str) -> Column:
    """How many letters of a class a text has: what its length loses without them, as counting matches would make a string of each."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, kind, ""))


def script_counts(text: Column) -> dict[str, Column]:
    return {"latin": letters(text, P.LATIN), "arabic": letters(text, P.ARABIC), "cjk": letters(text, P.CJK)}


def script_shares(docs: DataFrame) -> DataFrame:
    """(doc_id, script, share) of the letters of three scripts."""
    counts = script_counts(F.coalesce("text", F.lit("")))
    rows = F.array(*[F.struct(F.lit(k).alias("script"), c.alias("n")) for k, c in counts.items()])
    found = docs.select("doc_id", rows.alias("r")).select("doc_id", F.greatest(F.aggregate("r", F.lit(0), lambda a, x: a + x["n"]), F.lit(1)).alias("total"), F.inline("r"))
    return found.select("doc_id", "script", F.round(F.col("n") / F.col("total"), 4).alias("share"))


def language_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, lang_order, lang, score): script shares and hints; zero scores are left out."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.lower(text).alias("low"), F.rlike(text, F.lit(P.ACCENTED)).alias("accented"), *[c.cast("double").alias(k) for k, c in script_counts(text).items()])
    total = F.greatest(F.lit(1.0), F.col("latin") + F.col("arabic") + F.col("cjk"))

    def hinted(lang: str) -> Column:
        weight, words = P.LANGUAGE_HINTS[lang]
        return sum((F.when(F.contains("low", F.lit(w)), 1).otherwise(0) for w in words), F.lit(0)) * F.lit(weight)

    scores = {"ar": F.col("arabic") / total + hinted("ar"), "fr": F.col("latin") / total * 0.45 + hinted("fr") + F.when(F.col("accented"), 0.35).otherwise(0.0),
              "en": F.col("latin") / total * 0.55 + hinted("en"), "zh": F.col("cjk") / total + hinted("zh")}
    rows = F.array(*[F.struct(F.lit(i).alias("lang_order"), F.lit(k).alias("lang"), v.alias("score")) for i, (k, v) in enumerate(scores.items())])
    return base.select("doc_id", F.inline(rows)).filter("score > 0")


def language(docs: DataFrame) -> DataFrame:
    """(doc_id, language, direction, confidence): the best share of scores, to four places; ``unknown`` without any."""
    text = F.coalesce("text", F.lit(""))
    total = F.greatest(F.lit(1.0), sum(script_counts(text).values(), F.lit(0)).cast("double"))
    counts, low = script_counts(text), F.lower(text)

    def hinted(lang: str) -> Column:
        weight, words = P.LANGUAGE_HINTS[lang]
        return sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0)) * F.lit(weight)

    scores = {"ar": counts["arabic"] / total + hinted("ar"), "fr": counts["latin"] / total * 0.45 + hinted("fr") + F.when(F.rlike(text, F.lit(P.ACCENTED)), 0.35).otherwise(0.0),
              "en": counts["latin"] / total * 0.55 + hinted("en"), "zh": counts["cjk"] / total + hinted("zh")}
    rows = F.array(*[F.struct(v.alias("score"), F.lit(-i).alias("o"), F.lit(k).alias("lang")) for i, (k, v) in enumerate(scores.items())])
    best = docs.select("doc_id", rows.alias("r")).select(
        "doc_id", F.aggregate("r", F.lit(0.0), lambda a, x: a + x["score"]).alias("total"), F.col("r"))
    shares = F.transform("r", lambda x: F.struct(F.round(x["score"] / F.col("total"), 4).alias("share"), x["o"].alias("o"), x["lang"].alias("lang")))
    found = best.select("doc_id", F.when(F.col("total") > 0, F.array_max(shares)).alias("b"))
    lang = F.coalesce("b.lang", F.lit("unknown"))
    return found.select("doc_id", lang.alias("language"), direction(lang).alias("direction"), F.coalesce("b.share", F.lit(0.0)).alias("confidence"))


def direction(lang: Column) -> Column:
    return F.when(F.lower(lang).isin(*P.RTL), "rtl").otherwise("ltr")
