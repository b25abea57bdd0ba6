"""Queries over text: lines, pairs, candidates, totals, sections, types, languages, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import patterns as P
from ..functions import text as X
from ..operators import classify, eav, exports, fields, grounding, layout
from ..sources import rendered as R
from .registry import query


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({x})), '[^a-z0-9]+', ' ', 'g'))"


def key_sql(x: str) -> str:
    return f"replace({norm_sql(x)}, ' ', '_')"


def number_sql(x: str) -> str:
    """The number parser over a text column: the first run that looks like money, commas as points, the last point kept."""
    raw = rf"replace(regexp_replace(regexp_extract({x}, '(?i)(?:€|\$|£)?\s*\d[\d\s,.]*(?:€|\$|£|EUR|USD|GBP|TND|MAD|DZD)?'), '[^\d,.-]', '', 'g'), ',', '.')"
    return (f"TRY_CAST(CASE WHEN length({raw}) - length(replace({raw}, '.', '')) > 1 THEN replace(regexp_replace({raw}, '\\.[^.]*$', ''), '.', '') || regexp_extract({raw}, '\\.[^.]*$') ELSE {raw} END AS DOUBLE)")


def lines_sql(docs: str) -> str:
    return (f"lists AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM {docs}),\n"
            "lines AS (SELECT doc_id, CAST(i - 1 AS INT) AS pos, ls[i] AS line FROM lists, unnest(range(1, len(ls) + 1)) t(i))")


PAIRS = (lines_sql("invoice_docs") + ",\npairs AS (SELECT doc_id, pos, " + key_sql("split_part(line, ':', 1)") + " AS key, trim(substr(line, instr(line, ':') + 1)) AS value FROM lines WHERE contains(line, ':')),\n"
         "kv AS (SELECT * FROM pairs WHERE key <> '' AND value <> '')")


@query(R.with_ctes(R.INVOICE_SQL, lines_sql("invoice_docs"), query="SELECT doc_id, pos, line FROM lines"))
def nonempty_lines(spark, sf_dir):
    return fields.lines(R.invoice_docs(spark, sf_dir))


@query(R.with_ctes(R.INVOICE_SQL, PAIRS, query="SELECT doc_id, key, arg_max(value, pos) AS value, min(pos) AS pos FROM kv GROUP BY doc_id, key"))
def kv_last_wins(spark, sf_dir):
    return fields.key_values(R.invoice_docs(spark, sf_dir))


@query(R.with_ctes(R.INVOICE_SQL, PAIRS, query="SELECT doc_id, CASE WHEN n > 1 THEN key || '_' || n ELSE key END AS key, value, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS n FROM kv)"))
def kv_suffixed(spark, sf_dir):
    return fields.key_values(R.invoice_docs(spark, sf_dir), repeats="suffix")


@query(R.with_ctes(R.INVOICE_SQL, PAIRS, query="SELECT doc_id, CASE WHEN n > 1 THEN key || '_' || n ELSE key END AS key, value, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS n FROM "
       "(SELECT doc_id, key, value, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS pos FROM pairs) WHERE value <> '')"))
def kv_exact(spark, sf_dir):
    return fields.exact_pairs(R.invoice_docs(spark, sf_dir))


TOTALS = (PAIRS + ",\nlast AS (SELECT doc_id, key, arg_max(value, pos) AS value, min(pos) AS pos FROM kv GROUP BY doc_id, key),\n"
          "found AS (SELECT d.doc_id, " + ", ".join(
              f"coalesce({', '.join(f'max(CASE WHEN key = {k!r} THEN value END)' for k in keys)}, arg_min(CASE WHEN {' OR '.join(f'contains(key, {k!r})' for k in keys)} THEN value END, "
              f"CASE WHEN {' OR '.join(f'contains(key, {k!r})' for k in keys)} THEN pos END)) AS {name}"
              for name, keys in (("subtotal", ("subtotal", "sous_total", "sub_total")), ("tax", ("tax", "vat", "tva")), ("total", ("total", "grand_total", "amount_due", "montant_total"))))
          + " FROM invoice_docs d LEFT JOIN last l ON d.doc_id = l.doc_id GROUP BY d.doc_id)")
TOTALS_SQL = R.with_ctes(R.INVOICE_SQL, TOTALS, query=f"SELECT doc_id, {number_sql('subtotal')} AS subtotal, {number_sql('tax')} AS tax, coalesce({number_sql('total')}, {number_sql('subtotal')} + {number_sql('tax')}) AS total FROM found")


@query(TOTALS_SQL)
def invoice_totals(spark, sf_dir):
    return fields.invoice_totals(R.invoice_docs(spark, sf_dir))


@query(R.with_ctes(R.INVOICE_SQL, lines_sql("invoice_docs"), query="SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS pos, trim(split_part(line, '|', 1)) AS description, CAST(NULL AS DOUBLE) AS price, "
       "TRY_CAST(trim(split_part(line, '|', 2)) AS DOUBLE) AS quantity, TRY_CAST(trim(split_part(line, '|', 3)) AS DOUBLE) AS total FROM lines WHERE contains(line, '|') AND NOT starts_with(line, 'Description')"))
def invoice_items(spark, sf_dir):
    return fields.invoice_items(R.invoice_docs(spark, sf_dir))


def _matches_sql(pattern: str, column: str = "text", table: str = "documents") -> str:
    return (f"SELECT doc_id, CAST(i - 1 AS INT) AS pos, found[i] AS value FROM (SELECT doc_id, regexp_extract_all({column}, '{pattern}') AS found FROM {table}), unnest(range(1, len(found) + 1)) t(i)")


@query(_matches_sql(r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"))
def email_extract(spark, sf_dir):
    return fields.matches(R.table(spark, sf_dir, "documents"), r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}")


@query(_matches_sql(P.PHONE))
def phone_extract(spark, sf_dir):
    return fields.matches(R.table(spark, sf_dir, "documents"), P.PHONE)


@query(_matches_sql(P.CORE_PHONE))
def phone_extract_core(spark, sf_dir):
    return fields.matches(R.table(spark, sf_dir, "documents"), P.CORE_PHONE)


@query(_matches_sql(P.CORE_URL, table="pages").replace("doc_id", "page_id").replace("text", "html").replace("SELECT page_id, CAST", "SELECT page_id AS doc_id, CAST"))
def url_extract_core(spark, sf_dir):
    return fields.matches(R.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")), P.CORE_URL)


@query(R.with_ctes(R.INVOICE_SQL, lines_sql("invoice_docs"), "m AS (SELECT doc_id, pos, regexp_extract_all(line, '" + P.MONEY + "') AS found FROM lines)", query="SELECT doc_id, pos, trim(found[len(found)]) AS value FROM m WHERE len(found) > 0"))
def money_last(spark, sf_dir):
    return fields.lines(R.invoice_docs(spark, sf_dir)).select("doc_id", "pos", X.money_last(F.col("line")).alias("value")).filter("value is not null")


DATE_ASCII = P.DATE.removeprefix("(?iU)")


@query(R.with_ctes(R.INVOICE_SQL, lines_sql("invoice_docs"), "m AS (SELECT doc_id, pos, unnest(regexp_extract_all(line, '(?i)" + DATE_ASCII + "')) AS value, generate_subscripts(regexp_extract_all(line, '(?i)" + DATE_ASCII + "'), 1) AS k FROM lines),\n"
       "u AS (SELECT doc_id, value, min(pos * 1000 + k) AS o FROM m GROUP BY doc_id, value)", query="SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS INT) AS pos, value FROM u"))
def date_extract(spark, sf_dir):
    return fields.dates(R.invoice_docs(spark, sf_dir))


@query(R.with_ctes(R.INVOICE_SQL, PAIRS, query=f"SELECT doc_id, pos, {number_sql('value')} AS number FROM kv"))
def number_parse(spark, sf_dir):
    return fields.numbers(R.invoice_docs(spark, sf_dir))


def ordered_distinct_sql(docs: str) -> str:
    return R.with_ctes(docs, lines_sql("cv_docs"), "firsts AS (SELECT doc_id, arg_min(line, pos) AS line, min(pos) AS p FROM lines GROUP BY doc_id, lower(line))",
                       query="SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS INT) AS pos, line FROM firsts")


@query(ordered_distinct_sql(R.CV_SQL))
def ordered_distinct(spark, sf_dir):
    return fields.distinct_lines(R.cv_docs(spark, sf_dir))


HEADING_LIST = ", ".join(repr(h) for h in P.HEADINGS)
SECTIONS = (lines_sql("cv_docs") + f",\nmarked AS (SELECT *, ({norm_sql('line')} IN ({HEADING_LIST}) OR (len(string_split(line, ' ')) <= 3 AND upper(line) = line AND lower(line) <> line AND length(line) > 3)) AS head FROM lines),\n"
            f"named AS (SELECT *, coalesce(last_value(CASE WHEN head THEN {norm_sql('line')} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos), 'body') AS section FROM marked)")


@query(R.with_ctes(R.CV_SQL, SECTIONS, query="SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS pos, section, line FROM named WHERE NOT head"))
def sections_carry_forward(spark, sf_dir):
    return fields.sections(R.cv_docs(spark, sf_dir))


@query(R.with_ctes(R.CV_SQL, lines_sql("cv_docs"), f"h AS (SELECT *, sum(CASE WHEN {norm_sql('line')} IN ({', '.join(repr(X.plain_norm(w)) for w in dict.fromkeys(P.SECTION_WORDS))}) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS heads FROM lines WHERE pos < 12)",
                   query="SELECT doc_id, pos, line FROM h WHERE heads = 0"))
def header_lines(spark, sf_dir):
    return fields.header_lines(R.cv_docs(spark, sf_dir))


@query(R.with_ctes(R.CV_SQL, lines_sql("cv_docs"), r"p AS (SELECT doc_id, pos, list_filter(list_transform(regexp_split_to_array(trim(regexp_replace(line, '^[•*\-+\s]+', '')), '\s{2,}|[;,|]'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM lines),"
                   "\nq AS (SELECT doc_id, pos, i, parts[i] AS part FROM p, unnest(range(1, len(parts) + 1)) t(i))", query="SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, i) - 1 AS INT) AS pos, part FROM q"))
def split_list(spark, sf_dir):
    return fields.list_parts(R.cv_docs(spark, sf_dir))


@query(f"WITH lines AS (SELECT p_partkey AS doc_id, p_name || ' ' || p_type AS line FROM part) SELECT doc_id, {norm_sql('line')} AS norm, regexp_replace(lower(line), '[^a-z0-9]+', '', 'g') AS norm_text, "
       "nullif(regexp_replace(regexp_replace(lower(line), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '') AS slug FROM lines")
def normalisers(spark, sf_dir):
    line = F.concat("p_name", F.lit(" "), "p_type")
    return R.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), X.norm(line).alias("norm"), X.norm_text(line).alias("norm_text"), X.slug(line).alias("slug"))


@query("SELECT doc_id, " + norm_sql("text") + " AS norm FROM documents")
def accent_fold(spark, sf_dir):
    return R.table(spark, sf_dir, "documents").select("doc_id", X.norm(F.col("text")).alias("norm"))


def _hits_sql(doc_type: str) -> str:
    def quoted(k: str) -> str:
        return "'" + k.replace("'", "''") + "'"

    return " + ".join(f"CASE WHEN contains(lower(text), {quoted(k.lower())}) THEN 1 ELSE 0 END" for k in P.TYPE_KEYWORDS[doc_type])


MIXED = "docs AS (SELECT doc_id * 2 AS doc_id, text FROM invoice_docs UNION ALL SELECT doc_id * 2 + 1, text FROM cv_docs UNION ALL SELECT -1 - doc_id, text FROM documents)"
SCORES = "scores AS (SELECT doc_id, CAST(type_order AS INT) AS type_order, doc_type, hits, sum(hits) OVER (PARTITION BY doc_id) AS total FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, {i} AS type_order, '{t}' AS doc_type, CAST({_hits_sql(t)} AS INT) AS hits FROM docs" for i, t in enumerate(P.TYPE_KEYWORDS)) + "))"


def mixed_docs(spark, sf_dir):
    """Invoices, curricula and plain texts together."""
    a, b = R.invoice_docs(spark, sf_dir), R.cv_docs(spark, sf_dir)
    c = R.table(spark, sf_dir, "documents")
    return (a.select((F.col("doc_id") * 2).alias("doc_id"), "text").unionByName(b.select((F.col("doc_id") * 2 + 1).alias("doc_id"), "text")).unionByName(c.select((-1 - F.col("doc_id")).alias("doc_id"), "text")))


@query(R.with_ctes(R.INVOICE_SQL, R.CV_SQL, MIXED, SCORES, query="SELECT doc_id, type_order, doc_type, hits, CASE WHEN total > 0 THEN hits::DOUBLE / total ELSE 0.0 END AS share FROM scores"))
def doc_type_scores(spark, sf_dir):
    return classify.type_scores(mixed_docs(spark, sf_dir))


BEST = "best AS (SELECT doc_id, CASE WHEN max(hits) > 0 THEN arg_min(doc_type, -hits * 100 + type_order) ELSE 'unknown' END AS doc_type, CASE WHEN max(hits) > 0 THEN max(hits)::DOUBLE / max(total) ELSE 0.0 END AS confidence FROM scores GROUP BY doc_id)"


@query(R.with_ctes(R.INVOICE_SQL, R.CV_SQL, MIXED, SCORES, BEST, query="SELECT * FROM best"))
def doc_type_argmax(spark, sf_dir):
    return classify.document_type(mixed_docs(spark, sf_dir))


@query(R.with_ctes(R.INVOICE_SQL, R.CV_SQL, MIXED, SCORES, BEST, query="SELECT doc_id, CASE WHEN confidence < 0.20 THEN 'unknown' ELSE doc_type END AS doc_type, confidence FROM best"))
def doc_type_floor(spark, sf_dir):
    return classify.document_type(mixed_docs(spark, sf_dir), floor=0.20)


@query(R.with_ctes(R.INVOICE_SQL, R.CV_SQL, MIXED, SCORES, BEST, "o AS (SELECT b.doc_id, lower(d.text) AS low, contains(d.text, '|') AS tab, CASE WHEN confidence < 0.20 THEN 'unknown' ELSE doc_type END AS t FROM best b JOIN docs d USING (doc_id)),\n"
                   r"p AS (SELECT *, CASE WHEN t IN ('unknown', 'form') AND tab AND regexp_matches(low, '\b(invoice|facture|total|vat|tva|amount|montant)\b') THEN 'invoice' ELSE t END AS u FROM o)",
                   query=r"SELECT doc_id, CASE WHEN u = 'unknown' AND regexp_matches(low, '\b(experience|expérience|education|formation|skills|compétences)\b') THEN 'cv' ELSE u END AS doc_type FROM p"))
def type_override(spark, sf_dir):
    docs = mixed_docs(spark, sf_dir)
    return classify.override(docs, classify.document_type(docs, floor=0.20), F.when(F.contains("text", F.lit("|")), 1).otherwise(0))


@query(R.with_ctes("k AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}', {n}, '" + k.replace("'", "''") + "')" for i, t in enumerate(P.TYPE_KEYWORDS) for n, k in enumerate(P.TYPE_KEYWORDS[t])) + ") v(o, doc_type, n, keyword))", R.CV_SQL,
                   query="SELECT doc_id, doc_type, CAST(row_number() OVER (PARTITION BY doc_id, doc_type ORDER BY n) - 1 AS INT) AS pos, keyword FROM cv_docs, k WHERE contains(lower(text), lower(keyword)) QUALIFY row_number() OVER (PARTITION BY doc_id, doc_type ORDER BY n) <= 8"))
def type_evidence(spark, sf_dir):
    return classify.evidence(R.cv_docs(spark, sf_dir))


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{pattern}'))"


SCRIPTS = f"counts AS (SELECT doc_id, lower(text) AS low, text, {_count(P.LATIN)}::DOUBLE AS latin, {_count(P.ARABIC)}::DOUBLE AS arabic, {_count(P.CJK)}::DOUBLE AS cjk FROM docs), totals AS (SELECT *, greatest(1.0, latin + arabic + cjk) AS total FROM counts)"


@query(R.with_ctes("docs AS (SELECT doc_id, text FROM documents)", SCRIPTS, query=" UNION ALL ".join(f"SELECT doc_id, '{s}' AS script, round({s} / total, 4) AS share FROM totals" for s in ("latin", "arabic", "cjk"))))
def script_shares(spark, sf_dir):
    return classify.script_shares(R.table(spark, sf_dir, "documents"))


def _hint(lang: str) -> str:
    w, words = P.LANGUAGE_HINTS[lang]
    return "(" + " + ".join(f"CASE WHEN contains(low, '{x}') THEN 1 ELSE 0 END" for x in words) + f") * {w}::DOUBLE"


LANG = ("scored AS (" + " UNION ALL ".join(
    f"SELECT doc_id, {i} AS lang_order, '{k}' AS lang, {e} AS score FROM totals" for i, (k, e) in enumerate((
        ("ar", "arabic / total + " + _hint("ar")), ("fr", f"latin / total * 0.45::DOUBLE + {_hint('fr')} + CASE WHEN regexp_matches(text, '{P.ACCENTED}') THEN 0.35::DOUBLE ELSE 0.0 END"),
        ("en", "latin / total * 0.55::DOUBLE + " + _hint("en")), ("zh", "cjk / total + " + _hint("zh"))))) + ")")


@query(R.with_ctes("docs AS (SELECT doc_id, text FROM documents)", SCRIPTS, LANG, query="SELECT doc_id, lang_order, lang, round(score, 6) AS score FROM scored WHERE score > 0"))
def language_scores(spark, sf_dir):
    return classify.language_scores(R.table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


@query(R.with_ctes("docs AS (SELECT doc_id, text FROM documents)", SCRIPTS, LANG, "shared AS (SELECT *, round(score / sum(score) OVER (PARTITION BY doc_id), 4) AS share FROM scored WHERE score > 0)",
                   query="SELECT doc_id, coalesce(arg_min(lang, -share * 1000000 + lang_order), 'unknown') AS language, CASE WHEN arg_min(lang, -share * 1000000 + lang_order) IN ('ar', 'fa', 'he', 'ur', 'yi') THEN 'rtl' ELSE 'ltr' END AS direction, coalesce(max(share), 0.0) AS confidence "
                   "FROM docs LEFT JOIN shared USING (doc_id) GROUP BY doc_id"))
def language_rules(spark, sf_dir):
    return classify.language(R.table(spark, sf_dir, "documents"))


POINTS = (lines_sql("invoice_docs") + r", scored AS (SELECT *, (CASE WHEN regexp_matches(line, '[\w.+-]+@[\w.-]+\.\w+') THEN 3 ELSE 0 END) + (CASE WHEN regexp_matches(line, '\d') THEN 2 ELSE 0 END) + (CASE WHEN regexp_matches(lower(line), '"
          + P.POINT_WORDS + "') THEN 2 ELSE 0 END) + (CASE WHEN contains(line, ':') THEN 1 ELSE 0 END) AS s FROM lines WHERE length(line) > 3), firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY s DESC, length(line), pos) AS k FROM scored)")


@query(R.with_ctes(R.INVOICE_SQL, POINTS, query='SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, length(line), pos) - 1 AS INT) AS "rank", line FROM firsts WHERE k = 1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, length(line), pos) <= 8'))
def important_points(spark, sf_dir):
    return fields.important_points(R.invoice_docs(spark, sf_dir))


@query(R.with_ctes(R.CV_SQL, lines_sql("cv_docs"), query="SELECT doc_id, substr(string_agg(line, ' ' ORDER BY pos), 1, 700) AS summary FROM lines WHERE pos < 3 GROUP BY doc_id"))
def factual_summary(spark, sf_dir):
    return fields.factual_summary(R.cv_docs(spark, sf_dir))


def _candidate_lines(spark, sf_dir):
    """(doc_id, ls): the lines of invoices as recognised blocks have them."""
    def line(x, i):
        return F.struct(F.lit(1).alias("page"), i.cast("int").alias("pos"), x.alias("line"), F.when(i % 11 == 10, 0.6).otherwise(0.9).alias("confidence"), F.when(F.contains(x, F.lit("|")), "table_section").otherwise("paragraph").alias("block_type"))

    return R.invoice_docs(spark, sf_dir).select("doc_id", F.transform(X.nonempty_lines(F.col("text")), line).alias("ls"))


ALL = "unnest(regexp_extract_all(line, '{p}')) AS value, generate_subscripts(regexp_extract_all(line, '{p}'), 1) AS k"
SYN = "CASE k0 " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in P.FIELD_SYNONYMS.items()) + " WHEN '' THEN 'field' ELSE k0 END"


def _one(p: str, field: str, kind: str, stage: int, more: str = "") -> str:
    return f"SELECT doc_id, pos, {stage} AS stage, k, '{field}' AS field, trim(value) AS value, '{kind}' AS kind, 'ocr_pattern' AS source FROM (SELECT doc_id, pos, " + ALL.format(p=p) + f" FROM kept) {more}"


def _whole(p: str) -> str:
    return f"regexp_full_match(trim(value), '{p}')"


CAND = (lines_sql("invoice_docs") + ", kept AS (SELECT * FROM lines WHERE pos % 11 <> 10), kvs AS (SELECT doc_id, pos, trim(regexp_replace(regexp_replace(lower(trim(regexp_extract(line, '" + P.KEY_VALUE
        + "', 1))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS k0, trim(regexp_extract(line, '" + P.KEY_VALUE + "', 2)) AS value FROM kept WHERE regexp_matches(line, '" + P.KEY_VALUE + "')), money AS (SELECT doc_id, pos, line, regexp_extract_all(line, '" + P.MONEY + "') AS m FROM kept), "
        + "cells AS (SELECT doc_id, pos, i, regexp_extract_all(trim(c[i]), '" + P.MONEY + r"') AS m FROM (SELECT doc_id, pos, regexp_split_to_array(line, '\s{2,}|\t|\|') AS c FROM kept WHERE contains(line, '|')), unnest(range(1, len(c) + 1)) t(i)), "
        + "found AS (" + " UNION ALL ".join([
            _one(r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}", "email", "email", 1), _one(P.PHONE, "phone", "phone", 2, r"WHERE length(regexp_replace(value, '\D', '', 'g')) >= 7"),
            _one(r"(?i)(?:https?://)?(?:www\.)[\w.-]+\.[A-Za-z]{2,}\S*", "url", "url", 3), _one("(?i)" + P.CANDIDATE_DATE.removeprefix("(?iU)"), "date", "date", 4),
            f"SELECT doc_id, pos, 5, 1, {SYN}, value, CASE WHEN {_whole('[^@ ]+@[A-Za-z0-9.-]+[.][A-Za-z]+')} THEN 'email' WHEN {_whole('(?i)(?:https?://)?(?:www[.])[A-Za-z0-9_.-]+[.][A-Za-z]+')} THEN 'url' WHEN regexp_matches(value, '{P.MONEY}') THEN 'amount' ELSE 'string' END, 'ocr_key_value' FROM kvs WHERE value <> ''",
            "SELECT doc_id, pos, 6, 1, 'invoice_number', regexp_extract(line, '" + P.INVOICE_REFERENCE + "', 1), 'identifier', 'ocr_pattern' FROM kept WHERE (" + " OR ".join(f"contains(lower(line), '{w}')" for w in P.REFERENCE_WORDS) + ") AND regexp_extract(line, '" + P.INVOICE_REFERENCE + "', 1) <> ''",
            "SELECT doc_id, pos, 7, 1, CASE WHEN contains(lower(line), 'sub') OR contains(lower(line), 'sous') THEN 'subtotal' WHEN contains(lower(line), 'tax') OR contains(lower(line), 'vat') OR contains(lower(line), 'tva') THEN 'tax' WHEN contains(lower(line), 'total') OR contains(lower(line), 'montant') OR contains(lower(line), 'amount due') THEN 'total' ELSE 'amount' END, trim(m[len(m)]), 'amount', 'ocr_pattern' FROM money WHERE len(m) > 0",
            "SELECT doc_id, pos, 8, i, 'table_amount', trim(m[len(m)]), 'amount', 'ocr_table' FROM cells WHERE len(m) > 0"]) + "), "
        + "ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field, lower(value) ORDER BY CASE WHEN stage = 8 THEN 1 ELSE 0 END, pos, stage, k) AS n FROM found)")


@query(R.with_ctes(R.INVOICE_SQL, CAND, query="SELECT doc_id, pos, field, value, kind, source FROM ranked WHERE n = 1"))
def regex_candidates(spark, sf_dir):
    return fields.document_candidates(_candidate_lines(spark, sf_dir)).select("doc_id", "pos", "field", "value", "kind", "source")


@query(None)
def candidates_normalised(spark, sf_dir):
    return fields.document_candidates(_candidate_lines(spark, sf_dir))


def _cv_parts(spark, sf_dir):
    return exports.cv(R.cv_docs(spark, sf_dir))


def _cv_rows(spark, sf_dir, part, *inner):
    """(doc_id, pos, x) of one part's entries; the other parts are not computed."""
    return X.exploded(exports.cv(R.cv_docs(spark, sf_dir), (part,)), F.col(".".join(("data", part, *inner))), "pos", "x", "doc_id")


@query(R.with_ctes(R.CV_SQL, lines_sql("cv_docs"), query="SELECT doc_id, max(CASE WHEN pos = 0 THEN line END) AS name, max(CASE WHEN pos = 1 THEN regexp_extract(line, '[A-Za-z0-9]+@.*') END) AS email, max(CASE WHEN pos = 2 THEN substr(line, 7) END) AS phone FROM lines GROUP BY doc_id"))
def cv_contact(spark, sf_dir):
    return exports.cv(R.cv_docs(spark, sf_dir), ("personal_info",)).select("doc_id", F.col("data.personal_info.name").alias("name"), F.col("data.personal_info.contact.email").alias("email"), F.col("data.personal_info.contact.phone").alias("phone"))


@query(R.with_ctes(R.CV_SQL, lines_sql("cv_docs"), r"sk AS (SELECT doc_id, line FROM lines l WHERE pos = (SELECT min(pos) + 1 FROM lines k WHERE k.doc_id = l.doc_id AND k.line = 'Skills')), parts AS (SELECT doc_id, unnest(regexp_split_to_array(line, '\s{2,}|[;,|]')) AS p FROM sk)",
                   query="SELECT doc_id, lower(trim(p)) AS skill FROM parts WHERE trim(p) <> '' GROUP BY ALL"))
def cv_skills(spark, sf_dir):
    parts = exports.cv(R.cv_docs(spark, sf_dir), ("skills",))
    return X.exploded(parts, F.map_keys("data.skills"), "_i", "skill", "doc_id").drop("_i")


@query(R.with_ctes(R.CV_SQL, query="SELECT doc_id, CAST(i - 1 AS INT) AS pos, n AS name, l AS level FROM cv_docs, (VALUES (1, 'French', 'native'), (2, 'English', 'fluent'), (3, 'German', 'basic')) v(i, n, l)"))
def cv_languages(spark, sf_dir):
    return _cv_rows(spark, sf_dir, "languages").select("doc_id", "pos", "x.name", "x.level")


@query(R.with_ctes(R.CV_SQL, query="SELECT doc_id, CAST(i - 1 AS INT) AS pos, n AS name, l AS provider FROM cv_docs, (VALUES (1, 'Cloud Expert', 'Big Vendor'), (2, 'Scrum Master', 'Org')) v(i, n, l)"))
def cv_certifications(spark, sf_dir):
    return _cv_rows(spark, sf_dir, "certifications").select("doc_id", "pos", "x.name", "x.provider")


@query(R.with_ctes(R.CV_SQL, query="SELECT doc_id, CAST(0 AS INT) AS pos, 'Pipeline' AS name, 'Moves data daily Second' AS description FROM cv_docs"))
def cv_projects(spark, sf_dir):
    return _cv_rows(spark, sf_dir, "projects").select("doc_id", "pos", "x.name", "x.description")


@query(R.with_ctes(R.CV_SQL, query="SELECT doc_id, 0 AS pos, 'Acme ' || (doc_id % 50) AS company, (['Data Engineer', 'Software Developer', 'Project Manager'])[doc_id % 3 + 1] AS position, 'Paris, France' AS location, (2000 + doc_id % 15) || ' - ' || (2016 + doc_id % 8) AS dates, '' AS responsibilities FROM cv_docs "
                   "UNION ALL SELECT doc_id, 1, 'Other Corp', 'Consultant', NULL, '', '- Built reports for clients' FROM cv_docs UNION ALL SELECT doc_id, 2, 'More long duties done here', NULL, NULL, 'mars 2001 to mai 2003', '' FROM cv_docs"))
def cv_work(spark, sf_dir):
    rows = _cv_rows(spark, sf_dir, "work_experience")
    return rows.select("doc_id", "pos", "x.company", "x.position", "x.location", F.array_join("x.dates", ";").alias("dates"), F.array_join("x.responsibilities", ";").alias("responsibilities"))


#: The lines of one section of the curricula, numbered from 0.
def section_sql(heading: str, until: str) -> str:
    return (R.CV_SQL.strip() + ",\n" + lines_sql("cv_docs") + f""",
bounds AS (SELECT doc_id, max(CASE WHEN line = '{heading}' THEN pos END) AS a, max(CASE WHEN line = '{until}' THEN pos END) AS b FROM lines GROUP BY doc_id),
part AS (SELECT doc_id, line, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS pos FROM lines JOIN bounds USING (doc_id) WHERE pos > a AND pos < b)""")


RANGE = "'" + P.DATE_RANGE.removeprefix("(?iU)").replace("'", "''") + "'"


@query("WITH " + section_sql("Education", "Skills") + """
SELECT doc_id, 0 AS pos, max(CASE WHEN pos = 0 THEN line END) AS name, max(CASE WHEN pos = 1 THEN line END) AS university,
  coalesce(string_agg(regexp_extract(line, '[0-9]{4}'), ';' ORDER BY pos) FILTER (WHERE regexp_matches(line, '[0-9]{4}')), '') AS dates
FROM part GROUP BY doc_id""")
def cv_education(spark, sf_dir):
    rows = _cv_rows(spark, sf_dir, "education", "formation")
    return rows.select("doc_id", "pos", "x.name", "x.university", F.array_join("x.dates", ";").alias("dates"))


@query(R.with_ctes(R.INVOICE_SQL, query="SELECT doc_id, 'Acme Trading Ltd' AS vendor, '+33 12 34 45 ' || lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0') || ' 78' AS phone, CASE WHEN doc_id % 3 = 0 THEN 'sales@acme.example.com' ELSE 'client' || o_custkey || '@example.com' END AS email, '12 rue de Paris' AS street, '12 rue de Paris' AS city, "
                   "'Payment by transfer' AS method, 'net' AS conditions, '1234 5678 9012 ' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') AS account_number FROM invoice_docs JOIN orders ON doc_id = o_orderkey"))
def invoice_parties(spark, sf_dir):
    d = exports.invoice_parties(R.invoice_docs(spark, sf_dir))
    return d.select("doc_id", F.col("vendor.name").alias("vendor"), "client.phone", "client.email", "client.address.street", "client.address.city", "payment.method", "payment.conditions", "payment.account_number")


@query(None)
def export_by_type(spark, sf_dir):
    return exports.route(classify.with_type(mixed_docs(spark, sf_dir)))


@query(None)
def generic_export(spark, sf_dir):
    return exports.as_json(exports.generic(R.table(spark, sf_dir, "documents").select("doc_id", "text")))


def _invoice_values(spark, sf_dir):
    """Leaves of some fields: the client's name, a wrong total, a short value."""
    o = R.table(spark, sf_dir, "orders")
    rows = F.array(*[F.struct(F.lit(p).alias("path"), v.alias("value")) for p, v in (
        ("client", F.concat(F.lit("CLIENT-"), F.col("o_custkey").cast("string"))), ("number", F.concat(F.lit("INV-"), (F.col("o_orderkey") + F.col("o_orderkey") % 2).cast("string"))), ("code", F.lit("zz")),
        ("vendor", F.lit("Acme Trading Ltx")), ("arabic", F.lit("فاتورة")))])
    return o.select(F.col("o_orderkey").alias("doc_id"), F.inline(rows))


VALUES_SQL = ("vals AS (SELECT o_orderkey AS doc_id, 'client' AS path, 'CLIENT-' || o_custkey AS value FROM orders UNION ALL SELECT o_orderkey, 'number', 'INV-' || (o_orderkey + o_orderkey % 2) FROM orders UNION ALL SELECT o_orderkey, 'code', 'zz' FROM orders "
              "UNION ALL SELECT o_orderkey, 'vendor', 'Acme Trading Ltx' FROM orders UNION ALL SELECT o_orderkey, 'arabic', 'فاتورة' FROM orders), "
              "n AS (SELECT v.*, regexp_replace(lower(value), '[^a-z0-9]+', '', 'g') AS nv, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS ns FROM vals v JOIN invoice_docs USING (doc_id)), "
              "g AS (SELECT *, (length(value) < 3 OR contains(ns, nv) OR (length(nv) > 10 AND (contains(ns, substr(nv, 1, 10)) OR contains(ns, right(nv, 10))))) AS grounded FROM n)")


@query(R.with_ctes(R.INVOICE_SQL, VALUES_SQL, query="SELECT doc_id, path, value, grounded FROM g"))
def grounding_check(spark, sf_dir):
    return grounding.verify(_invoice_values(spark, sf_dir), R.invoice_docs(spark, sf_dir))


@query(R.with_ctes(R.INVOICE_SQL, VALUES_SQL, query="SELECT doc_id, path, value FROM g WHERE grounded"))
def remove_ungrounded(spark, sf_dir):
    return grounding.drop_ungrounded(grounding.verify(_invoice_values(spark, sf_dir), R.invoice_docs(spark, sf_dir)))


@query(R.with_ctes(R.INVOICE_SQL, VALUES_SQL, query="SELECT doc_id, bool_and(grounded) AS is_grounded FROM g GROUP BY doc_id"))
def document_grounded(spark, sf_dir):
    return grounding.all_grounded(grounding.verify(_invoice_values(spark, sf_dir), R.invoice_docs(spark, sf_dir)))


def _invoice_regions(spark, sf_dir):
    return fields.lines(R.invoice_docs(spark, sf_dir)).select("doc_id", F.lit(1).alias("page"), F.col("pos").alias("region_idx"), F.col("line").alias("text"), ((F.col("pos") % 10) / F.lit(10.0)).alias("confidence"))


EVIDENCE = (VALUES_SQL + ", " + lines_sql("invoice_docs") + ", hits AS (SELECT n.doc_id, n.path, min(l.pos) AS region_idx FROM n JOIN lines l ON n.doc_id = l.doc_id AND nv <> '' AND contains(regexp_replace(lower(l.line), '[^a-z0-9]+', '', 'g'), nv) GROUP BY n.doc_id, n.path), "
            "ev AS (SELECT n.doc_id, n.path, n.value, CASE WHEN region_idx IS NULL THEN 'document_text' ELSE 'region' END AS source, CAST(region_idx AS INT) AS region_idx, CASE WHEN region_idx IS NULL THEN 1.0 ELSE (region_idx % 10) / 10.0::DOUBLE END AS confidence FROM n LEFT JOIN hits h ON n.doc_id = h.doc_id AND n.path = h.path WHERE contains(ns, nv))")


@query(R.with_ctes(R.INVOICE_SQL, EVIDENCE, query="SELECT * FROM ev"))
def evidence_first_region(spark, sf_dir):
    return grounding.evidence(_invoice_values(spark, sf_dir), R.invoice_docs(spark, sf_dir), _invoice_regions(spark, sf_dir))


@query(R.with_ctes(R.INVOICE_SQL, EVIDENCE, query="SELECT v.doc_id, v.path, v.value, CASE WHEN e.path IS NULL THEN 'suggested' ELSE 'verified' END AS status, coalesce(e.confidence, 0.5) AS confidence FROM vals v LEFT JOIN ev e ON v.doc_id = e.doc_id AND v.path = e.path"))
def field_status_confidence(spark, sf_dir):
    v = _invoice_values(spark, sf_dir)
    return grounding.fields(v, grounding.evidence(v, R.invoice_docs(spark, sf_dir), _invoice_regions(spark, sf_dir)))


@query(R.with_ctes(R.INVOICE_SQL, VALUES_SQL, query="SELECT doc_id, path, CASE WHEN path <> 'code' AND (contains(lower(text), lower(value)) OR (path = 'vendor' AND doc_id % 2 = 0)) THEN value END AS value, CASE WHEN path = 'code' THEN 'integer' ELSE 'string' END AS data_type FROM n JOIN invoice_docs USING (doc_id)"))
def hallucination_filter(spark, sf_dir):
    v = _invoice_values(spark, sf_dir).withColumn("data_type", F.when(F.col("path") == "code", "integer").otherwise("string"))
    known = R.table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("doc_id"), F.lit("ACME trading ltx").alias("value"))
    return grounding.without_invention(v, R.invoice_docs(spark, sf_dir), known)


@query("WITH a AS (SELECT o_orderkey AS doc_id, 'k' || (o_orderkey % 3) AS path, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'first' END AS value FROM orders), b AS (SELECT o_orderkey AS doc_id, 'k' || (o_orderkey % 4) AS path, 'second' AS value FROM orders) "
       "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.path, b.path) AS path, coalesce(nullif(a.value, ''), b.value) AS value FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.path = b.path")
def gap_fill_merge(spark, sf_dir):
    o = R.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    first = o.select(k.alias("doc_id"), F.concat(F.lit("k"), (k % 3).cast("string")).alias("path"), F.when(k % 2 == 0, "").otherwise("first").alias("value"))
    return grounding.fill_gaps(first, o.select(k.alias("doc_id"), F.concat(F.lit("k"), (k % 4).cast("string")).alias("path"), F.lit("second").alias("value")))


@query(R.with_ctes(R.INVOICE_SQL, lines_sql("invoice_docs"), r"p AS (SELECT doc_id, pos, string_split(line, '|') AS r, max(len(string_split(line, '|'))) OVER (PARTITION BY doc_id) AS w FROM lines)",
                   query="SELECT doc_id, pos AS \"row\", CAST(i AS INT) AS col, coalesce(trim(r[i + 1]), '') AS cell FROM p, unnest(range(0, w)) t(i)"))
def table_from_spacing(spark, sf_dir):
    docs = R.invoice_docs(spark, sf_dir).withColumn("text", F.replace("text", F.lit(" | "), F.lit("\t")))
    return layout.table_by_spacing(docs)


@query("SELECT event_id AS doc_id, 0 AS pos, 'k' AS path, CAST(json_extract(props, '$.k') AS VARCHAR) AS value, 'integer' AS data_type FROM events")
def flatten_json(spark, sf_dir):
    return eav.flatten_json(R.table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("json")))


@query(None)
def flatten_cv_export(spark, sf_dir):
    return eav.flatten_json(exports.as_json(_cv_parts(spark, sf_dir)))


@query(R.with_ctes(R.INVOICE_SQL, PAIRS, "last AS (SELECT doc_id, key, arg_max(value, pos) AS value, min(pos) AS pos FROM kv GROUP BY doc_id, key)", query="SELECT d.doc_id, coalesce(max(CASE WHEN key = 'terms' THEN value END), arg_min(CASE WHEN contains(key, 'terms') THEN value END, CASE WHEN contains(key, 'terms') THEN pos END)) AS terms, "
                   "coalesce(max(CASE WHEN key = 'montant' THEN value END), max(CASE WHEN key = 'total' THEN value END), arg_min(CASE WHEN contains(key, 'total') THEN value END, CASE WHEN contains(key, 'total') THEN pos END)) AS amount FROM invoice_docs d LEFT JOIN last USING (doc_id) GROUP BY d.doc_id"))
def priority_key(spark, sf_dir):
    kv = R.invoice_docs(spark, sf_dir).select("doc_id", D.last_wins(D.pairs(X.nonempty_lines(F.col("text")))).alias("kv"))
    return kv.select("doc_id", D.first_key(F.col("kv"), ("terms",)).alias("terms"), D.first_key(F.col("kv"), ("montant", "total")).alias("amount"))


GROUPS = section_sql("Experience", "Education") + f""", marked AS (
  SELECT *, regexp_matches(line, {RANGE}, 'i') AS dated, regexp_matches(line, '^[-•*]') AS bullet FROM part
), g AS (
  SELECT doc_id, pos AS k, 0 AS entry, 0 AS pos, line, 1 AS n FROM marked WHERE pos = 0
  UNION ALL
  SELECT m.doc_id, m.pos, CASE WHEN fresh THEN entry + 1 ELSE entry END, CASE WHEN fresh THEN 0 ELSE n END, m.line, CASE WHEN fresh THEN 1 WHEN m.dated THEN 0 ELSE n + 1 END
  FROM (SELECT g.doc_id, g.k, entry, n, n = 0 OR (n >= 5 AND NOT m.dated AND NOT m.bullet) AS fresh FROM g JOIN marked m ON m.doc_id = g.doc_id AND m.pos = g.k + 1) q
  JOIN marked m ON m.doc_id = q.doc_id AND m.pos = q.k + 1
)"""


@query("WITH RECURSIVE " + GROUPS + " SELECT doc_id, entry, pos, line FROM g")
def entry_groups(spark, sf_dir):
    ss = R.cv_docs(spark, sf_dir).select("doc_id", D.labelled_sections(X.nonempty_lines(F.col("text"))).alias("ss"))
    return fields.entry_groups(ss.select("doc_id", D.fuzzy_section(F.col("ss"), ("experience",)).alias("lines")))
