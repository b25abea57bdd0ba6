"""Per-type schemas from typed blocks: curricula, invoices, legal and generic documents.

Input rows are (doc_id, blocks), blocks being an array, in reading order, of
struct(block_type, lines array<string>, confidence).  ``text_blocks`` makes them
from plain text.  Everything is an expression over the row; ``cv_of_texts`` and
``invoice_of_texts`` give what the blocks of plain texts give, and take texts of
ASCII and Latin-1's letters in batches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import patterns as P
from ..functions import text as X
from ..functions import whole as B

BLOCKS = "array<struct<block_type:string,lines:array<string>,confidence:double>>"
ENTRY = "struct<title:string,organization:string,date_range:string,location:string,description:array<string>,bullets:array<string>>"


def blocks_of(text: Column) -> Column:
    """A line that names a section opens a block of that section's type; what comes before is a paragraph."""
    types = F.create_map(*[F.lit(x) for kv in P.SECTION_TYPES.items() for x in kv])

    def block(head: Column, first: Column, said: Column, is_head: Column) -> Column:
        kind = F.when(is_head, F.coalesce(types[X.section_of(head)], F.lit("paragraph"))).otherwise("paragraph")
        return F.struct(kind.alias("block_type"), F.when(is_head, F.concat(F.array(head), said)).otherwise(said).alias("lines"), F.lit(1.0).alias("confidence"))

    def of(ls: Column) -> Column:
        return F.filter(D.stretches(ls, X.is_section_heading, block), lambda b: F.size(b["lines"]) > 0)

    return X.bind(X.nonempty_lines(text), of)


def text_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, blocks) of plain texts."""
    return docs.select("doc_id", blocks_of(F.col("text")).alias("blocks"))


def lines_of(blocks: Column) -> Column:
    return F.filter(F.flatten(F.transform(blocks, lambda b: F.transform(b["lines"], X.strip))), lambda x: x != "")


def section_lines(blocks: Column, *types: str) -> Column:
    """Lines of blocks of these types, without headings."""
    return F.filter(F.flatten(F.transform(F.filter(blocks, lambda b: b["block_type"].isin(*types)), lambda b: b["lines"])), lambda x: ~X.is_section_heading(x))


def section_text(blocks: Column, *types: str) -> Column:
    return F.nullif(F.trim(F.array_join(section_lines(blocks, *types), "\n")), F.lit(""))


def section_items(blocks: Column, *types: str) -> Column:
    """The distinct parts of a section's lines, bullets off."""
    clean = F.filter(F.transform(section_lines(blocks, *types), lambda x: F.trim(F.regexp_replace(x, P.BULLET, ""))), lambda x: (x != "") & ~X.is_section_heading(x))
    return X.unique(F.flatten(F.transform(clean, lambda x: F.split(x, "(?U)\\s{2,}|[|;,]"))))


def header(ls: Column) -> Column:
    """Of the first twelve lines, those before a section heading."""
    first = F.slice(ls, 1, 12)
    stop = F.array_position(F.transform(first, X.is_section_heading), F.lit(True))
    return F.when(stop > 0, F.slice(first, F.lit(1), (stop - 1).cast("int"))).otherwise(first)


def person_name(head: Column) -> Column:
    def fits(x: Column) -> Column:
        n = F.size(X.words(x))
        return ~X.has_contact_signal(x) & ~F.rlike(x, F.lit("(?U)\\d")) & (n >= 2) & (n <= 4) & (F.char_length(x) <= 60)

    return F.try_element_at(F.filter(head, fits), F.lit(1))


def headline(head: Column, name: Column) -> Column:
    return F.try_element_at(F.filter(head, lambda x: ~x.eqNullSafe(name) & ~X.has_contact_signal(x) & ~F.rlike(x, F.lit("(?U)\\d"))), F.lit(1))


def contact(ls: Column, blocks: Column) -> Column:
    """email, phone, urls, location and the contact block's lines."""
    own = section_lines(blocks, "contact_section")
    every = lambda p, xs: X.unique(F.flatten(F.transform(xs, lambda x: X.all_matches(p, x))))
    place = F.filter(F.concat(own, F.slice(ls, 1, 12)), lambda x: F.contains(x, F.lit(",")) & ~F.rlike(x, F.lit(P.EMAIL)) & ~F.rlike(x, F.lit(P.CORE_DATE_RANGE)))
    return F.struct(F.try_element_at(every(P.EMAIL, ls), F.lit(1)).alias("email"), F.try_element_at(every(P.CORE_PHONE, ls), F.lit(1)).alias("phone"),
                    every(P.CORE_URL, F.filter(ls, lambda x: ~F.rlike(x, F.lit(P.EMAIL)))).alias("urls"), F.try_element_at(place, F.lit(1)).alias("location"), own.alias("raw_contact_lines"))


def is_entry_title(text: Column, education: bool) -> Column:
    """Up to ten words without a comma or a closing mark: a degree or mostly capitals for schools; a role, or few words in capitals, for work."""
    ws, low = X.words(text), F.lower(text)
    letters = F.transform(ws, lambda w: F.regexp_replace(w, "[^A-Za-zÀ-ÖØ-öø-ÿ]", ""))
    titled = F.size(F.filter(letters, lambda w: (w != "") & (F.upper(F.substring(w, 1, 1)) == F.substring(w, 1, 1))))
    ratio = titled / F.greatest(F.lit(1), F.size(ws))
    plain = (F.size(ws) >= 1) & (F.size(ws) <= 10) & ~F.contains(text, F.lit(",")) & ~F.rlike(low, F.lit("[.;:]$"))
    if education:
        return plain & (F.rlike(low, F.lit(P.DEGREES)) | (ratio >= 0.55))
    return plain & ~F.coalesce(F.get(X.words(low), F.lit(0)).isin(*P.ACTION_STARTERS), F.lit(False)) & (X.contains_any(low, P.ROLE_WORDS) | ((ratio >= 0.78) & (F.size(ws) <= 5)))


def entries(ls: Column, education: bool) -> Column:
    """The entries of a section's lines: title, organisation, date range with place, bullets, description.

    A line opens an entry if it is no bullet, has no date range, is at most 90 long, and
    there is no entry yet, or the last one has a body or both date and organisation and
    the line looks like a title.
    """
    none = F.lit(None).cast(ENTRY)
    start = F.struct(F.array().cast(f"array<{ENTRY}>").alias("done"), none.alias("open"))

    def entry(title: Column, organization: Column, date: Column, place: Column, description: Column, bullets: Column) -> Column:
        return F.struct(title.alias("title"), organization.alias("organization"), date.alias("date_range"), place.alias("location"), description.alias("description"), bullets.alias("bullets"))

    empty, null = F.array().cast("array<string>"), F.lit(None).cast("string")

    def step(acc: Column, x: Column) -> Column:
        o = acc["open"]
        date = F.nullif(F.regexp_extract(x, P.CORE_DATE_RANGE, 0), F.lit(""))
        bullet, clean = F.rlike(x, F.lit(P.BULLET)), F.trim(F.regexp_replace(x, P.BULLET, ""))
        ready = (o["date_range"].isNotNull() & o["organization"].isNotNull()) | (F.size(o["description"]) > 0) | (F.size(o["bullets"]) > 0)
        opens = ~bullet & date.isNull() & (F.char_length(x) <= 90) & (o.isNull() | (F.coalesce(ready, F.lit(False)) & is_entry_title(x, education)))
        done = F.when(o.isNotNull(), F.concat(acc["done"], F.array(o))).otherwise(acc["done"])
        rest = F.nullif(F.regexp_replace(F.trim(F.replace(x, date, F.lit(""))), "^[,;:\\s-]+|[,;:\\s-]+$", ""), F.lit(""))
        title, org, when, place = (F.when(o.isNotNull(), o[k]).otherwise(null) for k in ("title", "organization", "date_range", "location"))
        described, bulleted = (F.when(o.isNotNull(), o[k]).otherwise(empty) for k in ("description", "bullets"))
        after = (F.when(date.isNotNull(), entry(title, org, date, F.coalesce(rest, place), described, bulleted))
                 .when(bullet, entry(title, org, when, place, described, F.concat(bulleted, F.array(clean))))
                 .when(org.isNull(), entry(title, x, when, place, described, bulleted))
                 .otherwise(entry(title, org, when, place, F.concat(described, F.array(x)), bulleted)))
        return F.when(opens, F.struct(done.alias("done"), entry(x, null, null, null, empty, empty).alias("open"))).otherwise(F.struct(acc["done"].alias("done"), after.alias("open")))

    return F.aggregate(ls, start, step, lambda acc: F.when(acc["open"].isNotNull(), F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def strengths(blocks: Column) -> Column:
    """Pairs of lines: a title, and its description."""
    own = section_lines(blocks, "strengths_section")

    def of(ls: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(ls) - 1, F.lit(2)), lambda i: F.struct(F.get(ls, i).alias("title"), F.coalesce(F.get(ls, i + 1), F.lit("")).alias("description")))
        return F.when(F.size(ls) > 0, pairs).otherwise(F.array().cast("array<struct<title:string,description:string>>"))

    return X.bind(own, of)


def party(ls: Column, labels: Sequence[str]) -> Column:
    """After the first line with a label: up to six lines before a section heading; the first is the name."""
    at = F.array_position(F.transform(ls, lambda x: X.contains_any(F.lower(x), labels)), F.lit(True)).cast("int")
    near = F.slice(ls, at + 1, F.lit(6))
    stop = F.array_position(F.transform(near, X.is_section_heading), F.lit(True)).cast("int")
    kept = F.when(at == 0, F.array().cast("array<string>")).when(stop > 0, F.slice(near, F.lit(1), stop - 1)).otherwise(near)
    return F.struct(F.try_element_at(kept, F.lit(1)).alias("name"), kept.alias("raw_lines"))


def plain_pairs(ls: Column) -> Column:
    """Pairs as an invoice's schema names them: keys not folded, repeats numbered."""
    rows = F.transform(F.filter(ls, lambda x: F.contains(x, F.lit(":"))), lambda x, i: F.struct(
        F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.substring_index(x, ":", 1))), "[^a-z0-9]+", "_"), "^_+|_+$", "").alias("key"), X.strip(F.regexp_replace(x, "^[^:]*:", "")).alias("value"), i.cast("int").alias("pos")))
    return D.suffixed(F.filter(rows, lambda p: (p["key"] != "") & (p["value"] != "")))


def cv_data(b: Column, parts: Sequence[str] | None = None) -> Column:
    """A curriculum's schema as a struct; all of its parts, or those named."""
    def of(ls: Column, head: Column, name: Column) -> Column:
        made = {
            "person": lambda: F.struct(name.alias("name"), headline(head, name).alias("headline")), "contact": lambda: contact(ls, b), "summary": lambda: section_text(b, "summary_section"),
            "skills": lambda: section_items(b, "skills_section"), "experience": lambda: entries(section_lines(b, "experience_section"), False), "education": lambda: entries(section_lines(b, "education_section"), True),
            "languages": lambda: section_items(b, "languages_section"), "strengths": lambda: strengths(b)}
        return F.struct(F.lit("cv").alias("document_type"), *[make().alias(name) for name, make in made.items() if parts is None or name in parts])

    return X.bind(lines_of(b), lambda ls: X.bind(header(ls), lambda head: X.bind(person_name(head), lambda name: of(ls, head, name))))


def invoice_data(b: Column, parts: Sequence[str] | None = None) -> Column:
    """An invoice's schema as a struct; all of its parts, or those named."""
    def of(ls: Column, kv: Column) -> Column:
        key = lambda *names: D.first_key(kv, names)
        made = {
            "invoice_number": lambda: key("invoice no", "invoice number", "invoice", "inv"), "issue_date": lambda: key("date", "issue date", "invoice date"), "due_date": lambda: key("due date"),
            "seller": lambda: party(ls, ("from", "seller", "vendor", "supplier")), "buyer": lambda: party(ls, ("billed to", "bill to", "customer", "client")), "line_items": lambda: section_lines(b, "table_section", "invoice_items_section"),
            "totals": lambda: F.struct(key("subtotal", "sub total").alias("subtotal"), key("tax", "vat", "gst", "hst").alias("tax"), key("total", "amount due", "balance due", "grand total").alias("total")),
            "payment": lambda: F.struct(key("payment status", "status").alias("status"), key("payment terms", "terms").alias("terms")), "verified_fields": lambda: kv}
        return F.struct(F.lit("invoice").alias("document_type"), *[make().alias(name) for name, make in made.items() if parts is None or name in parts])

    return X.bind(lines_of(b), lambda ls: X.bind(plain_pairs(ls), lambda kv: of(ls, kv)))


def cv(rows: DataFrame, parts: Sequence[str] | None = None) -> DataFrame:
    """(doc_id, data); ``parts`` names the parts to compute, all without it."""
    return rows.select("doc_id", cv_data(F.col("blocks"), parts).alias("data"))


def invoice(rows: DataFrame) -> DataFrame:
    """(doc_id, data)."""
    return rows.select("doc_id", invoice_data(F.col("blocks")).alias("data"))


CV_TYPES = {
    "document_type": "string", "person": "struct<name:string,headline:string>", "contact": "struct<email:string,phone:string,urls:array<string>,location:string,raw_contact_lines:array<string>>", "summary": "string",
    "skills": "array<string>", "experience": f"array<{ENTRY}>", "education": f"array<{ENTRY}>", "languages": "array<string>", "strengths": "array<struct<title:string,description:string>>"}
_PARTY = "struct<name:string,raw_lines:array<string>>"
INVOICE_TYPES = {
    "document_type": "string", "invoice_number": "string", "issue_date": "string", "due_date": "string", "seller": _PARTY, "buyer": _PARTY, "line_items": "array<string>", "totals": "struct<subtotal:string,tax:string,total:string>",
    "payment": "struct<status:string,terms:string>", "verified_fields": "array<struct<key:string,value:string,pos:int>>"}


def _struct(kinds: dict[str, str], parts: Sequence[str] | None) -> str:
    return "struct<" + ",".join(f"{k}:{v}" for k, v in kinds.items() if parts is None or k in ("document_type", *parts)) + ">"


def cv_of_texts(docs: DataFrame, parts: Sequence[str] | None = None) -> DataFrame:
    """(doc_id, data) of plain texts; ``parts`` names the parts to compute, all without it."""
    made = B.of_latin(F.col("text"), _struct(CV_TYPES, parts), lambda t: B.schema_cv(t, parts), lambda t: X.bind(blocks_of(t), lambda b: cv_data(b, parts)))
    return docs.select("doc_id", made.alias("data"))


def invoice_of_texts(docs: DataFrame, parts: Sequence[str] | None = None) -> DataFrame:
    """(doc_id, data) of plain texts; ``parts`` names the parts to compute, all without it."""
    made = B.of_latin(F.col("text"), _struct(INVOICE_TYPES, parts), lambda t: B.schema_invoice(t, parts), lambda t: X.bind(blocks_of(t), lambda b: invoice_data(b, parts)))
    return docs.select("doc_id", made.alias("data"))


def legal(rows: DataFrame) -> DataFrame:
    """(doc_id, data): at most 12 parties and 24 clauses, as the schema has it."""
    b = F.col("blocks")
    r = rows.withColumn("ls", lines_of(b))
    ls = F.col("ls")
    clauses = F.filter(F.transform(F.filter(b, lambda x: x["block_type"].isin("legal_clause", "paragraph")), lambda x: F.struct(F.get(x["lines"], F.lit(0)).alias("heading"), F.array_join(x["lines"], "\n").alias("text"))),
                       lambda c: F.char_length(c["text"]) > 80)
    dates = F.filter(F.transform(ls, lambda x: F.regexp_extract(x, P.CORE_DATE, 0)), lambda x: x != "")
    return r.select("doc_id", F.struct(
        F.try_element_at(F.filter(F.slice(ls, 1, 10), lambda x: F.size(X.words(x)) >= 2), F.lit(1)).alias("title"), D.line_containing(ls, ("reference", "agreement ref", "contract ref")).alias("reference"),
        F.try_element_at(dates, F.lit(1)).alias("effective_date"), F.slice(F.filter(ls, lambda x: X.contains_any(F.lower(x), P.LEGAL_PARTY_MARKS)), 1, 12).alias("parties"), F.slice(clauses, 1, 24).alias("clauses"),
        F.filter(ls, lambda x: X.contains_any(F.lower(x), ("signature", "signed"))).alias("signatures")).alias("data"))


def generic(rows: DataFrame) -> DataFrame:
    """(doc_id, data): at most 25 important lines, as the schema has it."""
    b = F.col("blocks")
    r = rows.withColumn("ls", lines_of(b))
    ls = F.col("ls")
    raw = F.transform(b, lambda x, i: F.struct(i.alias("block_id"), x["block_type"].alias("type"), F.array_join(x["lines"], "\n").alias("text"), F.round(x["confidence"], 4).alias("confidence")))
    return r.select("doc_id", F.struct(F.try_element_at(F.filter(ls, lambda x: F.size(X.words(x)) >= 2), F.lit(1)).alias("title"), plain_pairs(ls).alias("fields"), F.slice(ls, 1, 25).alias("important_lines"), raw.alias("raw_sections")).alias("data"))
