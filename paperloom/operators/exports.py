"""Typed exports of whole documents: curricula, invoices, generic ones; long-form fields (doc_id, path, value) or JSON.

Each is one projection over the lines of a document in its row.  The ``*_data`` functions
are expressions of any text; the exports take texts of ASCII and Latin-1's letters in batches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import patterns as P
from ..functions import text as X
from ..functions import whole as B
from .fields import pipe_table, table_items

def education(sections: Column) -> Column:
    """name, university and dates of each entry."""
    groups = D.entry_groups(D.fuzzy_section(sections, ("education", "formation", "études", "etudes")))

    def entry(g: Column) -> Column:
        return X.bind(X.date_ranges(g), lambda d: X.bind(F.filter(g, lambda x: ~F.array_contains(d, x)), lambda rest: F.struct(
            F.try_element_at(rest, F.lit(1)).alias("name"), F.try_element_at(rest, F.lit(2)).alias("university"), d.alias("dates"))))

    return F.transform(groups, entry)


def work(sections: Column) -> Column:
    """company, position, location, dates and responsibilities of each entry."""
    groups = D.entry_groups(D.fuzzy_section(sections, ("experience", "work experience", "expérience", "expériences", "emploi")))

    def entry(g: Column) -> Column:
        def of(d: Column, rest: Column) -> Column:
            third = F.try_element_at(rest, F.lit(3))
            return F.struct(F.try_element_at(rest, F.lit(1)).alias("company"), F.try_element_at(rest, F.lit(2)).alias("position"), F.when(X.looks_location(third), third).alias("location"), d.alias("dates"),
                            F.filter(F.slice(rest, F.lit(4), F.greatest(F.size(rest), F.lit(0))), lambda x: F.char_length(x) > 12).alias("responsibilities"))

        return X.bind(X.date_ranges(g), lambda d: X.bind(F.filter(g, lambda x: ~F.array_contains(d, x)), lambda rest: of(d, rest)))

    return F.transform(groups, entry)


def languages(sections: Column) -> Column:
    """name and level of each language: cut at the first colon, else at the first dash, else after the first word."""
    def entry(x: Column) -> Column:
        parts = [F.trim(F.when(F.contains(x, F.lit(":")), F.regexp_extract(x, "^([^:]*):(.*)$", i)).when(F.contains(x, F.lit("-")), F.regexp_extract(x, "^([^-]*)-(.*)$", i))
                        .otherwise(F.regexp_extract(x, "(?U)^(\\S+)\\s*(.*)$", i))) for i in (1, 2)]
        return F.struct(parts[0].alias("name"), parts[1].alias("level"))

    return F.filter(F.transform(D.section_list(sections, ("languages", "langues")), entry), lambda e: e["name"] != "")


def certifications(sections: Column) -> Column:
    """name and provider: cut at the first dash between spaces, else at the first comma."""
    def entry(x: Column) -> Column:
        dash, comma = F.contains(x, F.lit(" - ")), F.contains(x, F.lit(","))
        name = F.when(dash, F.substring_index(x, " - ", 1)).when(comma, F.substring_index(x, ",", 1)).otherwise(x)
        rest = F.when(dash, F.regexp_extract(x, "^.*? - (.*)$", 1)).when(comma, F.regexp_extract(x, "^[^,]*,(.*)$", 1)).otherwise("")
        return F.struct(F.trim(name).alias("name"), F.trim(rest).alias("provider"))

    return F.filter(F.transform(D.fuzzy_section(sections, ("certifications", "certificats", "certification")), entry), lambda e: e["name"] != "")


def projects(sections: Column) -> Column:
    return F.transform(D.entry_groups(D.fuzzy_section(sections, ("projects", "projets"))),
                       lambda g: F.struct(F.get(g, F.lit(0)).alias("name"), F.array_join(F.slice(g, F.lit(2), F.size(g)), " ").alias("description")))


def _skills(ss: Column) -> Column:
    names = F.array_distinct(F.transform(D.section_list(ss, ("skills", "compétences", "competences")), lambda x: F.lower(x)))
    return F.map_from_entries(F.transform(names, lambda x: F.struct(x, F.lit(True))))


#: a curriculum's parts, of its lines and sections
CV_PARTS = {
    "personal_info": lambda ls, ss: F.struct(D.candidate_name(ls).alias("name"), D.contact(ls).alias("contact"), D.section_list(ss, ("hobbies", "centres d'intérêt", "interests")).alias("hobbies")),
    "education": lambda ls, ss: F.struct(education(ss).alias("formation")), "work_experience": lambda ls, ss: work(ss), "skills": lambda ls, ss: _skills(ss),
    "languages": lambda ls, ss: languages(ss), "certifications": lambda ls, ss: certifications(ss), "projects": lambda ls, ss: projects(ss),
}


def cv_data(text: Column, parts: Sequence[str] | None = None) -> Column:
    """A curriculum's parts as a struct; all of them, or those named."""
    def of(ls: Column, ss: Column) -> Column:
        return F.struct(*[part(ls, ss).alias(name) for name, part in CV_PARTS.items() if parts is None or name in parts])

    return X.bind(X.nonempty_lines(text), lambda ls: X.bind(D.labelled_sections(ls, headings=True), lambda ss: of(ls, ss)))


def invoice_data(text: Column) -> Column:
    """An invoice's parts as a struct; a table drawn with | gives the items."""
    def totals(kv: Column, items: Column) -> Column:
        amount = lambda *keys: X.number(D.first_value(kv, keys))
        summed = F.nullif(F.aggregate(items, F.lit(0.0), lambda a, i: a + F.coalesce(i["total"], F.lit(0.0))), F.lit(0.0))
        found = F.struct(F.coalesce(amount("subtotal", "sous_total", "sub_total"), summed).alias("subtotal"), amount("tax", "vat", "tva").alias("tax"), amount("total", "grand_total", "amount_due", "montant_total").alias("total"))
        return X.bind(found, lambda t: F.struct(t["subtotal"].alias("subtotal"), t["tax"].alias("tax"), F.coalesce(t["total"], t["subtotal"] + t["tax"]).alias("total")))

    def of(ls: Column, kv: Column, items: Column) -> Column:
        who = _parties(ls, kv)
        return F.struct(who["vendor"].alias("vendor"), who["client"].alias("client"), items.alias("items"), totals(kv, items).alias("totals"), who["payment"].alias("payment"))

    return X.bind(X.nonempty_lines(text), lambda ls: X.bind(F.struct(D.last_wins(D.pairs(ls)).alias("kv"), table_items(pipe_table(ls)).alias("items")), lambda b: of(ls, b["kv"], b["items"])))


def _parties(ls: Column, kv: Column) -> dict[str, Column]:
    """Vendor, client and payment of an invoice's lines and pairs."""
    first = lambda p: F.try_element_at(F.filter(ls, lambda x: F.rlike(x, F.lit(p))), F.lit(1))
    name = F.coalesce(D.party_name(ls, ("vendor", "seller", "from", "émetteur", "fournisseur")), D.company_like(ls))
    due = F.coalesce(D.first_value(kv, ("due_date", "date_d_echeance", "échéance", "echeance")), D.line_containing(ls, ("sous 30 jours", "due", "échéance", "echeance")))
    where = F.struct(first(P.STREET).alias("street"), first(P.CITY).alias("city"))
    return {"vendor": F.struct(name.alias("name"), D.line_containing(ls, ("attention", "à l'attention", "a l'attention")).alias("attention_of")),
            "client": X.bind(D.contact(ls), lambda who: F.struct(who["phone"].alias("phone"), who["email"].alias("email"), where.alias("address"))),
            "payment": F.struct(D.line_containing(ls, ("paiement", "payment", "payable", "ordre de")).alias("method"), D.first_value(kv, ("conditions", "terms", "payment_terms", "conditions_de_paiement")).alias("conditions"),
                                D.account_number(ls).alias("account_number"), due.alias("due_date"))}


def parties_data(text: Column) -> Column:
    """An invoice's vendor, client and payment as a struct, without its items and totals."""
    b = X.bind(X.nonempty_lines(text), lambda ls: F.struct(ls.alias("ls"), D.last_wins(D.pairs(ls)).alias("kv")))
    return X.bind(b, lambda x: F.struct(*[c.alias(n) for n, c in _parties(x["ls"], x["kv"]).items()]))


def invoice_parties(docs: DataFrame) -> DataFrame:
    """(doc_id, vendor, client, payment) of invoices, without their items and totals."""
    kinds = {k: INVOICE_TYPES[k] for k in ("vendor", "client", "payment")}
    return docs.select("doc_id", B.of_latin(F.col("text"), _struct(kinds), B.invoice_parties, parties_data).alias("p")).select("doc_id", "p.*")


def sections_by_name(rows: Column) -> Column:
    """A map from each section, in order of its first line, to its lines."""
    def of(rs: Column) -> Column:
        names = F.array_distinct(F.transform(rs, lambda r: r["section"]))
        return F.map_from_arrays(names, F.transform(names, lambda n: F.transform(F.filter(rs, lambda r: r["section"] == n), lambda r: r["line"])))

    return X.bind(rows, of)


def generic_data(text: Column) -> Column:
    """Title, contacts, dates, amounts, pairs and sections of any document."""
    return X.bind(X.nonempty_lines(text), lambda ls: F.struct(
        F.try_element_at(ls, F.lit(1)).alias("title"), D.contact(ls).alias("contacts"), X.unique(F.flatten(F.transform(ls, lambda x: X.all_matches(P.DATE, x)))).alias("dates"),
        X.unique(F.flatten(F.transform(ls, lambda x: X.all_matches(P.MONEY, x)))).alias("amounts"), F.map_from_entries(F.transform(D.last_wins(D.pairs(ls)), lambda p: F.struct(p["key"], p["value"]))).alias("key_values"),
        sections_by_name(D.labelled_sections(ls)).alias("sections"), F.filter(F.array(pipe_table(ls)), lambda t: F.size(t) > 0).alias("tables")))


_CONTACT = "struct<phone:string,email:string,skype:string,urls:array<string>>"
CV_TYPES = {
    "personal_info": f"struct<name:string,contact:{_CONTACT},hobbies:array<string>>", "education": "struct<formation:array<struct<name:string,university:string,dates:array<string>>>>",
    "work_experience": "array<struct<company:string,position:string,location:string,dates:array<string>,responsibilities:array<string>>>", "skills": "map<string,boolean>",
    "languages": "array<struct<name:string,level:string>>", "certifications": "array<struct<name:string,provider:string>>", "projects": "array<struct<name:string,description:string>>",
}
INVOICE_TYPES = {
    "vendor": "struct<name:string,attention_of:string>", "client": "struct<phone:string,email:string,address:struct<street:string,city:string>>",
    "items": "array<struct<description:string,price:double,quantity:double,total:double>>", "totals": "struct<subtotal:double,tax:double,total:double>",
    "payment": "struct<method:string,conditions:string,account_number:string,due_date:string>",
}
GENERIC_TYPES = {"title": "string", "contacts": _CONTACT, "dates": "array<string>", "amounts": "array<string>", "key_values": "map<string,string>", "sections": "map<string,array<string>>", "tables": "array<array<array<string>>>"}


def _struct(kinds: dict[str, str]) -> str:
    return "struct<" + ",".join(f"{name}:{kind}" for name, kind in kinds.items()) + ">"


def _cv(text: Column, parts: Sequence[str] | None = None, where: Column | None = None) -> Column:
    return B.of_latin(text, _struct({k: v for k, v in CV_TYPES.items() if parts is None or k in parts}), lambda t: B.cv(t, parts), lambda t: cv_data(t, parts), where)


def _invoice(text: Column, where: Column | None = None) -> Column:
    return B.of_latin(text, _struct(INVOICE_TYPES), B.invoice, invoice_data, where)


def _generic(text: Column, where: Column | None = None) -> Column:
    return B.of_latin(text, _struct(GENERIC_TYPES), B.generic, generic_data, where)


def cv(docs: DataFrame, parts: Sequence[str] | None = None) -> DataFrame:
    """(doc_id, data); ``parts`` names the parts to compute, all without it."""
    return docs.select("doc_id", _cv(F.col("text"), parts).alias("data"))


def invoice(docs: DataFrame) -> DataFrame:
    """(doc_id, data)."""
    return docs.select("doc_id", _invoice(F.col("text")).alias("data"))


def generic(docs: DataFrame) -> DataFrame:
    """(doc_id, data)."""
    return docs.select("doc_id", _generic(F.col("text")).alias("data"))


def as_json(found: DataFrame) -> DataFrame:
    """(doc_id, json) of an export."""
    return found.select("doc_id", F.to_json("data").alias("json"))


def route(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_type, json): each document's export by its doc_type: cv, invoice, or any other.  One pass; only the fitting branch is computed."""
    text, kind = F.col("text"), F.col("doc_type")
    cv_, invoice_ = F.coalesce(kind == "cv", F.lit(False)), F.coalesce(kind == "invoice", F.lit(False))
    json = F.when(cv_, F.to_json(_cv(text, where=cv_))).when(invoice_, F.to_json(_invoice(text, invoice_))).otherwise(F.to_json(_generic(text, ~cv_ & ~invoice_)))
    return docs.select("doc_id", F.when(cv_, "CV").when(invoice_, "invoice").otherwise("generic").alias("doc_type"), json.alias("json"))
