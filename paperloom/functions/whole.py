"""Whole documents in Python, a batch at a time: curricula, invoices, generic exports and the schemas of plain texts.

What ``plain`` does for lines is done here for a document.  Texts of ASCII and the
letters of Latin-1 give the rows of the expressions, which any other text goes through:
patterns are compiled so that their classes, boundaries and cases mean what they mean to Java.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Iterable, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from . import plain as A
from . import text as X

_OUTSIDE = "[^\\x00-\\x7fÀ-ÖØ-öø-ÿ]"


def of_latin(text: Column, made: str, plain: Callable[[str], object], other: Callable[[Column], Column], where: Column | None = None) -> Column:
    """``plain`` of each text of ASCII and Latin-1's letters, as type ``made``; ``other``, an expression, for any other text.

    Where ``where`` is not true the value is of no use, and not computed.
    """
    t = F.coalesce(text, F.lit(""))
    fits = (F.octet_length(t) == F.char_length(t)) | ~F.rlike(t, F.lit(_OUTSIDE))
    return F.when(fits, A.batch(made, plain)(F.when(fits if where is None else where & fits, t))).otherwise(other(t))


def compiled(pattern: str) -> re.Pattern:
    """A pattern for such texts.  Under (?U) letters and their cases are Unicode's, else ASCII's; a boundary is Unicode's always."""
    flags = re.match(r"\(\?([iU]+)\)", pattern)
    body, flags = (pattern[flags.end():], flags[1]) if flags else (pattern, "")
    case = re.IGNORECASE if "i" in flags else 0
    if "U" in flags:
        return re.compile(body.replace(r"\s", r"[\t-\r ]").replace(r"\S", r"[^\t-\r ]").replace(r"\d", "[0-9]"), case)
    return re.compile(body.replace(r"\b", r"(?u:\b)").replace(r"\p{L}\p{N}_", "A-Za-z0-9_À-ÖØ-öø-ÿ"), case | re.ASCII)


EMAIL, PHONE, URL, DATE, DATE_RANGE = map(compiled, (P.EMAIL, P.PHONE, P.URL, P.DATE, P.DATE_RANGE))
PHONE_WRITTEN, PHONE_DIGITS = map(compiled, (P.PHONE_WRITTEN, P.PHONE_DIGITS))
STREET, CITY, LOCATION, ACCOUNT_RUN = map(compiled, (P.STREET, P.CITY, P.LOCATION, P.ACCOUNT_RUN))
#: for lines joined, so its blanks are no end of line
ACCOUNT = compiled(P.ACCOUNT.replace(r"\s", r"[ \t\x0b\f\r]"))
CORE_PHONE, CORE_URL, CORE_DATE_RANGE, BULLET, DEGREES = map(compiled, (P.CORE_PHONE, P.CORE_URL, P.CORE_DATE_RANGE, P.BULLET, P.DEGREES))
_DIGIT, _WORD, _NO_LETTER, _NO_KEY = re.compile("[0-9]"), re.compile(r"[^\t-\r ]+"), re.compile("[^A-Za-zÀ-ÖØ-öø-ÿ]"), re.compile("[^a-z0-9]+")
_POINTS, _PARTS, _ITEMS = re.compile(r"^[•*\-+\t-\r ]+"), re.compile(r"[\t-\r ]{2,}|[;,|]"), re.compile(r"[\t-\r ]{2,}|[|;,]")
_FIRST_WORD, _ENDS = re.compile(r"([^\t-\r ]+)[\t-\r ]*(.*)$", re.DOTALL), re.compile(r"^[,;:\t-\r -]+|[,;:\t-\r -]+$")

HEADINGS, SECTION_WORDS = frozenset(P.HEADINGS), frozenset({*P.SECTION_WORDS, "competences"})


def _norms(names: Iterable[str]) -> tuple[str, ...]:
    return tuple(X.plain_norm(x) for x in names)


# --- lines ---

def words(x: str) -> list[str]:
    return _WORD.findall(x)


def has_email(x: str) -> bool:
    return "@" in x and EMAIL.search(x) is not None


def has_phone(x: str) -> bool:
    return _DIGIT.search(x) is not None and PHONE.search(x) is not None


def is_upper(x: str) -> bool:
    return x.upper() == x and x.lower() != x


@lru_cache(A.MEMO)
def is_heading(x: str) -> bool:
    return A.norm(x) in HEADINGS or (len(x) > 3 and is_upper(x) and len(words(x)) <= 3)


def is_section_heading(x: str) -> bool:
    return A.norm(x) in SECTION_WORDS


@lru_cache(A.MEMO)
def section_type(head: str) -> str:
    """The block type of a section's heading."""
    label = A.norm(head)
    found = next((s for s, aliases in P.SECTION_ALIASES.items() if any(label == a or label.startswith(a + " ") for a in _norms(aliases))), None)
    return P.SECTION_TYPES.get(found, "paragraph")


def has_contact_signal(x: str) -> bool:
    return "@" in x or "linkedin" in x.lower() or CORE_PHONE.search(x) is not None


def contains_any(x: str, needles: Iterable[str]) -> bool:
    return any(n in x for n in needles)


def line_at(text: str, at: int) -> str:
    end = text.find("\n", at)
    return text[text.rfind("\n", 0, at) + 1:end if end >= 0 else len(text)]


def first_place(low: str, needles: Iterable[str]) -> int:
    """Where the first of the needles is, -1 without any."""
    return min((at for n in needles if (at := low.find(n)) >= 0), default=-1)


def first_containing(low: str, text: str, needles: Iterable[str]) -> str | None:
    """The first line, of lines joined and the same in lower case, that contains a needle."""
    at = first_place(low, needles)
    return None if at < 0 else line_at(text, at)


def folded(low: str) -> str:
    return low if low.isascii() else low.translate(A._FOLDED)


def _all(pattern: re.Pattern, ls: Iterable[str], mark: str) -> list[str]:
    return A.unique(m[0] for x in ls if mark in x for m in pattern.finditer(x))


def date_ranges(ls: Sequence[str]) -> list[str]:
    dated = [x for x in ls if _DIGIT.search(x)]
    return [m[0] for x in dated if (m := DATE_RANGE.search(x))] or A.unique(d for x in dated for d in DATE.findall(x))


def split_list(x: str) -> list[str]:
    return [p for c in _PARTS.split(_POINTS.sub("", x).strip()) if (p := c.strip())]


# --- pairs ---

def last_wins(found: list[tuple[str, str, int]]) -> dict[str, str]:
    """A key's last value, keys in the order of their first pairs."""
    return {key: value for key, value, _ in found}


def first_value(kv: dict[str, str], names: Sequence[str]) -> str | None:
    for n in names:
        if n in kv:
            return kv[n]
    return next((v for k, v in kv.items() if contains_any(k, names)), None)


def plain_pairs(ls: Iterable[str]) -> list[tuple[str, str, int]]:
    out, seen = [], {}
    for pos, x in enumerate(x for x in ls if ":" in x):
        key, _, value = x.partition(":")
        key, value = _NO_KEY.sub("_", key.strip(" ").lower()).strip("_"), value.strip()
        if key and value:
            n = seen[key] = seen.get(key, 0) + 1
            out.append((key if n == 1 else f"{key}_{n}", value, pos))
    return out


def first_key(kv: Sequence[tuple[str, str]], names: Sequence[str]) -> str | None:
    """Of (key with spaces, value): by exact key, then by containment, each in the order of ``names``."""
    for n in names:
        for k, v in kv:
            if k == n:
                return v
    for n in names:
        for k, v in kv:
            if n in k:
                return v
    return None


# --- exports ---

def phone(text: str) -> str | None:
    found = _DIGIT.search(text) and (PHONE_WRITTEN.search(text) or PHONE_DIGITS.search(text) or PHONE.search(text))
    return (found[0].strip(" ") or None) if found else None


def contact(text: str, low: str) -> tuple:
    """Of lines joined, and the same in lower case."""
    found = EMAIL.search(text) if "@" in text else None
    urls = A.unique(m[0] for m in URL.finditer(text)) if "www." in text else []
    return phone(text), found and found[0], first_containing(low, text, ("skype",)), urls


def candidate_name(ls: Sequence[str]) -> str | None:
    return next((x for x in ls[:12] if len(x) <= 70 and not _DIGIT.search(x) and 2 <= len(words(x)) <= 4 and not has_email(x) and "linkedin" not in x.lower()), None)


def company_like(ls: Sequence[str]) -> str | None:
    return next((x for x in ls[:12] if len(x) <= 70 and not _DIGIT.search(x) and not has_email(x) and (is_upper(x) or contains_any(x.lower(), P.COMPANY_WORDS))), None)


def party_name(ls: Sequence[str], low: str, names: Sequence[str]) -> str | None:
    """As a name is one word, a line's label form has it if the folded line does."""
    fold = folded(low)
    if first_place(fold, names) >= 0:
        for i, label in enumerate(fold.split("\n")):
            if contains_any(label, names):
                for y in ls[i + 1:i + 4]:
                    if not has_email(y) and not has_phone(y):
                        return y
    return None


def account_number(text: str) -> str | None:
    line = ACCOUNT.search(text)
    found = ACCOUNT_RUN.search(line_at(text, line.start())) if line else None
    return (found[0].strip(" ") or None) if found else None


VENDOR, DUE, TERMS = _norms(("vendor", "seller", "from", "émetteur", "fournisseur")), ("due_date", "date_d_echeance", "echeance"), ("conditions", "terms", "payment_terms", "conditions_de_paiement")


def parties(ls: Sequence[str], kv: dict[str, str]) -> tuple[tuple, tuple, tuple]:
    """Vendor, client and payment of an invoice's lines and pairs."""
    text = "\n".join(ls)
    low = text.lower()
    name, due = party_name(ls, low, VENDOR), first_value(kv, DUE)
    phone_, email, _, _ = contact(text, low)
    where = tuple(m and line_at(text, m.start()) for m in (STREET.search(text), CITY.search(text)))
    return ((company_like(ls) if name is None else name, first_containing(low, text, ("attention", "à l'attention", "a l'attention"))), (phone_, email, where),
            (first_containing(low, text, ("paiement", "payment", "payable", "ordre de")), first_value(kv, TERMS), account_number(text),
             first_containing(low, text, ("sous 30 jours", "due", "échéance", "echeance")) if due is None else due))


def invoice_parties(text: str) -> tuple:
    ls = A.lines(text)
    return parties(ls, last_wins(A.pairs(ls)))


def invoice(text: str) -> tuple:
    ls = A.lines(text)
    kv, items = last_wins(A.pairs(ls)), A.table_items(A.pipe_table(ls))
    vendor, client, payment = parties(ls, kv)

    def amount(*names: str) -> float | None:
        value = first_value(kv, names)
        return None if value is None else A.number(value)

    summed = 0.0
    for i in items:
        summed += i[3] or 0.0
    subtotal, tax, total = amount("subtotal", "sous_total", "sub_total"), amount("tax", "vat", "tva"), amount("total", "grand_total", "amount_due", "montant_total")
    subtotal = (summed or None) if subtotal is None else subtotal
    if total is None and subtotal is not None and tax is not None:
        total = subtotal + tax
    return vendor, client, items, (subtotal, tax, total), payment


def labelled_sections(ls: Iterable[str], headings: bool = False) -> list[tuple[str, str | None]]:
    name, out = "body", []
    for x in ls:
        if is_heading(x):
            name = A.norm(x)
            if headings:
                out.append((name, None))
        else:
            out.append((name, x))
    return out


def by_name(rows: Iterable[tuple[str, str | None]]) -> dict[str, list[str]]:
    """Each section, in the order of its first row, with its lines."""
    out: dict[str, list[str]] = {}
    for name, x in rows:
        held = out.setdefault(name, [])
        if x is not None:
            held.append(x)
    return out


def fuzzy_section(ss: dict[str, list[str]], names: Sequence[str]) -> list[str]:
    return [x for name, held in ss.items() if any(n in name or name in n for n in names) for x in held]


def section_list(ss: dict[str, list[str]], names: Sequence[str]) -> list[str]:
    return A.unique(p for n in names for x in ss.get(n, ()) for p in split_list(x) if not is_heading(p))


def entry_groups(ls: Iterable[str]) -> list[list[str]]:
    done, held = [], []
    for x in ls:
        if held and _DIGIT.search(x) and DATE_RANGE.search(x):
            done.append([*held, x])
            held = []
        elif len(held) >= 5 and x[:1] not in ("-", "•", "*"):
            done.append(held)
            held = [x]
        else:
            held.append(x)
    return [*done, held] if held else done


def _dated(g: list[str]) -> tuple[list[str], list[str]]:
    d = date_ranges(g)
    return d, [x for x in g if x not in d]


def _at(xs: Sequence[str], i: int) -> str | None:
    return xs[i] if i < len(xs) else None


def _education(ss: dict[str, list[str]]) -> tuple:
    return ([(_at(rest, 0), _at(rest, 1), d) for d, rest in map(_dated, entry_groups(fuzzy_section(ss, EDUCATION)))],)


def _work(ss: dict[str, list[str]]) -> list[tuple]:
    def entry(d: list[str], rest: list[str]) -> tuple:
        third = _at(rest, 2)
        here = third is not None and ("," in third or LOCATION.search(third) is not None)
        return _at(rest, 0), _at(rest, 1), third if here else None, d, [x for x in rest[3:] if len(x) > 12]

    return [entry(*_dated(g)) for g in entry_groups(fuzzy_section(ss, WORK))]


def _languages(ss: dict[str, list[str]]) -> list[tuple[str, str]]:
    def entry(x: str) -> tuple[str, str]:
        for mark in ":-":
            if mark in x:
                name, _, level = x.partition(mark)
                return name.strip(" "), level.strip(" ")
        m = _FIRST_WORD.match(x)
        return (m[1].strip(" "), m[2].strip(" ")) if m else ("", "")

    return [e for e in map(entry, section_list(ss, ("languages", "langues"))) if e[0]]


def _certifications(ss: dict[str, list[str]]) -> list[tuple[str, str]]:
    cut = [x.partition(" - " if " - " in x else ",") for x in fuzzy_section(ss, CERTIFICATIONS)]
    return [(n, p.strip(" ")) for name, _, p in cut if (n := name.strip(" "))]


EDUCATION, WORK = _norms(("education", "formation", "études", "etudes")), _norms(("experience", "work experience", "expérience", "expériences", "emploi"))
CERTIFICATIONS, PROJECTS, SKILLS, HOBBIES = _norms(("certifications", "certificats", "certification")), _norms(("projects", "projets")), _norms(("skills", "compétences", "competences")), _norms(("hobbies", "centres d'intérêt", "interests"))

#: a curriculum's parts, of its lines and sections
CV_PARTS = {
    "personal_info": lambda ls, ss: (candidate_name(ls), contact(text := "\n".join(ls), text.lower()), section_list(ss, HOBBIES)), "education": lambda ls, ss: _education(ss), "work_experience": lambda ls, ss: _work(ss),
    "skills": lambda ls, ss: [(x, True) for x in dict.fromkeys(x.lower() for x in section_list(ss, SKILLS))], "languages": lambda ls, ss: _languages(ss), "certifications": lambda ls, ss: _certifications(ss),
    "projects": lambda ls, ss: [(g[0], " ".join(g[1:])) for g in entry_groups(fuzzy_section(ss, PROJECTS))],
}


def cv(text: str, parts: Collection[str] | None = None) -> tuple:
    ls = A.lines(text)
    ss = by_name(labelled_sections(ls, headings=True))
    return tuple(part(ls, ss) for name, part in CV_PARTS.items() if parts is None or name in parts)


def generic(text: str) -> tuple:
    ls = A.lines(text)
    dated = [x for x in ls if _DIGIT.search(x)]
    table, whole = A.pipe_table(ls), "\n".join(ls)
    return (_at(ls, 0), contact(whole, whole.lower()), A.unique(d for x in dated for d in DATE.findall(x)), A.unique(m for x in dated for m in A.MONEY.findall(x)),
            list(last_wins(A.pairs(ls)).items()), list(by_name(labelled_sections(ls)).items()), [table] if table else [])


# --- schemas of texts: a line that names a section opens a block ---

#: what a text with a section heading contains, folded
_ROOTS = tuple(w for w in sorted(map(X.plain_norm, SECTION_WORDS)) if not any(v != w and v in w for v in map(X.plain_norm, SECTION_WORDS)))


def block_lines(ls: Sequence[str], low: str) -> dict[str, list[str]]:
    """The lines of the blocks of each type, without headings, of lines and the same joined in lower case."""
    if first_place(folded(low), _ROOTS) < 0:
        return {"paragraph": list(ls)}
    out, held = {}, None
    for x in ls:
        if is_section_heading(x):
            held = out.setdefault(section_type(x), [])
        else:
            held = out.setdefault("paragraph", []) if held is None else held
            held.append(x)
    return out


def header(ls: Sequence[str]) -> list[str]:
    first = ls[:12]
    return first[:next((i for i, x in enumerate(first) if is_section_heading(x)), len(first))]


def person(head: Sequence[str]) -> tuple[str | None, str | None]:
    quiet = [x for x in head if not _DIGIT.search(x) and not has_contact_signal(x)]
    name = next((x for x in quiet if len(x) <= 60 and 2 <= len(words(x)) <= 4), None)
    return name, next((x for x in quiet if x != name), None)


def schema_contact(ls: Sequence[str], own: list[str]) -> tuple:
    mails, phones = _all(EMAIL, ls, "@"), A.unique(m[0] for x in ls if _DIGIT.search(x) for m in CORE_PHONE.finditer(x))
    place = next((x for x in [*own, *ls[:12]] if "," in x and not has_email(x) and not CORE_DATE_RANGE.search(x)), None)
    return _at(mails, 0), _at(phones, 0), _all(CORE_URL, (x for x in ls if not has_email(x)), "."), place, own


def section_items(own: Iterable[str]) -> list[str]:
    clean = (BULLET.sub("", x).strip(" ") for x in own)
    return A.unique(p for x in clean if x and not is_section_heading(x) for p in _ITEMS.split(x))


def is_entry_title(x: str, education: bool) -> bool:
    ws, low = words(x), x.lower()
    if not 1 <= len(ws) <= 10 or "," in x or low[-1:] in (".", ";", ":"):
        return False
    first = [y[0] for w in ws if (y := _NO_LETTER.sub("", w))]
    ratio = sum(c.upper() == c for c in first) / len(ws)
    if education:
        return ratio >= 0.55 or DEGREES.search(low) is not None
    return words(low)[0] not in P.ACTION_STARTERS and (contains_any(low, P.ROLE_WORDS) or (ratio >= 0.78 and len(ws) <= 5))


def entries(ls: Iterable[str], education: bool) -> list[tuple]:
    """Entries (title, organisation, date range, place, description, bullets)."""
    out: list[list] = []
    for x in ls:
        o = out[-1] if out else None
        found = CORE_DATE_RANGE.search(x)
        date, bullet = found and found[0], BULLET.match(x)
        if not bullet and date is None and len(x) <= 90 and (o is None or (((o[2] is not None and o[1] is not None) or o[4] or o[5]) and is_entry_title(x, education))):
            out.append([x, None, None, None, [], []])
            continue
        if o is None:
            o = [None, None, None, None, [], []]
            out.append(o)
        if date is not None:
            o[2], o[3] = date, _ENDS.sub("", x.replace(date, "").strip(" ")) or o[3]
        elif bullet:
            o[5].append(BULLET.sub("", x).strip(" "))
        elif o[1] is None:
            o[1] = x
        else:
            o[4].append(x)
    return [tuple(o) for o in out]


def schema_cv(text: str, parts: Collection[str] | None = None) -> tuple:
    ls = A.lines(text)
    b = block_lines(ls, "\n".join(ls).lower())
    own = lambda kind: b.get(kind, [])
    strong = own("strengths_section")
    made = {
        "person": lambda: person(header(ls)), "contact": lambda: schema_contact(ls, own("contact_section")), "summary": lambda: "\n".join(own("summary_section")) or None, "skills": lambda: section_items(own("skills_section")),
        "experience": lambda: entries(own("experience_section"), False), "education": lambda: entries(own("education_section"), True), "languages": lambda: section_items(own("languages_section")),
        "strengths": lambda: [(strong[i], _at(strong, i + 1) or "") for i in range(0, len(strong), 2)]}
    return ("cv", *(make() for name, make in made.items() if parts is None or name in parts))


def _party(ls: Sequence[str], low: str, names: Sequence[str]) -> tuple[str | None, list[str]]:
    at = first_place(low, names)
    near = ls[(i := low.count("\n", 0, at)) + 1:i + 7] if at >= 0 else []
    kept = near[:next((i for i, x in enumerate(near) if is_section_heading(x)), len(near))]
    return _at(kept, 0), kept


def schema_invoice(text: str, parts: Collection[str] | None = None) -> tuple:
    ls = A.lines(text)
    low, kv = "\n".join(ls).lower(), plain_pairs(ls)
    named = [(k.replace("_", " "), v) for k, v, _ in kv]
    key = lambda *names: first_key(named, names)
    made = {
        "invoice_number": lambda: key("invoice no", "invoice number", "invoice", "inv"), "issue_date": lambda: key("date", "issue date", "invoice date"), "due_date": lambda: key("due date"),
        "seller": lambda: _party(ls, low, ("from", "seller", "vendor", "supplier")), "buyer": lambda: _party(ls, low, ("billed to", "bill to", "customer", "client")), "line_items": lambda: block_lines(ls, low).get("table_section", []),
        "totals": lambda: (key("subtotal", "sub total"), key("tax", "vat", "gst", "hst"), key("total", "amount due", "balance due", "grand total")), "payment": lambda: (key("payment status", "status"), key("payment terms", "terms")),
        "verified_fields": lambda: kv}
    return ("invoice", *(make() for name, make in made.items() if parts is None or name in parts))
