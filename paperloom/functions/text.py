"""Text as column expressions: normalisers, lines, numbers, dates, lists."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P


def _folding() -> tuple[str, str]:
    """Latin letters with marks, and the ASCII letter that each decomposes to."""
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base.isascii() and base.isalnum():
            pairs[c] = base
    return "".join(pairs), "".join(pairs.values())


_MARKED, _PLAIN = _folding()


#: What counts as white space at a text's ends.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: the same for a pattern
_BLANK = "\\t\\n\\x0b\\x0c\\r\\x1c\\x1d\\x1e\\x1f \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def bind(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fold(text: Column) -> Column:
    """Lower case without accents, for Latin letters."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.regexp_replace(F.translate(F.lower(text), _MARKED, _PLAIN), "[\\u0300-\\u036f]", ""))


def norm(text: Column) -> Column:
    """Label form: folded, what is no letter or digit becomes one space, trimmed."""
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " "))


def norm_key(text: Column) -> Column:
    return F.replace(norm(text), F.lit(" "), F.lit("_"))


def norm_text(text: Column) -> Column:
    """Match form: a-z and 0-9 alone, accents not folded."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def strip(text: Column) -> Column:
    """Without white space at the ends, of any kind."""
    return F.btrim(text, F.lit(BLANKS))


def nonempty_lines(text: Column) -> Column:
    """The stripped lines that are not blank, as an array."""
    def of(t: Column) -> Column:
        plain = ~(F.rlike(t, F.lit("[^!-~ \\n]")) | F.contains(t, F.lit(" \n")) | F.contains(t, F.lit("\n ")) | F.startswith(t, F.lit(" ")) | F.endswith(t, F.lit(" ")))
        # an end of line goes with the white space around it, so no line has to be stripped by itself
        ends = f"(?<![{_BLANK}])[{_BLANK}]*[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029][{_BLANK}]*"
        return F.when(plain, F.split(t, "\n")).otherwise(F.split(strip(t), ends))

    return F.filter(bind(F.coalesce(text, F.lit("")), of), lambda x: x != "")


def exploded(rows: DataFrame, values: Column, pos: str, value: str, *keep: str | Column) -> DataFrame:
    """``keep`` with each element of an array and its place.

    The array is computed once: under an inner explode Spark filters by the array's size, and computes it there too.
    """
    return rows.select(*keep, F.posexplode_outer(values).alias(pos, value)).filter(F.col(pos).isNotNull())


def words(text: Column) -> Column:
    return F.filter(F.split(text, "(?U)\\s+"), lambda w: w != "")


def is_upper(text: Column) -> Column:
    """At least one letter with case, and none in lower case."""
    return (F.upper(text) == text) & (F.lower(text) != text)


def first_match(pattern: str, text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, 0)), F.lit(""))


def all_matches(pattern: str, text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    return F.rlike(text, F.lit("|".join(f"\\Q{n}\\E" for n in needles)))


def unique(values: Column) -> Column:
    """Stripped, without blanks and without repeats that differ in case alone; the first of each stays, in order."""
    clean = F.filter(F.transform(values, strip), lambda x: x != "")
    return bind(clean, lambda xs: bind(F.transform(xs, lambda x: F.lower(x)),
                                       lambda ls: F.filter(xs, lambda x, i: F.array_position(ls, F.get(ls, i)) == i + 1)))


def _last_point(digits: Column) -> Column:
    """Commas as points; of several points the last one stays."""
    return F.regexp_replace(F.replace(digits, F.lit(","), F.lit(".")), "\\.(?=.*\\.)", "")


def number(value: Column) -> Column:
    """The first amount as a double: a comma is a point, and of several points the last one counts; the sign is lost."""
    return _last_point(F.regexp_replace(F.regexp_extract(value, P.MONEY, 0), "[^\\d,.-]", "")).try_cast("double")


def money_last(text: Column) -> Column:
    """The last amount of a text, null without one."""
    return F.trim(F.try_element_at(all_matches(P.MONEY, text), F.lit(-1)))


def date_ranges(lines: Column) -> Column:
    """The first date range of each line that has one; without any, the distinct dates of all lines."""
    ranges = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, P.DATE_RANGE, 0)), lambda x: x != "")
    dates = unique(F.flatten(F.transform(lines, lambda x: all_matches(P.DATE, x))))
    return bind(ranges, lambda r: F.when(F.size(r) > 0, r).otherwise(dates))


def split_list(line: Column) -> Column:
    """The parts of a list line: bullets go, two spaces, ; , and | part."""
    clean = strip(F.regexp_replace(line, "(?U)^[•*\\-+\\s]+", ""))
    return F.filter(F.transform(F.split(clean, "(?U)\\s{2,}|[;,|]"), strip), lambda x: x != "")


def is_heading(line: Column) -> Column:
    return norm(line).isin(*P.HEADINGS) | ((F.char_length(line) > 3) & is_upper(line) & (F.size(words(line)) <= 3))


def is_section_heading(line: Column) -> Column:
    return norm(line).isin(*sorted({*P.SECTION_WORDS, "competences"}))


def has_contact_signal(line: Column) -> Column:
    return F.rlike(line, F.lit(P.EMAIL)) | F.rlike(line, F.lit(P.CORE_PHONE)) | contains_any(F.lower(line), ("linkedin", "@"))


def looks_location(line: Column) -> Column:
    return F.contains(line, F.lit(",")) | F.rlike(line, F.lit(P.LOCATION))


def section_of(text: Column) -> Column:
    """The first section that has an alias equal to the normalised text, or at its start as words; null without one."""
    def starts(label: Column, aliases: Sequence[str]) -> Column:
        return F.rlike(label, F.lit("^(?:" + "|".join(dict.fromkeys(plain_norm(a) for a in aliases)) + ")(?: |$)"))

    def of(label: Column) -> Column:
        out = None
        for section, aliases in P.SECTION_ALIASES.items():
            hit = starts(label, aliases)
            out = F.when(hit, section) if out is None else out.when(hit, section)
        return F.when(starts(label, [a for aliases in P.SECTION_ALIASES.values() for a in aliases]), out)  # most lines have none, which one pattern says

    return bind(norm(text), of)


def plain_norm(text: str) -> str:
    """``norm`` of a constant."""
    t = unicodedata.normalize("NFKD", text.lower())
    t = "".join(c for c in t if not unicodedata.combining(c))
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in t).split())


def slug(text: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(""))


def value_type(value: Column) -> Column:
    """email, url, amount, date or string, the first that fits."""
    v = F.trim(value)

    def whole(p: str) -> Column:
        flags, _, body = p.partition(")") if p.startswith("(?") and ":" not in p.partition(")")[0] else ("", "", p)
        return F.rlike(v, F.lit((flags + ")" if flags else "") + f"^(?:{body})$"))

    return (F.when(whole(P.EMAIL), "email").when(whole(P.CANDIDATE_URL), "url").when(F.rlike(value, F.lit(P.MONEY)), "amount")
            .when(F.rlike(value, F.lit(P.CANDIDATE_DATE)), "date").otherwise("string"))


def normalised_value(value: Column, kind: Column) -> Column:
    v = F.trim(value)
    amount = _last_point(F.regexp_replace(v, "[^\\d,.-]", ""))
    return (F.when(kind == "email", F.lower(v)).when(kind == "phone", F.regexp_replace(v, "\\s+", " "))
            .when(kind == "amount", F.nullif(amount, F.lit(""))).otherwise(v))


def field_name(label: Column) -> Column:
    """A label as a field's name, synonyms brought to one."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    table = F.create_map(*[F.lit(x) for kv in P.FIELD_SYNONYMS.items() for x in kv])
    return bind(key, lambda k: F.coalesce(F.try_element_at(table, k), F.nullif(k, F.lit("")), F.lit("field")))


def amount_field(text: Column) -> Column:
    low = F.lower(text)
    return (F.when(contains_any(low, ("sub", "sous-total", "sous total")), "subtotal").when(contains_any(low, ("tax", "vat", "tva")), "tax")
            .when(contains_any(low, ("total", "montant", "amount due")), "total").otherwise("amount"))


def stem(path: Column) -> Column:
    """A path's last name without its last extension; a leading dot is part of the name."""
    name = F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
