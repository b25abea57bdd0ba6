"""Whole-document expressions over an array of lines: no shuffle, one row in and one out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from . import text as X

PAIR = "array<struct<key:string,value:string,pos:int>>"


def pairs(lines: Column, least_key: int = 1) -> Column:
    """(key, value, pos) of every line with a colon, cut at the first one; key normalised, neither may be blank."""
    numbered = F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.cast("int").alias("pos")))
    cut = F.transform(F.filter(numbered, lambda p: F.contains(p["x"], F.lit(":"))), lambda p: F.struct(
        X.norm_key(F.substring_index(p["x"], ":", 1)).alias("key"), X.strip(F.substring(p["x"], F.instr(p["x"], ":") + 1, F.char_length(p["x"]))).alias("value"), p["pos"].alias("pos")))
    return F.filter(cut, lambda p: (F.char_length(p["key"]) >= least_key) & (p["value"] != ""))


def last_wins(found: Column) -> Column:
    """One pair a key: at the place of its first pair, with the value of its last one."""
    def of(ps: Column) -> Column:
        keys = F.transform(ps, lambda p: p["key"])
        firsts = F.filter(ps, lambda p, i: F.array_position(keys, p["key"]) == i + 1)
        return F.transform(firsts, lambda f: F.struct(f["key"].alias("key"), F.try_element_at(F.filter(ps, lambda p: p["key"] == f["key"]), F.lit(-1))["value"].alias("value"), f["pos"].alias("pos")))

    return X.bind(found, of)


def suffixed(found: Column) -> Column:
    """Every pair; the second and later ones of a key are named key_2, key_3 and so on."""
    def of(ps: Column) -> Column:
        keys = F.transform(ps, lambda p: p["key"])
        n = lambda p, i: F.size(F.filter(F.slice(keys, F.lit(1), i + 1), lambda k: k == p["key"]))
        return F.transform(ps, lambda p, i: F.struct(F.when(n(p, i) > 1, F.concat(p["key"], F.lit("_"), n(p, i).cast("string"))).otherwise(p["key"]).alias("key"), p["value"].alias("value"), p["pos"].alias("pos")))

    return X.bind(found, of)


def _value_where(found: Column, test) -> Column:
    """The value of the first pair that passes."""
    return F.try_element_at(F.filter(found, lambda p: test(p)), F.lit(1))["value"]


def first_value(found: Column, keys: Sequence[str]) -> Column:
    """By exact key, in the order of ``keys``; else the first pair whose key contains any of them."""
    names = [X.plain_norm(k).replace(" ", "_") for k in keys]
    exact = [_value_where(found, lambda p, n=n: p["key"] == n) for n in names]
    return F.coalesce(*exact, _value_where(found, lambda p: X.contains_any(p["key"], names)))


def first_key(found: Column, keys: Sequence[str]) -> Column:
    """By exact key (underscores as spaces), then by containment, each in the order of ``keys``."""
    plain = [X.plain_norm(k) for k in keys]
    name = lambda p: F.replace(p["key"], F.lit("_"), F.lit(" "))
    exact = [_value_where(found, lambda p, n=n: name(p) == n) for n in plain]
    inside = [_value_where(found, lambda p, n=n: F.contains(name(p), F.lit(n))) for n in plain]
    return F.coalesce(*exact, *inside)


def line_containing(lines: Column, needles: Sequence[str]) -> Column:
    low = [n.lower() for n in needles]
    return F.try_element_at(F.filter(lines, lambda x: X.contains_any(F.lower(x), low)), F.lit(1))


def labelled_sections(lines: Column, headings: bool = False) -> Column:
    """(section, line) of every line that is no heading; a heading names what follows, ``body`` what comes before.

    With ``headings`` each heading has a row too, with a null line, so that sections
    have their places even where they are empty.
    """
    def of(ls: Column) -> Column:
        def rows(name: Column, said: Column, is_head: Column) -> Column:
            found = F.transform(said, lambda x: F.struct(name.alias("section"), x.alias("line")))
            own = F.array(F.struct(name.alias("section"), F.lit(None).cast("string").alias("line")))
            return F.when(is_head, F.concat(own, found)).otherwise(found) if headings else found

        return F.flatten(stretches(ls, X.is_heading, lambda x, first, said, is_head: rows(F.when(is_head, X.norm(x)).otherwise("body"), said, is_head)))

    return X.bind(lines, of)


def stretches(ls: Column, opens, made) -> Column:
    """``made(head, first, said, is_head)`` of the lines before the first that opens a stretch, and of each stretch.

    ``head`` is the line that opens it, of place ``first`` (null and -1 before the
    first one), ``said`` the lines after it.  Slices, as a fold would copy what it holds at every line.
    """
    places = F.concat(F.array(F.lit(-1)), F.filter(F.transform(ls, lambda x, i: F.when(opens(x), i)), lambda i: i.isNotNull()))
    return X.bind(places, lambda ps: F.transform(ps, lambda p, k: made(
        F.get(ls, p), p, F.slice(ls, p + 2, F.coalesce(F.get(ps, k + 1), F.size(ls)) - p - 1), p >= 0)))


def _said(sections: Column, name: Column) -> Column:
    return F.filter(F.transform(F.filter(sections, lambda s: s["section"] == name), lambda s: s["line"]), lambda x: x.isNotNull())


def exact_section(sections: Column, label: str) -> Column:
    return _said(sections, F.lit(X.plain_norm(label)))


def fuzzy_section(sections: Column, labels: Sequence[str]) -> Column:
    """Lines of sections whose name contains a label or is part of one, sections in the order of their first row."""
    plain = [X.plain_norm(x) for x in labels]

    def fits(name: Column) -> Column:
        out = F.lit(False)
        for p in plain:
            out = out | F.contains(name, F.lit(p)) | F.contains(F.lit(p), name)
        return out

    return X.bind(sections, lambda ss: F.flatten(F.transform(F.filter(F.array_distinct(F.transform(ss, lambda s: s["section"])), fits), lambda n: _said(ss, n))))


def entry_groups(lines: Column) -> Column:
    """Groups of lines: a line with a date range closes its group; a group of five starts anew at a line that is no bullet."""
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"))

    def step(acc: Column, x: Column) -> Column:
        closes = F.rlike(x, F.lit(P.DATE_RANGE)) & (F.size(acc["open"]) > 0)
        anew = ~closes & (F.size(acc["open"]) >= 5) & ~F.rlike(x, F.lit("^[-•*]"))
        return (F.when(closes, F.struct(F.concat(acc["done"], F.array(F.concat(acc["open"], F.array(x)))).alias("done"), F.array().cast("array<string>").alias("open")))
                .when(anew, F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), F.array(x).alias("open")))
                .otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.array(x)).alias("open"))))

    return F.aggregate(lines, start, step, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def section_list(sections: Column, labels: Sequence[str]) -> Column:
    """The distinct list parts of the lines of these sections, without headings."""
    parts = F.flatten(F.array(*[F.flatten(F.transform(exact_section(sections, x), X.split_list)) for x in labels]))
    return X.unique(F.filter(parts, lambda x: ~X.is_heading(x)))


def contact(lines: Column) -> Column:
    """phone, email, skype and urls of a document.

    The phone is the first number written as one, with a plus or in parted groups; only
    without any it is the first of nine digits or more, and only without that the first
    run of digits that could be one, so that no number of an invoice, a client or a mail
    address comes before it.
    """
    return X.bind(F.array_join(lines, "\n"), lambda text: F.struct(
        F.coalesce(*[X.first_match(p, text) for p in (P.PHONE_WRITTEN, P.PHONE_DIGITS, P.PHONE)]).alias("phone"), X.first_match(P.EMAIL, text).alias("email"), line_containing(lines, ("skype",)).alias("skype"),
        X.unique(X.all_matches(P.URL, text)).alias("urls")))


def candidate_name(lines: Column) -> Column:
    """Of the first twelve lines, the first of two to four words without digits, contacts or over 70 characters."""
    def fits(x: Column) -> Column:
        n = F.size(X.words(x))
        return ((n >= 2) & (n <= 4) & (F.char_length(x) <= 70) & ~F.rlike(x, F.lit("(?U)\\d")) & ~F.rlike(x, F.lit(P.EMAIL)) & ~F.rlike(x, F.lit(P.PHONE))
                & ~F.contains(F.lower(x), F.lit("linkedin")))

    return F.try_element_at(F.filter(F.slice(lines, 1, 12), fits), F.lit(1))


def company_like(lines: Column) -> Column:
    def fits(x: Column) -> Column:
        return ((F.char_length(x) <= 70) & ~F.rlike(x, F.lit(P.EMAIL)) & ~F.rlike(x, F.lit(P.PHONE)) & ~F.rlike(x, F.lit(P.MONEY))
                & (X.is_upper(x) | X.contains_any(F.lower(x), P.COMPANY_WORDS)))

    return F.try_element_at(F.filter(F.slice(lines, 1, 12), fits), F.lit(1))


def party_name(lines: Column, labels: Sequence[str]) -> Column:
    """After each line with a label, in turn: the first of the next three lines without e-mail or phone."""
    plain = [X.plain_norm(x) for x in labels]

    def after(x: Column, i: Column) -> Column:
        near = F.filter(F.slice(lines, i + 2, F.lit(3)), lambda y: ~F.rlike(y, F.lit(P.EMAIL)) & ~F.rlike(y, F.lit(P.PHONE)))
        return F.when(X.contains_any(X.norm(x), plain), F.try_element_at(near, F.lit(1)))

    return F.try_element_at(F.filter(F.transform(lines, after), lambda y: y.isNotNull()), F.lit(1))


def account_number(lines: Column) -> Column:
    """The digits of the first line with three groups of four; null if a tab parts them."""
    line = F.try_element_at(F.filter(lines, lambda x: F.rlike(x, F.lit(P.ACCOUNT))), F.lit(1))
    return X.first_match(P.ACCOUNT_RUN, line)
