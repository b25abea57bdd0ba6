"""Documents of plain ASCII, a batch at a time in Python.

An array expression of Spark's is interpreted for every line, a hundred times as slow as
``re`` over the same lines.  What is here gives the rows of the expressions for texts of
ASCII alone, where both languages' patterns mean the same; ``of_text`` leaves other texts
to the expression.  Nothing is kept between rows but a bounded memo of lines.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Sequence
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from . import patterns as P
from . import text as X

#: distinct lines, keys and values that a memo holds
MEMO = 20_000


def compiled(pattern: str) -> re.Pattern:
    """A pattern for ASCII text: its classes are those of ASCII, with Java's flags at its start."""
    flags = re.match(r"\(\?([iU]+)\)", pattern)
    return re.compile(pattern[flags.end():] if flags else pattern, re.ASCII | (re.IGNORECASE if flags and "i" in flags[1] else 0))


EMAIL, PHONE, MONEY, DATE, DATE_RANGE = map(compiled, (P.EMAIL, P.PHONE, P.MONEY, P.DATE, P.DATE_RANGE))
URL, CANDIDATE_DATE, KEY_VALUE, REFERENCE = map(compiled, (P.CANDIDATE_URL, P.CANDIDATE_DATE, P.KEY_VALUE, P.INVOICE_REFERENCE))
POINT_EMAIL, POINT_WORDS = compiled(P.POINT_EMAIL), compiled(P.POINT_WORDS)
_DIGIT, _NO_WORD, _NO_AMOUNT, _BLANKS = re.compile("[0-9]"), re.compile("[^a-z0-9]+"), re.compile("[^0-9,.-]"), re.compile("[ \\t\\n\\x0b\\f\\r]+")
#: what every date has: its parts, or four digits by themselves
_MAYBE_DATE = re.compile("[0-9][/-][0-9]|\\b[0-9]{4}\\b", re.ASCII)
_CELLS = re.compile("[ \\t\\n\\x0b\\f\\r]{2,}|\\t|\\|")


def of_text(text: Column, made: str, plain: Callable[[str], object], other: Callable[[Column], Column]) -> Column:
    """``plain`` of each text of ASCII, as type ``made``; ``other``, an expression of the text, for any other text."""
    t = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(t) == F.char_length(t)
    return F.when(ascii_only, batch(made, plain)(F.when(ascii_only, t))).otherwise(other(t))


#: rows whose values are Python's at a time
SLICE = 512


def _in_slices(part: Callable[[pa.Array], pa.Array], kind: pa.DataType):
    def run(values: pa.Array) -> pa.Array:
        return pa.concat_arrays([part(values.slice(i, SLICE)) for i in range(0, len(values), SLICE)] or [pa.array([], type=kind)])

    return run


def batch(made: str, plain: Callable[[str], object]) -> Callable[..., Column]:
    """A function of columns: ``plain`` of each row's value, null for null."""
    kind = to_arrow_type(_parse_datatype_string(made))

    def part(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else plain(v) for v in values.to_pylist()], type=kind)

    return F.arrow_udf(_in_slices(part, kind), made)


def lines(text: str) -> list[str]:
    return [y for x in text.splitlines() if (y := x.strip())]


_FOLDED = str.maketrans(X._MARKED, X._PLAIN)


@lru_cache(MEMO)
def norm(text: str) -> str:
    low = text.lower()
    return _NO_WORD.sub(" ", low if low.isascii() else low.translate(_FOLDED)).strip(" ")


def pairs(ls: Iterable[str]) -> list[tuple[str, str, int]]:
    found = []
    for pos, x in enumerate(ls):
        key, colon, value = x.partition(":")
        if colon and (value := value.strip()) and (key := norm(key).replace(" ", "_")):
            found.append((key, value, pos))
    return found


def _last_point(digits: str) -> str:
    whole, point, rest = digits.replace(",", ".").rpartition(".")
    return whole.replace(".", "") + point + rest


def number(value: str) -> float | None:
    found = MONEY.search(value)
    return float(_last_point(_NO_AMOUNT.sub("", found[0]))) if found else None


def money_last(text: str) -> str | None:
    found = MONEY.findall(text) if _DIGIT.search(text) else None
    return found[-1].strip(" ") if found else None


def unique(values: Iterable[str]) -> list[str]:
    out: dict[str, str] = {}
    for v in values:
        if v := v.strip():
            out.setdefault(v.lower(), v)
    return list(out.values())


def date_ranges(ls: Sequence[str]) -> list[str]:
    dated = [x for x in ls if _DIGIT.search(x)]
    return [m[0] for x in dated if (m := DATE_RANGE.search(x))] or unique(d for x in dated for d in DATE.findall(x))


def pipe_table(ls: Iterable[str]) -> list[list[str]]:
    return [r for x in ls if "|" in x if any(r := [c.strip(" ") for c in x.split("|")])]


def table_items(rows: list[list[str]]) -> list[tuple[str, float | None, float | None, float | None]]:
    if not rows:
        return []
    head = [norm(c) for c in rows[0]]

    def place(*names: str) -> int | None:
        return next((i for n in names for i, c in enumerate(head) if n in c), None)

    d, p, q, t = place("description", "designation", "article", "item", "service"), place("price", "prix", "unit", "unitaire"), place("qty", "quantity", "quantite"), place("total", "montant")
    cell = lambda r, at: r[at] if at is not None and at < len(r) else ""
    return [(cell(r, d or 0), number(cell(r, p)), number(cell(r, q)), number(cell(r, t))) for r in rows[1:] if cell(r, d or 0)]


def important_points(text: str, most: int) -> list[str]:
    rows = []
    for i, x in enumerate(lines(text)):
        if len(x) > 3:
            low = x.lower()
            score = 3 * ("@" in low and POINT_EMAIL.search(low) is not None) + 2 * (_DIGIT.search(low) is not None) + 2 * (POINT_WORDS.search(low) is not None) + (":" in low)
            rows.append((-score, len(x), i, x))
    return unique(r[3] for r in sorted(rows))[:most]


# --- candidates ---

def value_type(value: str) -> str:
    v = value.strip(" ")
    if EMAIL.fullmatch(v):
        return "email"
    if URL.fullmatch(v):
        return "url"
    return "amount" if MONEY.search(value) else "date" if CANDIDATE_DATE.search(value) else "string"


def field_name(label: str) -> str:
    key = _NO_WORD.sub("_", label.strip(" ").lower()).strip("_")
    return P.FIELD_SYNONYMS.get(key, key) or "field"


def amount_field(low: str) -> str:
    for name, words in (("subtotal", ("sub", "sous-total", "sous total")), ("tax", ("tax", "vat", "tva")), ("total", ("total", "montant", "amount due"))):
        if any(w in low for w in words):
            return name
    return "amount"


def normalised_value(value: str, kind: str) -> str | None:
    v = value.strip(" ")
    if kind == "email":
        return v.lower()
    if kind == "phone":
        return _BLANKS.sub(" ", v)
    return _last_point(_NO_AMOUNT.sub("", v)) or None if kind == "amount" else v


def _trimmed(x: str, start: int, end: int) -> tuple[int, int]:
    """The span without the spaces at its ends."""
    v = x[start:end].lstrip(" ")
    return end - len(v), end - len(v) + len(v.rstrip(" "))


def _last_amount(x: str, start: int, end: int) -> tuple[int, int] | None:
    """Where ``money_last`` of the span is."""
    found = [m.span() for m in MONEY.finditer(x[start:end])] if _DIGIT.search(x, start, end) else None
    return _trimmed(x, start + found[-1][0], start + found[-1][1]) if found else None


def _cells(x: str) -> list[tuple[int, int]]:
    """The stripped parts of a table's line that are not blank."""
    edges = [0, *(e for m in _CELLS.finditer(x) for e in m.span()), len(x)]
    cells = [(i + len(c) - len(c.lstrip()), c.strip()) for i, j in zip(edges[::2], edges[1::2], strict=True) for c in (x[i:j],)]
    return [(i, i + len(c)) for i, c in cells if c]


def line_candidates(x: str, table: bool) -> tuple[list[tuple], list[tuple]]:
    """Where a line's candidates are, those of patterns and those of a table's parts.

    Each is (start, end, whether ``low`` is the value itself, start and end of ``normalized`` or -1 where it has to be made, (field, kind, source)).
    """
    low, out = x.lower(), []

    def add(field: str, span: tuple[int, int], kind: str, source: str = "ocr_pattern") -> None:
        start, end = span
        v = x[start:end]
        normal, kept = normalised_value(v, kind), _NO_AMOUNT.sub("", v) if kind == "amount" else v
        at = v.find(normal) if normal and normal == kept else -1
        out.append((start, end, v == v.lower(), *((start + at, start + at + len(normal)) if at >= 0 else (-1, -1)), (field, kind, source)))

    digits = _DIGIT.search(x) is not None
    if "@" in x:
        for m in EMAIL.finditer(x):
            add("email", _trimmed(x, *m.span()), "email")
    if digits:
        for m in PHONE.finditer(x):
            if len(_DIGIT.findall(m[0])) >= 7:
                add("phone", _trimmed(x, *m.span()), "phone")
    if "www." in low:
        for m in URL.finditer(x):
            add("url", _trimmed(x, *m.span()), "url")
    if digits:
        for m in CANDIDATE_DATE.finditer(x) if _MAYBE_DATE.search(x) else ():
            add("date", _trimmed(x, *m.span()), "date")
    if ":" in x and (kv := KEY_VALUE.search(x)) and (value := kv[2].strip(" ")):
        add(field_name(kv[1]), _trimmed(x, *kv.span(2)), value_type(value), "ocr_key_value")
    if any(w in low for w in P.REFERENCE_WORDS) and (found := REFERENCE.search(x)):
        add("invoice_number", found.span(1), "identifier")
    if amount := _last_amount(x, 0, len(x)):
        add(amount_field(low), amount, "amount")
    patterns, out = out, []
    parts = _cells(x) if table else []
    if len(parts) >= 2:
        for p in parts:
            if (amount := _last_amount(x, *p)) is not None:
                add("table_amount", amount, "amount", "ocr_table")
    return patterns, out


#: patterns tell no digit from another, so lines that differ in digits alone have their candidates in the same places
_SHAPE = bytes.maketrans(b"123456789", b"000000000")
LONG = 512  #: characters of the longest line whose shape a memo keeps


@lru_cache(MEMO)
def _of_shape(shape: str, table: bool) -> tuple[list[tuple], list[tuple]] | None:
    """``line_candidates`` of all lines of a shape; None where a field's name has digits, which are the line's own."""
    label = KEY_VALUE.search(shape) if ":" in shape else None
    return None if label and "0" in label[1] else line_candidates(shape, table)


@lru_cache(1024)
def _whole_numbers(joined: str) -> list[int | None]:
    return [int(v) if v else None for v in joined.split(" ")]


@lru_cache(1024)
def _rounded(joined: str) -> list[float]:
    """Doubles, rounded to four places as Spark does: by their decimal digits, halves up."""
    read = [float(v) for v in joined.split(" ")]
    return [float(Decimal(v).quantize(Decimal("0.0001"), ROUND_HALF_UP)) if abs(d) < 1e15 else d for v, d in zip(joined.split(" "), read, strict=True)]


def _read(of: Callable[[str], list], joined: str) -> list:
    return of(joined) if len(joined) <= 8 * LONG else of.__wrapped__(joined)


FOUND = "array<struct<page:int,field:string,pos:int,value:string,kind:string,source:string,confidence:double,normalized:string>>"


def _strings(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The stretches of a text's bytes, as strings."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    taken = letters[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(taken))


def candidates(rows: Iterable[tuple[str | None, ...]]) -> tuple[list[pa.Array], list[int]]:
    """Of documents' lines, as ``candidates_of`` takes them: their candidates, in the columns of ``FOUND``, and where each document's end.

    Candidates of patterns come before those of tables; of equal (field, value ignoring case, page) the first stays.
    All lines are one text of bytes, in which a candidate is a stretch: Python sees each shape once, the rest is done on arrays.
    """
    texts, tables, counts, pages, places, sure, others = [], [], [], [], [], [], {}
    for text, page, pos, confidence, table, made in rows:
        counts.append(len(table or ""))
        if table:
            if made:
                others.update((len(places) + int(i), found) for i, found in json.loads(made).items())
            texts.append(text)
            tables.append(table)
            pages += _read(_whole_numbers, page)
            places += _read(_whole_numbers, pos)
            sure += _read(_rounded, confidence)
    whole = "\0".join(texts).encode("ascii")
    size, more = len(whole), bytearray()  # ``more`` is what is no stretch of a line; it lies behind the text and its lower case
    starts = np.concatenate([[0], np.flatnonzero(np.frombuffer(whole, np.uint8) == 0) + 1]) if texts else np.zeros(0, np.int64)

    def put(value: str) -> tuple[int, int]:
        more.extend(made := value.encode())
        return 2 * size + len(more) - len(made), 2 * size + len(more)

    def letters() -> np.ndarray:
        return np.frombuffer(whole + whole.lower() + more, np.uint8)

    #: of each span, from its line's start on: start and end of value, low and normalized (-1: to be made, -2: null), number of its kind, whether it is a table's
    spans, first, held, kinds = [], [], [], {}

    def number(both: tuple[list[tuple], list[tuple]]) -> int:
        first.append(len(spans))
        for late, part in enumerate(both):
            for start, end, same, a, b, kind in part:
                low = 0 if same else size
                spans.append((start, end, low + start, low + end, a, b, kinds.setdefault(kind, len(kinds)), late))
        held.append(len(spans) - first[-1])
        return len(held) - 1

    def number_of_others(found: list[dict], at: int) -> int:
        first.append(len(spans))
        for c in found:
            value, low, normal = (None if (v := c.get(k)) is None else [i - at for i in put(v)] for k in ("value", "low", "normalized"))
            spans.append((*value, *low, *(normal or (-2, -2)), kinds.setdefault(tuple(c.get(k) for k in ("field", "kind", "source")), len(kinds)), int(c["late"])))
        held.append(len(spans) - first[-1])
        return len(held) - 1

    known, of = {"0": {}, "1": {}}, np.zeros(len(starts), np.int64)
    for i, (shape, table) in enumerate(zip(whole.translate(_SHAPE).split(b"\0") if texts else (), "".join(tables), strict=True)):
        k = known[table].get(shape)
        if others and i in others:
            k = number_of_others(others[i], int(starts[i]))
        elif k is None:
            both = _of_shape(shape.decode("ascii"), table == "1") if len(shape) <= LONG else None
            if both is None:
                k = number(line_candidates(whole[starts[i]:starts[i] + len(shape)].decode("ascii"), table == "1"))
            else:
                k = known[table][shape] = number(both)
        of[i] = k
    spans, n = np.array(spans, np.int64).reshape(-1, 8), np.array(held, np.int64)[of]
    line = np.repeat(np.arange(len(of)), n)
    span = spans[np.repeat(np.array(first, np.int64)[of] - np.cumsum(n) + n, n) + np.arange(len(line))]
    doc = np.repeat(np.arange(len(counts)), counts)[line]
    order = np.argsort(2 * doc + span[:, 7], kind="stable")
    line, span, doc = line[order], span[order], doc[order]
    span[:, :4] += starts[line, None]
    # of equal ones the first: the one whose code is greater than all before it
    code = lambda values: values.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
    fields = code(pa.array([k[0] for k in kinds], pa.string()))
    key = np.zeros(len(line), np.int64) + doc
    for part in (code(pa.array(pages, pa.int32()))[line], fields[span[:, 6]], code(_strings(letters(), span[:, 2], span[:, 3]))):
        key = code(pa.array(key * (part.max(initial=0) + 1) + part))
    kept = np.flatnonzero(key > np.concatenate([[-1], np.maximum.accumulate(key)[:-1]])) if len(key) else np.zeros(0, np.int64)
    line, span, doc = line[kept], span[kept], doc[kept]
    values, normal = _strings(letters(), span[:, 0], span[:, 1]), span[:, 4:6]
    made = normal[:, 0] == -1
    normal[normal[:, 0] != -2] += starts[line[normal[:, 0] != -2], None]
    of_kind = list(kinds)
    for i in np.flatnonzero(made).tolist():
        value = normalised_value(values[i].as_py(), of_kind[span[i, 6]][1])
        normal[i] = (-2, -2) if value is None else put(value)
    normalized = _strings(letters(), normal[:, 0], normal[:, 1])
    if (null := normal[:, 0] == -2).any():
        normalized = pa.compute.if_else(pa.array(~null), normalized, pa.scalar(None, pa.string()))
    field, kind, source = (pa.array([k[c] for k in of_kind], pa.string()).take(pa.array(span[:, 6])) for c in range(3))
    page, pos, confidence = (pa.array(c, t).take(pa.array(line)) for c, t in ((pages, pa.int32()), (places, pa.int32()), (sure, pa.float64())))
    ends = [0, *np.cumsum(np.bincount(doc, minlength=len(counts))).tolist()]
    return [page, field, pos, values, kind, source, confidence, normalized], ends


def candidates_of(text: Column, pages: Column, places: Column, sure: Column, tables: Column, made: Column) -> Column:
    """``candidates``, as ``FOUND``, of lines joined by NUL, of their pages, places and confidences joined by spaces, of a 1 or 0 each (1 in a table), and of candidates made elsewhere.

    ``made`` is JSON, place of a line -> its (late, field, value, low, kind, source, normalized).  All are
    strings, as Spark measures a batch of arrays anew for every row of it.
    """
    kind = to_arrow_type(_parse_datatype_string(FOUND))

    def run(text: pa.Array, pages: pa.Array, places: pa.Array, sure: pa.Array, tables: pa.Array, made: pa.Array) -> pa.Array:
        columns, parts = (text, pages, places, sure, tables, made), []
        for i in range(0, len(columns[0]), SLICE):
            out, ends = candidates(zip(*(c.slice(i, SLICE).to_pylist() for c in columns)))
            struct = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(out, kind.value_type)], fields=list(kind.value_type))
            parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct, type=kind))
        return pa.concat_arrays(parts or [pa.array([], type=kind)])

    return F.arrow_udf(run, FOUND)(text, pages, places, sure, tables, made)
