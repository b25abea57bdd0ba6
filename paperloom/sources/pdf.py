"""Text PDFs read with zlib and patterns: pages, their number, and their lines with boxes.

Objects are found in the file and in its object streams; streams may be plain or
deflated.  Shown strings are placed by the text and transformation matrices; those
of one baseline are a line, in order from the left.  Letters are read as Latin-1
(or UTF-16 with a mark), and a string's width is guessed as half its size a letter.
Fonts with encodings of their own, encryption and other filters are not read: such
pages have no lines and are left to recognition.

A file that is null or no PDF has one page, as images have, and no lines.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.S)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"][A-Za-z0-9*]*", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}  # fixed values


def stream_of(body: bytes) -> bytes:
    """A stream's bytes, inflated; empty for one that cannot be read."""
    m = STREAM.search(body)
    if not m:
        return b""
    head, data = body[:m.start()], m.group(1)
    if b"/FlateDecode" in head:
        try:
            return zlib.decompressobj().decompress(data)
        except zlib.error:
            return b""
    return b"" if b"/Filter" in head else data


def objects(data: bytes) -> dict[int, bytes]:
    out = {int(n): body for n, body in OBJECT.findall(data)}
    for body in list(out.values()):
        if re.search(rb"/Type\s*/ObjStm\b", body):
            first = re.search(rb"/First\s+(\d+)", body)
            inner = stream_of(body)
            if first and inner:
                at = int(first.group(1))
                pairs = list(map(int, inner[:at].split()))
                places = list(zip(pairs[::2], pairs[1::2], strict=False))
                ends = [p for _, p in places[1:]] + [len(inner) - at]
                out |= {n: inner[at + p:at + e] for (n, p), e in zip(places, ends, strict=True) if n not in out}
    return out


def pages(found: dict[int, bytes]) -> list[bytes]:
    """The pages in the order of the page tree, or of their numbers where there is none."""
    def is_kind(body: bytes, kind: bytes) -> bool:
        return re.search(rb"/Type\s*/" + kind + rb"(?![A-Za-z])", body) is not None

    out, seen = [], set()

    def walk(n: int) -> None:
        body = found.get(n)
        if body is None or n in seen:
            return
        seen.add(n)
        if is_kind(body, b"Pages"):
            kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
            for k in re.findall(rb"(\d+)\s+\d+\s+R", kids.group(1) if kids else b""):
                walk(int(k))
        elif is_kind(body, b"Page"):
            out.append(body)

    for n, body in found.items():
        if is_kind(body, b"Catalog"):
            root = re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", body)
            if root:
                walk(int(root.group(1)))
    return out or [found[n] for n in sorted(found) if is_kind(found[n], b"Page")]


def page_number(data: bytes | None) -> int:
    if not data or not data.startswith(b"%PDF"):
        return 1
    return max(1, len(pages(objects(data))))


def shown(token: bytes) -> str:
    """The text of a string in brackets or in hexadecimal."""
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        def plain(m: re.Match) -> bytes:
            c = m.group(1)
            return bytes([int(c, 8) & 255]) if c[:1].isdigit() else ESCAPES.get(c, b"" if c in b"\r\n" else c)

        raw = re.sub(rb"\\([0-7]{1,3}|\r\n|.)", plain, token[1:-1], flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def strings(content: bytes) -> Iterator[tuple[str, float, float, float]]:
    """(text, x, baseline, size) of what a content stream shows, in page units from the bottom left."""
    stack, ctm, text, line = [], np.eye(3), np.eye(3), np.eye(3)
    size, leading, held, inside = 12.0, 0.0, [], False

    def moved(x: float, y: float) -> np.ndarray:
        return np.array([[1, 0, 0], [0, 1, 0], [x, y, 1.0]])

    def matrix(a: list) -> np.ndarray:
        return np.array([[a[0], a[1], 0], [a[2], a[3], 0], [a[4], a[5], 1.0]])

    for token in TOKEN.findall(content):
        if token[:1] in b"(<[]/" or re.fullmatch(rb"[-+]?(?:\d+\.?\d*|\.\d+)", token):
            held.append(token)
            continue
        a = [float(x) for x in held if re.fullmatch(rb"[-+]?(?:\d+\.?\d*|\.\d+)", x)]
        if token == b"q":
            stack.append(ctm)
        elif token == b"Q":
            ctm = stack.pop() if stack else ctm
        elif token == b"cm" and len(a) >= 6:
            ctm = matrix(a[-6:]) @ ctm
        elif token == b"BT":
            text = line = np.eye(3)
        elif token == b"Tf" and a:
            size = a[-1]
        elif token == b"TL" and a:
            leading = a[-1]
        elif token in (b"Td", b"TD") and len(a) >= 2:
            leading = -a[-1] if token == b"TD" else leading
            text = line = moved(*a[-2:]) @ line
        elif token == b"Tm" and len(a) >= 6:
            text = line = matrix(a[-6:])
        elif token == b"T*":
            text = line = moved(0, -leading) @ line
        elif token in (b"Tj", b"TJ", b"'", b'"'):
            if token in (b"'", b'"'):
                text = line = moved(0, -leading) @ line
            out = ""
            inside = token == b"TJ"
            for x in held:
                if x[:1] in b"(<":
                    out += shown(x)
                elif inside and x[:1] not in b"[]/" and float(x) < -200:  # a gap as wide as a space
                    out += " "
            at = text @ ctm
            if out.strip():
                yield out, float(at[2, 0]), float(at[2, 1]), abs(size * float(np.hypot(at[1, 0], at[1, 1])))
            text = moved(0.5 * size * len(out), 0) @ text
        held = []


def page_lines(data: bytes | None) -> Iterator[tuple[int, int, str, int, int, int, int]]:
    """(page from 1, line, text, x1, y1, x2, y2), from the top left."""
    if not data or not data.startswith(b"%PDF"):
        return
    found = objects(data)
    for n, page in enumerate(pages(found), 1):
        box = re.search(rb"/MediaBox\s*\[\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)", page)
        top = float(box.group(4)) if box else 842.0
        refs = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.S)
        content = b"\n".join(stream_of(found.get(int(k), b"")) for k in re.findall(rb"(\d+)\s+\d+\s+R", refs.group(1) if refs else b""))
        rows: dict[int, list] = {}
        for text, x, y, size in strings(content):
            rows.setdefault(round(top - y), []).append((x, text, size))
        for k, y in enumerate(sorted(rows)):
            parts = sorted(rows[y])
            size = max(s for _, _, s in parts)
            text = " ".join(" ".join(t for _, t, _ in parts).split())
            yield n, k, text, round(parts[0][0]), round(y - size), round(max(x + 0.5 * s * len(t) for x, t, s in parts)), y


def _mapped(files: DataFrame, schema: str, kinds: list, of) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            rows = [r for i, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in of(i, content and bytes(content))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return files.select("doc_id", "content").mapInArrow(run, schema)


def page_counts(files: DataFrame) -> DataFrame:
    """(doc_id, n_pages) of files (doc_id, content)."""
    return _mapped(files, "doc_id long, n_pages int", [pa.int64(), pa.int32()], lambda i, data: [(i, page_number(data))])


def lines(files: DataFrame) -> DataFrame:
    """(doc_id, page, line_idx, text, x1, y1, x2, y2, confidence) of files (doc_id, content)."""
    schema = "doc_id long, page int, line_idx int, text string, x1 int, y1 int, x2 int, y2 int, confidence double"
    return _mapped(files, schema, [pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.int32()] * 4, pa.float64()], lambda i, data: ((i, *r, 1.0) for r in page_lines(data)))
