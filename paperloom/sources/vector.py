"""The text of SVG drawings as lines with boxes in pixels.

A drawing's text parts are put where the transforms above them say, scaled from
its view box to the wanted size, and given a width by their letters.  Parts whose
baselines lie near a row's mean are one row; a row is cut where the gap between two
parts is wide; what is left between cuts is a line.

A drawing that is null or cannot be parsed, or has no size, gives no lines.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .providers import SvgText

NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
# fixed values: the share of its height that a letter takes
WIDTHS = ((" \t\n\r\x0b\x0c", 0.30), (".,:;|!", 0.22), ("MW@#%", 0.78))
OTHER_WIDTH = 0.52
# fixed values: parts that lean on what stands before, that part two words, and endings that lean on what follows
CLOSING, DASHES, OPENING = {",", ".", ";", ":", ")", "]", "}"}, {"-", "–", "—"}, ("(", "[", "{", "/", "-")


@dataclass
class Part:
    text: str
    x: float
    base: float
    height: float
    box: tuple[int, int, int, int]


def numbers(text: str | None) -> list[float]:
    return [float(x) for x in NUMBER.findall(text or "")]


def length(text: str | None, default: float) -> float:
    found = numbers(text)
    return found[0] if found else default


def cleaned(text: str) -> str:
    return " ".join(text.replace("\u00a0", " ").replace("\ufeff", "").split())


def width(text: str, height: float) -> float:
    def share(c: str) -> float:
        return next((w for letters, w in WIDTHS if c in letters), 0.30 if c.isspace() else OTHER_WIDTH)

    return height * max(0.7, sum(map(share, text)))


def joined(parts: list[str]) -> str:
    """Parts as one text: no space before closing marks or behind opening ones, one on both sides of a dash."""
    out = ""
    for part in filter(None, map(cleaned, parts)):
        if not out:
            out = part
        elif part in CLOSING:
            out = out.rstrip() + part
        elif part in DASHES:
            out = f"{out.rstrip()} {part} "
        else:
            out = out + part if out.endswith(OPENING) else f"{out.rstrip()} {part}"
    return " ".join(out.split())


def view_box(root: ET.Element) -> tuple[float, float, float, float]:
    found = numbers(root.get("viewBox") or root.get("viewbox"))
    return tuple(found[:4]) if len(found) >= 4 else (0.0, 0.0, length(root.get("width"), 595.0), length(root.get("height"), 842.0))


def class_sizes(root: ET.Element) -> dict[str, float]:
    """Font sizes in pixels of the classes that style sheets name."""
    sheets = "".join("".join(e.itertext()) for e in root.iter() if _local(e) == "style")
    return {name: float(size) for name, size in re.findall(r"\.([\w-]+)\s*\{[^}]*?font-size\s*:\s*(\d+\.?\d*|\.\d+)px", sheets)}


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def font_height(e: ET.Element, matrix, sizes: dict[str, float]) -> float:
    size = length(e.get("font-size"), 12.0)
    for inner in e.iter():
        for name in (inner.get("class") or "").split():
            size = sizes.get(name, size)
    return max(6.0, abs(matrix[1, 1]) * size)


def raw_parts(e: ET.Element, sizes: dict[str, float], above=None) -> Iterator[tuple[str, float, float, float]]:
    """(text, x, baseline, font height) in the drawing's units; a text element is one part."""
    own = SvgText.matrix(e.get("transform", ""))
    here = own if above is None else above @ own
    if _local(e) == "text":
        text = cleaned("".join(e.itertext()))
        inner = next((c for c in e.iter() if c.get("x") or c.get("y")), e)
        x, y = (length(e.get(k), length(inner.get(k), 0.0)) for k in ("x", "y"))
        if text:
            yield text, here[0, 0] * x + here[0, 1] * y + here[0, 2], here[1, 0] * x + here[1, 1] * y + here[1, 2], font_height(e, here, sizes)
        return
    for child in e:
        yield from raw_parts(child, sizes, here)


def parts(root: ET.Element, to_width: int, to_height: int) -> list[Part]:
    left, top, wide, high = view_box(root)
    if min(wide, high, to_width, to_height) <= 0:
        return []
    sx, sy, out = to_width / wide, to_height / high, []
    for text, x, y, size in raw_parts(root, class_sizes(root)):
        x, y, size = (x - left) * sx, (y - top) * sy, max(8.0, size * sy)
        box = (max(0, round(x)), max(0, round(y - 1.05 * size)), min(to_width, round(x + width(text, size))), min(to_height, round(y + 0.25 * size)))
        if box[0] < box[2] and box[1] < box[3]:
            out.append(Part(text, x, y, size, box))
    return out


def rows_of(found: list[Part]) -> list[list[Part]]:
    """Parts by baseline: a part joins the first row whose mean baseline is within 5 pixels or 0.48 of the row's greatest height."""
    rows: list[list[Part]] = []
    for p in sorted(found, key=lambda p: (p.base, p.x)):
        near = (r for r in rows if abs(p.base - sum(q.base for q in r) / len(r)) <= max(5.0, 0.48 * max(q.height for q in r)))
        own = next(near, None)
        if own is None:
            rows.append([p])
        else:
            own.append(p)
    return rows


def lines_of(row: list[Part], to_width: int) -> list[list[Part]]:
    """A row from left to right, cut where a gap is over 90 pixels, 0.08 of the width and four heights."""
    out: list[list[Part]] = []
    for p in sorted(row, key=lambda p: p.x):
        if out and p.box[0] - out[-1][-1].box[2] <= max(90.0, 0.08 * to_width, 4 * max(q.height for q in [*out[-1], p])):
            out[-1].append(p)
        else:
            out.append([p])
    return out


def drawing_lines(content: bytes | None, to_width: int, to_height: int) -> list[tuple[str, int, int, int, int]]:
    """(text, x1, y1, x2, y2) of a drawing's lines, from the top."""
    try:
        root = ET.fromstring(bytes(content or b""))
    except ET.ParseError:
        return []
    out = []
    for line in (line for row in rows_of(parts(root, to_width, to_height)) for line in lines_of(row, to_width)):
        x1, y1, x2, y2 = (f(p.box[k] for p in line) for k, f in enumerate((min, min, max, max)))
        text = joined([p.text for p in line])
        if text:
            x1, y1 = min(to_width, x1), min(to_height, y1)
            out.append((text, x1, y1, max(x1 + 1, min(to_width, x2)), max(y1 + 1, min(to_height, y2))))
    return sorted(out, key=lambda r: (r[2], r[1]))


def svg_lines(files: DataFrame, to_width: int = 595, to_height: int = 842) -> DataFrame:
    """(doc_id, page, line_idx, text, x1, y1, x2, y2, confidence, language) of drawings (doc_id, content)."""
    schema = "doc_id long, page int, line_idx int, text string, x1 int, y1 int, x2 int, y2 int, confidence double, language string"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.int32()] * 4, pa.float64(), pa.string()]

    def run(batches):
        for b in batches:
            rows = [(i, 1, k, *line, 1.0, "vector") for i, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, line in enumerate(drawing_lines(content, to_width, to_height))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return files.select("doc_id", "content").mapInArrow(run, schema)
