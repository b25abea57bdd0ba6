"""Providers: what reads pixels or runs models, behind one interface, with deterministic stand-ins.

A provider maps a pandas batch to a pandas batch.  It is opened once in each Python
worker, gets batch after batch, and a batch that fails is tried row by row, so that
one bad row costs that row alone.
"""

from __future__ import annotations

import hashlib
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Provider(Protocol):
    schema: str

    def __call__(self, batch: pd.DataFrame) -> pd.DataFrame: ...


def apply(rows: DataFrame, make: Callable[[], Provider], schema: str, *, id_col: str = "doc_id") -> DataFrame:
    """The provider's rows, and for each row that it fails on, one with its id and the error in ``error``.  ``schema`` must have both columns."""
    names = [x.strip().split()[0] for x in re.split(r",(?![^<]*>)", schema)]

    def run(parts):
        provider = make()
        for pdf in parts:
            try:
                out = provider(pdf)
            except Exception:
                found = []
                for i in range(len(pdf)):
                    one = pdf.iloc[i:i + 1]
                    try:
                        found.append(provider(one))
                    except Exception as e:
                        found.append(pd.DataFrame({id_col: one[id_col].to_numpy(), "error": [f"{type(e).__name__}: {e}"[:300]]}))
                rows = [r for f in found for r in f.to_dict("records")]
                out = pd.DataFrame({c: pd.Series([None if (v := r.get(c)) is None or v != v else v for r in rows], dtype=object) for c in names})
            yield out[names]

    return rows.mapInPandas(run, schema)


LINE_SCHEMA = "doc_id long, page int, line_idx int, text string, x1 int, y1 int, x2 int, y2 int, confidence double, error string"


class TextLines:
    """A stand-in for recognition: UTF-8 text in ``content`` becomes lines at a fixed pitch."""

    schema = LINE_SCHEMA

    def __call__(self, batch: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for i, content in zip(batch["doc_id"], batch["content"]):
            for k, line in enumerate(x for x in bytes(content).decode("utf-8").splitlines() if x.strip()):
                rows.append((i, 1, k, line.strip(), 40, 40 + 24 * k, 40 + 9 * len(line.strip()), 58 + 24 * k, 1.0, None))
        return pd.DataFrame(rows, columns=["doc_id", "page", "line_idx", "text", "x1", "y1", "x2", "y2", "confidence", "error"])


class HashEmbeddings:
    """A stand-in for a sentence model: signed word hashes, scaled to length one."""

    schema = "doc_id long, embedding array<double>, error string"

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for text in batch["text"]:
            v = np.zeros(self.dim)
            for w in re.findall(r"\w+", (text or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.dim] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "embedding": out, "error": None})


class SvgText:
    """The text of SVG files with its place under the transforms above it; widths are guessed from letters."""

    schema = LINE_SCHEMA

    def __call__(self, batch: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for i, content in zip(batch["doc_id"], batch["content"]):
            for k, (text, x, y, size) in enumerate(sorted(self.fragments(ET.fromstring(bytes(content))), key=lambda f: (f[2], f[1]))):
                rows.append((i, 1, k, text, round(x), round(y - size), round(x + self.width(text, size)), round(y), 1.0, None))
        return pd.DataFrame(rows, columns=["doc_id", "page", "line_idx", "text", "x1", "y1", "x2", "y2", "confidence", "error"])

    @staticmethod
    def width(text: str, size: float) -> float:
        return sum(0.3 if c in " .,:;il|'!" else 0.9 if c in "mwMW@%" else 0.65 if c.isupper() else 0.55 for c in text) * size

    @staticmethod
    def matrix(transform: str) -> np.ndarray:
        out = np.eye(3)
        for name, args in re.findall(r"(\w+)\s*\(([^)]*)\)", transform or ""):
            a = [float(x) for x in re.findall(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", args)]
            m = np.eye(3)
            if name == "translate" and a:
                m[0, 2], m[1, 2] = a[0], a[1] if len(a) > 1 else 0.0
            elif name == "scale" and a:
                m[0, 0], m[1, 1] = a[0], a[1] if len(a) > 1 else a[0]
            elif name == "rotate" and a:
                c, s = np.cos(np.radians(a[0])), np.sin(np.radians(a[0]))
                m[:2, :2] = [[c, -s], [s, c]]
                if len(a) == 3:
                    m[:2, 2] = np.array(a[1:]) - m[:2, :2] @ np.array(a[1:])
            elif name == "matrix" and len(a) == 6:
                m[:2] = np.array(a).reshape(3, 2).T
            out = out @ m
        return out

    def fragments(self, node: ET.Element, above: np.ndarray | None = None, size: float = 16.0):
        here = (np.eye(3) if above is None else above) @ self.matrix(node.get("transform", ""))
        given = re.match(r"[\d.]+", node.get("font-size", ""))
        size = float(given.group()) if given else size
        tag = node.tag.rpartition("}")[2]
        if tag in ("text", "tspan") and (node.text or "").strip():
            x, y, _ = here @ np.array([float(node.get("x", "0").split()[0]), float(node.get("y", "0").split()[0]), 1.0])
            yield " ".join(node.text.replace(" ", " ").replace("﻿", "").split()), x, y, size * float(np.hypot(here[0, 1], here[1, 1]))
        for child in node:
            yield from self.fragments(child, here, size)


IMAGE_SCHEMA = "doc_id long, brightness double, contrast double, sharpness double, foreground double, noise double, error string"


class GreyMetrics:
    """Measures of a raw grey image: ``content`` holds ``height`` rows of ``width`` bytes."""

    schema = IMAGE_SCHEMA

    def __call__(self, batch: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for i, content, w, h in zip(batch["doc_id"], batch["content"], batch["width"], batch["height"]):
            g = np.frombuffer(bytes(content), np.uint8).reshape(int(h), int(w)).astype(float)
            edges = 4 * g[1:-1, 1:-1] - g[:-2, 1:-1] - g[2:, 1:-1] - g[1:-1, :-2] - g[1:-1, 2:]
            blurred = (g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:]) / 4
            rows.append((i, g.mean(), g.std(), edges.var(), float((g < 210).mean()), float(np.abs(g[1:-1, 1:-1] - blurred).mean()), None))
        return pd.DataFrame(rows, columns=["doc_id", "brightness", "contrast", "sharpness", "foreground", "noise", "error"])


class Rules:
    """A stand-in for a language model: answers a prompt's JSON of candidates with those that its text holds."""

    schema = "doc_id long, answer string, error string"

    def __call__(self, batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for prompt in batch["prompt"]:
            asked = json.loads(prompt)
            out.append(json.dumps({k: v for k, v in asked.get("candidates", {}).items() if str(v) and str(v) in asked.get("text", "")}, ensure_ascii=False))
        return pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "answer": out, "error": None})
