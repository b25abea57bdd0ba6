"""Language identification: a bidirectional gated recurrent network over bytes.

The text's UTF-8 bytes are cut into windows.  In each window one gated
recurrent layer reads forwards and one backwards; from both states a softmax
labels every byte, and a document's probabilities are the mean over all its
bytes that belong to letters.  The network is trained in numpy by
backpropagation through time.  Windows are lanes of one array, so that a very
long text is only more lanes, and memory depends on ``lanes`` alone.

A text that is null, empty or without letters (Unicode's L) is ``und`` with score 0.  Ties go
to the first label in alphabetical order.  Repeated rows get equal labels, one
for each row.  With no training rows every text is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Config:
    per_class: int = 150  #: documents of each language used for training, at most
    windows_each: int = 6  #: training windows drawn from each of them, anywhere in the text
    window: int = 96  #: bytes of a window
    hidden: int = 8  #: units of each direction
    lanes: int = 2048  #: windows labelled at once
    batch: int = 64
    epochs: int = 7
    rate: float = 0.02
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """For each direction: input table (3H, 256), recurrent matrix (3H, H), bias of the candidate's recurrent part (H, 1)."""

    labels: tuple[str, ...]
    table: tuple[np.ndarray, np.ndarray]
    inner: tuple[np.ndarray, np.ndarray]
    shift: tuple[np.ndarray, np.ndarray]
    out: np.ndarray  # (labels, 2H)
    bias: np.ndarray  # (labels, 1)
    window: int


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _forward(x: np.ndarray, table, inner, shift, backwards: bool):
    """All states of one direction over x (T, B), and what the gradients need."""
    steps, lanes = x.shape
    h = np.zeros((inner.shape[1], lanes), np.float32)
    size = len(h)
    states, kept = np.empty((steps, size, lanes), np.float32), [None] * steps
    for t in range(steps - 1, -1, -1) if backwards else range(steps):
        a, b = table[:, x[t]], inner @ h
        gates = _sigmoid(a[:2 * size] + b[:2 * size])
        z, r = gates[:size], gates[size:]
        m = b[2 * size:] + shift
        n = np.tanh(a[2 * size:] + r * m)
        kept[t] = (h, z, r, m, n)
        h = n + z * (h - n)
        states[t] = h
    return states, kept


def _backward(x, grads, kept, inner, table_shape, backwards: bool):
    """Backpropagation through time of one direction; grads (T, H, B) are those of the states."""
    steps, lanes = x.shape
    size = inner.shape[1]
    d_table, d_inner, d_shift = np.zeros(table_shape, np.float32), np.zeros_like(inner), np.zeros((size, 1), np.float32)
    carry = np.zeros((size, lanes), np.float32)
    for t in range(steps) if backwards else range(steps - 1, -1, -1):
        h, z, r, m, n = kept[t]
        g = grads[t] + carry
        dn = g * (1 - z) * (1 - n * n)
        dz = g * (h - n) * z * (1 - z)
        dr = dn * m * r * (1 - r)
        da = np.concatenate([dz, dr, dn])
        db = np.concatenate([dz, dr, dn * r])
        d_inner += db @ h.T
        d_shift += (dn * r).sum(1, keepdims=True)
        np.add.at(d_table.T, x[t], da.T)
        carry = g * z + inner.T @ db
    return d_table, d_inner, d_shift


def _probabilities(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-2, keepdims=True))
    return e / e.sum(-2, keepdims=True)


def windows(text: str, config: Config) -> list[bytes]:
    """Training windows at places drawn by a hash of the text; none for a text without letters."""
    raw = text.encode("utf-8", "replace")
    if not LETTER.search(text):
        return []
    room = max(1, len(raw) - config.window + 1)
    starts = np.random.default_rng([config.seed, crc32(raw)]).integers(0, room, config.windows_each).tolist()
    return [raw[at:at + config.window] for at in starts]


def fit(texts: list[str], labels: list[str], config: Config = Config()) -> Model | None:
    """Trains on windows drawn from the texts."""
    drawn = [(w, label) for text, label in zip(texts, labels, strict=True) for w in windows(text, config)]
    return fit_windows([w for w, _ in drawn], [label for _, label in drawn], config)


def fit_windows(drawn: list[bytes], labels: list[str], config: Config = Config()) -> Model | None:
    """Trains on windows; every byte of a window has its document's label."""
    c = config
    if not drawn:
        return None
    names = tuple(sorted(set(labels)))
    number = {name: k for k, name in enumerate(names)}
    rng = np.random.default_rng(c.seed)
    rows = [np.frombuffer(w.ljust(c.window, b"\0"), np.uint8) for w in drawn]
    marks = [(number[label], len(w)) for w, label in zip(drawn, labels, strict=True)]
    data, marks, hidden = np.stack(rows), np.array(marks), c.hidden

    def random(*shape, by):
        return (rng.normal(size=shape) * by).astype(np.float32)

    p = [random(3 * hidden, 256, by=0.3), random(3 * hidden, 256, by=0.3), random(3 * hidden, hidden, by=0.3), random(3 * hidden, hidden, by=0.3),
         random(hidden, 1, by=0.0), random(hidden, 1, by=0.0), random(len(names), 2 * hidden, by=0.3), random(len(names), 1, by=0.0)]
    first, second = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    step, total = 0, c.epochs * -(-len(data) // c.batch)
    for _ in range(c.epochs):
        order = rng.permutation(len(data))
        for s in range(0, len(order), c.batch):
            own = order[s:s + c.batch]
            x, y, size = data[own].T, marks[own, 0], marks[own, 1]
            ahead, kept_a = _forward(x, p[0], p[2], p[4], False)
            back, kept_b = _forward(x, p[1], p[3], p[5], True)
            both = np.concatenate([ahead, back], axis=1)  # (T, 2H, B)
            d = _probabilities(p[6] @ both + p[7])
            d[:, y, np.arange(len(own))] -= 1
            d *= (np.arange(len(x))[:, None] < size)[:, None, :] / np.float32(size.sum())
            d = d.astype(np.float32)
            d_states = p[6].T @ d
            ta, ia, sa = _backward(x, d_states[:, :hidden], kept_a, p[2], p[0].shape, False)
            tb, ib, sb = _backward(x, d_states[:, hidden:], kept_b, p[3], p[1].shape, True)
            grads = [ta, tb, ia, ib, sa, sb, np.einsum("tlb,thb->lh", d, both), d.sum((0, 2))[:, None]]
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            rate, step = c.rate * (1 - step / total), step + 1
            for i, g in enumerate(grads):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                p[i] = (p[i] - rate * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
    return Model(names, (p[0], p[1]), (p[2], p[3]), (p[4], p[5]), p[6], p[7], c.window)


class Reader:
    """Labels texts with a model; keeps the arrays it works in."""

    def __init__(self, model: Model, lanes: int = 2048):
        self.model, self.lanes = model, lanes
        hidden = model.inner[0].shape[1]
        self.hidden = hidden
        # sigmoid(v) = (1 + tanh(v/2)) / 2: halving what enters the gates leaves one tanh for both
        half = np.ones((3 * hidden, 1), np.float32)
        half[:2 * hidden] = 0.5
        self.table = [np.ascontiguousarray(t * half) for t in model.table]
        self.inner = [np.ascontiguousarray(w * half) for w in model.inner]

    def states(self, x: np.ndarray, k: int) -> np.ndarray:
        """(T, labels, B): what direction k adds to the logits of every position."""
        size, (steps, lanes) = self.hidden, x.shape
        table, inner, shift = self.table[k], self.inner[k], self.model.shift[k]
        out = self.model.out[:, k * size:(k + 1) * size]
        told = np.empty((steps, len(out), lanes), np.float32)
        h = np.zeros((size, lanes), np.float32)
        a, b = np.empty((3 * size, lanes), np.float32), np.empty((3 * size, lanes), np.float32)
        gates, cand = a[:2 * size], a[2 * size:]
        for t in range(steps - 1, -1, -1) if k else range(steps):
            np.take(table, x[t], axis=1, out=a, mode="clip")
            np.matmul(inner, h, out=b)
            gates += b[:2 * size]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            m = b[2 * size:]
            m += shift
            m *= gates[size:]
            cand += m
            np.tanh(cand, out=cand)
            h -= cand
            h *= gates[:size]
            h += cand
            np.matmul(out, h, out=told[t])
        return told

    def positions(self, x: np.ndarray) -> np.ndarray:
        """(T, labels, B): label probabilities of every position."""
        z = self.states(x, 0)
        z += self.states(x, 1)
        z += self.model.bias
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z

    def pooled(self, texts: list[str]) -> np.ndarray:
        """(texts, labels): the mean of the position probabilities of each whole text."""
        width = self.model.window
        raws = [t.encode("utf-8", "replace") for t in texts]
        sizes = np.array([len(r) for r in raws], np.int64)
        lanes = -(-sizes // width)
        owner = np.repeat(np.arange(len(texts)), lanes)
        buffer = np.zeros(int(lanes.sum()) * width, np.uint8)
        starts = (np.cumsum(lanes) - lanes) * width
        for r, at in zip(raws, starts.tolist(), strict=True):
            buffer[at:at + len(r)] = np.frombuffer(r, np.uint8)
        total = np.zeros((len(texts), len(self.model.labels)))
        grid = buffer.reshape(-1, width)
        left = sizes[owner] - (np.arange(len(owner)) - (np.cumsum(lanes) - lanes)[owner]) * width
        for s in range(0, len(grid), self.lanes):
            x = np.ascontiguousarray(grid[s:s + self.lanes].T)
            # bytes of letters: A-Z, a-z and all of multi-byte characters; padding is none
            folded = x | 32
            letter = ((folded >= 97) & (folded <= 122)) | (x >= 128)
            letter &= np.arange(width)[:, None] < left[s:s + self.lanes]
            sums = np.einsum("tlb,tb->bl", self.positions(x), letter.astype(np.float32))
            for k in range(sums.shape[1]):
                total[:, k] += np.bincount(owner[s:s + self.lanes], sums[:, k], len(texts))
        whole = total.sum(1, keepdims=True)
        return np.divide(total, whole, out=np.zeros_like(total), where=whole > 0)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          modulus: int = 5, remainder: int = 0, config: Config = Config()) -> Model | None:
    """Learns from rows with a non-null language outside the fold crc32(id) mod ``modulus`` = ``remainder``."""
    rows = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
            .filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~common.in_fold(F.col("id"), modulus, remainder)))
    bounds = common.class_bounds(rows, "lang", config.per_class)
    if not bounds:
        return None
    # one short row a language
    limits = docs.sparkSession.createDataFrame([(c, most) for c, _, most in bounds], "lang string, most long")
    picked = (rows.withColumn("rank", common.sample_rank("id", "lang")).join(F.broadcast(limits), "lang").filter(F.col("rank") < F.col("most"))
              .select("lang", "rank", "id", "text"))

    def draw(batches):
        for b in batches:
            found = [windows(t, config) for t in common.texts_of(b.column(3))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, pa.list_(pa.binary()))], names=["lang", "rank", "id", "windows"])

    # the texts stay in their tasks; what comes to the driver is windows_each * window bytes a picked row
    got = sorted(map(tuple, picked.mapInArrow(draw, "lang string, rank long, id long, windows array<binary>").collect()))
    taken, drawn, labels = {}, [], []
    for lang, _, _, found in got:
        taken[lang] = taken.get(lang, 0) + 1
        if taken[lang] <= config.per_class:
            drawn += map(bytes, found)
            labels += [lang] * len(found)
    model = fit_windows(drawn, labels, config)
    common.give_back()
    return model


def identify(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", config: Config = Config()) -> DataFrame:
    """id, lang_pred, score (probability of that language) and probabilities by language."""
    spark = docs.sparkSession
    common.small_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # of fixed size
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, probabilities array<double>"

    def run(batches):
        reader = sent.value and Reader(sent.value, config.lanes)
        for b in batches:
            texts = list(common.texts_of(b.column(1)))
            if reader:
                probs = reader.pooled(texts)
                best = probs.argmax(1)
                known = [bool(LETTER.search(t)) and probs[i, best[i]] > 0 for i, t in enumerate(texts)]
                names = [reader.model.labels[best[i]] if known[i] else "und" for i in range(len(texts))]
                scores = [float(min(1.0, probs[i, best[i]])) if known[i] else 0.0 for i in range(len(texts))]
                lists = probs.tolist()
            else:
                names, scores, lists = ["und"] * len(texts), [0.0] * len(texts), [[]] * len(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(lists, pa.list_(pa.float64()))],
                                             names=[id_col, "lang_pred", "score", "probabilities"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
