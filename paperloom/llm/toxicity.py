"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its character n-grams and of the
word itself, all kept in one hashed table; a document's vector is the mean over
its words; a softmax layer reads that.  Table and layer are trained jointly in
numpy, so a misspelling never seen in training still has most of the n-grams of
the word it stems from.

The averaging and the layer are both linear, so scoring needs one number per
word: the layer's reading of the word's vector.  Words are memoised per Python
worker, which makes the cost of a text one dictionary lookup a word.

Null, empty and wordless texts get the score of an empty bag, which is what the
bias alone says.  Repeated rows get equal scores, one for each row.  Without
any training rows the score is 0 everywhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Config:
    per_class: int = 2500  #: labelled rows of each class used for training, at most
    buckets: int = 1 << 17  #: rows of the hashed n-gram table
    dim: int = 6
    least: int = 3  #: shortest n-gram
    most: int = 6  #: longest n-gram
    epochs: int = 6
    rate: float = 4.0
    decay: float = 1e-4
    least_docs: int = 6  #: buckets found in fewer training documents stay zero: they would only memorise
    least_z: float = 4.0  #: so do those whose share of documents differs by fewer standard errors between the labels
    seed: int = 5


@dataclass(frozen=True)
class Model:
    cells: np.ndarray  #: for each n-gram bucket, the layer's reading of its vector (logit of class 1 over class 0)
    bias: float
    least: int
    most: int
    trained: bool


def subwords(word: str, buckets: int, least: int, most: int) -> list[int]:
    """The buckets of a word and of its n-grams; < and > mark its ends."""
    w = f"<{word}>".encode("utf-16-le")  # two bytes a letter, so that slices hold whole letters
    n = len(w)
    out = [crc32(w) % buckets]
    out += [crc32(w[i:i + k]) % buckets for k in range(2 * least, 2 * most + 1, 2) for i in range(0, n - k + 1, 2)]
    return out


def bag(text: str, memo: common.Memo) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of a text: each word weighs the same, and so does each subword of a word."""
    seen: dict[str, int] = {}
    for w in WORD.findall(text.lower()):
        seen[w] = seen.get(w, 0) + 1
    if not seen:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    ids, counts = [memo[w] for w in seen], np.array(list(seen.values()), np.float64)
    sizes = np.array([len(x) for x in ids])
    flat = np.concatenate(ids)
    weights = np.repeat(counts / sizes / counts.sum(), sizes)
    order, place = np.unique(flat, return_inverse=True)
    return order.astype(np.int32), np.bincount(place, weights).astype(np.float32)


def fit(texts: list[str], labels: np.ndarray, frequency: dict, config: Config = Config()) -> Model:
    """Trains table and layer jointly by Adagrad steps, one document at a time.

    ``frequency`` has how often each label occurs over all labelled rows; the
    bias is moved from the sample's odds to those.
    """
    c = config
    if not texts or len(set(labels.tolist())) < 2:
        only = float(labels[0]) if len(labels) else 0.0
        return Model(np.zeros(c.buckets, np.float32), 30.0 if only else -30.0, c.least, c.most, False)
    rng = np.random.default_rng(c.seed)
    floor = min(c.least_docs, max(2, len(texts) // 100))
    memo = common.Memo(lambda w: np.array(subwords(w, c.buckets, c.least, c.most), np.int64))
    bags = [bag(t, memo) for t in texts]
    found = np.zeros((2, c.buckets))
    for (ids, _), label in zip(bags, labels, strict=True):
        found[label, ids] += 1
    sizes = np.bincount(labels, minlength=2)[:2]
    share = found.sum(0) / sizes.sum()
    error = np.sqrt(share * (1 - share) * (1 / sizes).sum()) + 1e-9
    used = (found.sum(0) >= floor) & (np.abs(found[1] / sizes[1] - found[0] / sizes[0]) >= c.least_z * error)
    bags = [(ids[k], w[k]) for ids, w in bags for k in [used[ids]]]
    table = rng.normal(0, 0.02, (c.buckets, c.dim)).astype(np.float32)
    table[~used] = 0
    table_sum = np.full(c.buckets, 1e-10, np.float32)
    layer = rng.normal(0, 1.0, (c.dim, 2)).astype(np.float32)
    layer_sum = np.full((c.dim, 2), 1e-2, np.float32)
    bias, bias_sum = np.zeros(2, np.float32), np.full(2, 1e-2, np.float32)
    for epoch in range(c.epochs):
        rate = np.float32(c.rate * (1 - epoch / c.epochs))
        for i in rng.permutation(len(bags)):
            ids, w = bags[i]
            pooled = w @ table[ids] if len(ids) else np.zeros(c.dim, np.float32)
            logits = pooled @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = layer @ p
            step = np.outer(pooled, p)
            layer_sum += step * step
            layer -= np.float32(0.1) * rate * (step / np.sqrt(layer_sum) + np.float32(c.decay) * layer)
            bias_sum += p * p
            bias -= rate * p / np.sqrt(bias_sum)
            if len(ids):
                # the gradient of a row is w[row] * back: its mean square, one number for the row
                table_sum[ids] += w * w * np.float32((back * back).mean())
                table[ids] -= rate * ((w / np.sqrt(table_sum[ids]))[:, None] * back[None, :] + np.float32(c.decay) * table[ids])
    cells = table @ (layer[:, 1] - layer[:, 0])
    shift = float(bias[1] - bias[0])
    n1, n0 = max(1, int((labels == 1).sum())), max(1, int((labels == 0).sum()))
    f1, f0 = max(1, frequency.get(1, n1)), max(1, frequency.get(0, n0))
    shift += np.log(f1 / f0) - np.log(n1 / n0)
    return Model(cells.astype(np.float32), shift, c.least, c.most, True)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          modulus: int = 5, remainder: int = 0, config: Config = Config()) -> Model:
    """Learns from labelled rows outside the fold crc32(id) mod ``modulus`` = ``remainder``."""
    model = fit(*common.labelled_texts(docs, labels, label_col, id_col, text_col, modulus, remainder, config.per_class), config)
    common.give_back()
    return model


def scorer(model: Model):
    """text -> probability of class 1."""
    cells, size = model.cells.astype(np.float64).tolist(), len(model.cells)

    def reading(word: str) -> float:
        ids = subwords(word, size, model.least, model.most)
        return sum(map(cells.__getitem__, ids)) / len(ids)

    memo = common.Memo(reading)
    look = memo.__getitem__

    def score(text: str) -> float:
        words = WORD.findall(text.lower())
        z = model.bias + (sum(map(look, words)) / len(words) if words else 0.0)
        return float(1 / (1 + np.exp(-min(50.0, max(-50.0, z)))))

    return score


def score_documents(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, a double from 0 to 1.  All its columns stay; a column named ``score_col`` is replaced."""
    spark = docs.sparkSession
    common.small_batches(spark)
    kept = docs.drop(score_col)
    sent = spark.sparkContext.broadcast(model)  # of fixed size: ``buckets`` numbers
    at = kept.columns.index(text_col)

    def run(batches):
        score = scorer(sent.value)
        for b in batches:
            s = pa.array([score(t) for t in common.texts_of(b.column(at))], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, s], names=[*b.schema.names, score_col])

    return kept.mapInArrow(run, common.plus(kept, (score_col, T.DoubleType())))


def reject(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with the columns of ``docs``."""
    name = common.fresh(docs, "toxicity")
    scored = score_documents(docs, model, text_col=text_col, score_col=name)
    return scored.filter(F.col(name) < threshold).drop(name)
