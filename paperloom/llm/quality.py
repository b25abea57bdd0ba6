"""Quality classifier: random-indexing word vectors, pooled, then a two-layer network.

Every word has a sparse random index vector, made from a hash of the word.  A
word's vector is the sum of the index vectors of its neighbours over the
training sample, scaled to length one; words that the sample does not hold
share the vector of their shape (case, digits, symbols).  A document is the
mean of its words' vectors, the mean of their squares, and the length of the
mean index vector, which is large where few words repeat.  A network with one
hidden layer reads that; its probabilities are calibrated by a temperature fitted
on training rows that the network has not seen.

Null and empty texts pool to zeros and get the score of that vector.  Repeated
rows get equal scores, one for each row.  Without two classes in the training
rows the score is the one label's share, 0 without any.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")


@dataclass(frozen=True)
class Config:
    per_class: int = 2500  #: labelled rows of each class used for training, at most
    dim: int = 48
    signs: int = 4  #: non-zero cells of an index vector
    index_rows: int = 4096  #: index vectors; a word has the one its hash names
    reach: int = 2  #: neighbours on each side
    least: int = 3  #: times a word must occur in the sample to have its own vector
    words: int = 30_000  #: words with a vector of their own, at most
    hidden: int = 24
    epochs: int = 40
    batch: int = 32
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 11


@dataclass(frozen=True)
class Model:
    vocabulary: dict[str, int]
    vectors: np.ndarray  # (words + shapes, dim)
    index: np.ndarray  # (index_rows, dim)
    centre: np.ndarray
    spread: np.ndarray
    layers: tuple
    temperature: float
    constant: float | None  #: the score where nothing could be learned


SHAPES = 8


def shape(word: str) -> int:
    """Lower, capitalised, upper, mixed letters; with digits; one symbol, few symbols, many symbols."""
    if word[0].isalnum():
        if not word.isalpha():
            return 4
        return 0 if word.islower() else 1 if word.istitle() else 2 if word.isupper() else 3
    return 5 + min(2, len(word) - 1)


def index_vectors(config: Config) -> np.ndarray:
    rng = np.random.default_rng(config.seed)
    out = np.zeros((config.index_rows, config.dim), np.float32)
    for row in out:
        row[rng.choice(config.dim, config.signs, replace=False)] = rng.choice([-1, 1], config.signs)
    return out / np.sqrt(np.float32(config.signs))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def word_vectors(texts: list[str], index: np.ndarray, config: Config) -> tuple[dict[str, int], np.ndarray]:
    """The vocabulary and the vectors of its words, then of the shapes."""
    counts: dict[str, int] = {}
    split = [TOKEN.findall(t) for t in texts]
    for words in split:
        for w in words:
            counts[w] = counts.get(w, 0) + 1
    kept = sorted((w for w, n in counts.items() if n >= config.least), key=lambda w: (-counts[w], w))[:config.words]
    vocabulary = {w: i for i, w in enumerate(kept)}
    vectors = np.zeros((len(kept) + SHAPES, index.shape[1]), np.float32)
    hashed = common.Memo(lambda w: crc32(w.encode()) % len(index))
    shapes = common.Memo(lambda w: len(kept) + shape(w))
    for words in split:
        if len(words) < 2:
            continue
        own = index[[hashed[w] for w in words]]
        sums = np.zeros_like(own)
        for k in range(1, config.reach + 1):
            sums[k:] += own[:-k]
            sums[:-k] += own[k:]
        places = np.array([shapes[w] for w in words])
        np.add.at(vectors, places, sums)
        known = [(i, vocabulary[w]) for i, w in enumerate(words) if w in vocabulary]
        if known:
            at, ids = np.array(known).T
            np.add.at(vectors, ids, sums[at])
    return vocabulary, _unit(vectors)


class Pooler:
    """Text -> features."""

    def __init__(self, vocabulary: dict[str, int], vectors: np.ndarray, index: np.ndarray):
        self.vectors, self.index, n = vectors, index, len(vocabulary)
        self.memo = common.Memo(lambda w: (vocabulary[w] if w in vocabulary else n + shape(w)) << 32 | crc32(w.encode()) % len(index))

    def __call__(self, text: str) -> np.ndarray:
        words = TOKEN.findall(text)
        dim = self.vectors.shape[1]
        out = np.zeros(2 * dim + 3, np.float32)
        if words:
            codes, counts = np.unique(np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words)), return_counts=True)
            share = (counts / len(words)).astype(np.float32)
            own = self.vectors[codes >> 32]
            out[:dim] = share @ own
            out[dim:2 * dim] = share @ (own * own)
            out[-3] = np.linalg.norm(share @ self.index[codes & 0xFFFFFFFF])
            out[-2] = np.log1p(len(words))
            out[-1] = len(codes) / len(words)
        return out


def _logits(layers, x: np.ndarray) -> np.ndarray:
    w1, b1, w2, b2 = layers
    return np.tanh(x @ w1 + b1) @ w2 + b2


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _network(x, y, weights, config: Config):
    rng = np.random.default_rng(config.seed)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], config.hidden)), np.zeros(config.hidden), rng.normal(0, 0.3, (config.hidden, 2)), np.zeros(2)]
    first, second, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    total = config.epochs * -(-len(x) // config.batch)
    for _ in range(config.epochs):
        order = rng.permutation(len(x))
        for s in range(0, len(order), config.batch):
            own = order[s:s + config.batch]
            h = np.tanh(x[own] @ p[0] + p[1])
            d = _softmax(h @ p[2] + p[3])
            d[np.arange(len(own)), y[own]] -= 1
            d *= (weights[own] / len(own))[:, None]
            dh = (d @ p[2].T) * (1 - h * h)
            grads = [x[own].T @ dh + config.decay * p[0], dh.sum(0), h.T @ d + config.decay * p[2], d.sum(0)]
            step += 1
            rate = config.rate * (1 - step / (total + 1))
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                p[i] = p[i] - rate * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    return tuple(p)


def fit(texts: list[str], labels: np.ndarray, frequency: dict, config: Config = Config()) -> Model:
    """Learns vectors and network; ``frequency`` (label -> rows) weighs the sample's classes as all labelled rows have them."""
    index = index_vectors(config)
    if not texts or len(set(labels.tolist())) < 2:
        empty = np.zeros((SHAPES, config.dim), np.float32)
        return Model({}, empty, index, np.zeros(1), np.ones(1), (), 1.0, float(labels.mean()) if len(labels) else 0.0)
    vocabulary, vectors = word_vectors(texts, index, config)
    pool = Pooler(vocabulary, vectors, index)
    x = np.stack([pool(t) for t in texts]).astype(np.float64)
    centre, spread = x.mean(0), x.std(0) + 1e-3
    x = (x - centre) / spread
    sizes = np.bincount(labels, minlength=2)
    share = np.array([frequency.get(k, sizes[k]) for k in (0, 1)], float)
    weights = ((share / share.sum()) / (sizes / sizes.sum()))[labels]
    apart = np.random.default_rng(config.seed + 1).permutation(len(x)) % 5 == 0
    layers = _network(x[~apart], labels[~apart], weights[~apart], config)
    z, y, w = _logits(layers, x[apart]), labels[apart], weights[apart]

    def loss(t: float) -> float:
        return float(-(w * np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12)).sum())

    temperature = min((float(t) for t in np.geomspace(0.25, 16, 61)), key=loss) if apart.any() else 1.0
    return Model(vocabulary, vectors, index, centre, spread, layers, temperature, None)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          modulus: int = 3, remainder: int = 1, config: Config = Config()) -> Model:
    """Learns from labelled rows outside the fold crc32(id) mod ``modulus`` = ``remainder``."""
    model = fit(*common.labelled_texts(docs, labels, label_col, id_col, text_col, modulus, remainder, config.per_class), config)
    common.give_back()
    return model


def scores(model: Model, pool: Pooler, texts: list[str]) -> np.ndarray:
    """Calibrated probabilities of label 1."""
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    x = (np.stack([pool(t) for t in texts]) - model.centre) / model.spread
    return _softmax(_logits(model.layers, x) / model.temperature)[:, 1]


def score_documents(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, a double from 0 to 1.  All its columns stay; a column named ``score_col`` is replaced."""
    spark = docs.sparkSession
    common.small_batches(spark)
    kept = docs.drop(score_col)
    sent = spark.sparkContext.broadcast(model)  # of bounded size: ``words`` vectors at most
    at = kept.columns.index(text_col)

    def run(batches):
        m = sent.value
        pool = Pooler(m.vocabulary, m.vectors, m.index)
        for b in batches:
            s = scores(m, pool, list(common.texts_of(b.column(at)))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, score_col])

    return kept.mapInArrow(run, common.plus(kept, (score_col, T.DoubleType())))
