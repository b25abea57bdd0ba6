"""Exact similarity retrieval over vectors, in blocks of queries.

The query set is stated and bounded: it is sent to every task in blocks, and each
task keeps the best ``k`` of its own rows for every query, so that what is
shuffled is ``k`` rows a query and task, whatever the number of vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BLOCK = 2048
#: vectors compared with a block at a time: a whole Arrow batch takes some 160 MB for each array of scores, ids and order
ROWS = 512


def normalised(v: Column) -> Column:
    """A vector divided by its length; a zero vector stays."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(length == 0, 1.0).otherwise(length))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", least: float | None = None) -> DataFrame:
    """(query_id, id, score, rank): each query's nearest vectors by cosine, itself excluded; ties go to the lesser id.

    ``queries`` is read block by block; vectors of another length or null are no match.
    """
    parts = []
    for block in _blocks(queries, id_col, vector_col):
        parts.append(_block_top_k(vectors, block, k, id_col, vector_col))
    if not parts:
        return vectors.limit(0).select(F.col(id_col).cast("long").alias("query_id"), F.col(id_col).cast("long").alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    return ranked if least is None else ranked.filter(F.col("score") >= least)


def _blocks(queries: DataFrame, id_col: str, vector_col: str):
    held = []
    for r in queries.select(id_col, vector_col).filter(F.col(vector_col).isNotNull()).toLocalIterator():
        held.append((int(r[0]), [float(x) for x in r[1]]))
        if len(held) == BLOCK:
            yield held
            held = []
    if held:
        yield held


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1.0, n)


def nearest(parts, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of each query's best ``k`` of all parts (ids, vectors), ``ROWS`` vectors at a time."""
    best_id, best = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
    for part_ids, part in parts:
        for at in range(0, len(part), ROWS):
            kept = [(i, v) for i, v in zip(part_ids[at:at + ROWS], part[at:at + ROWS]) if v is not None and len(v) == q.shape[1]]
            if not kept:
                continue
            own = np.array([i for i, _ in kept], np.int64)
            scores = np.round(q @ _unit(np.stack([v for _, v in kept]).astype(float)).T, 9)
            scores[ids[:, None] == own[None, :]] = -np.inf
            # what is kept so far and these, brought down to k again
            best_id, best = np.hstack([best_id, np.broadcast_to(own, scores.shape)]), np.hstack([best, scores])
            order = np.lexsort((best_id, -best), axis=1)[:, :k]
            best_id, best = np.take_along_axis(best_id, order, 1), np.take_along_axis(best, order, 1)
    return best_id, best


def _block_top_k(vectors: DataFrame, block: list, k: int, id_col: str, vector_col: str) -> DataFrame:
    size = len(block[0][1])
    kept = [(i, v) for i, v in block if len(v) == size]
    ids, q = np.array([i for i, _ in kept]), _unit(np.array([v for _, v in kept]))
    sent = vectors.sparkSession.sparkContext.broadcast((ids, q))  # BLOCK vectors at most

    def run(parts):
        ids, q = sent.value
        best_id, best = nearest(((pdf[id_col], pdf[vector_col]) for pdf in parts), ids, q, k)
        out = pd.DataFrame({"query_id": np.repeat(ids, best.shape[1]), "id": best_id.ravel(), "score": best.ravel()})
        yield out[np.isfinite(out["score"])]

    return vectors.select(F.col(id_col).cast("long").alias(id_col), vector_col).mapInPandas(run, "query_id long, id long, score double")
