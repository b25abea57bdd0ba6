"""Connected components of a link table, by alternating star contractions.

Links are rows (a, b) of longs.  Large-star points every larger neighbour of a
node at the least node near it, small-star does so for the smaller ones; both
keep connectivity and never add rows (Kiveris et al., "Connected Components in
MapReduce and Beyond").  No node's links are gathered: a round is an
aggregation with map-side combine and an equi-join that Spark may split where
one node has many links.  Rounds end when the links no longer change, after
O(log^2) of them.  Each round is cut by a checkpoint in the shared folder.

Links that are counted and found to be ``one_task`` or fewer take one task and no
round: a task holds them in arrays of 16 bytes a link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = common.salted_join(both, _least(both), ["a"], ["b"]).filter("b > a")
    return near.select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    moved = common.salted_join(down, least, ["a"], ["b"]).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node that each reaches), by taking over the least label of a neighbour and following labels."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        was = label.copy()
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while True:
            then = label[label]
            if np.array_equal(then, label):
                break
            label = then
        if np.array_equal(was, label):
            return nodes, nodes[label]


def _at_once(links: DataFrame) -> DataFrame:
    def run(batches):
        found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if found:
            nodes, roots = least_reachable(*(np.concatenate(x) for x in zip(*found, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])

    return links.select("a", "b").coalesce(1).mapInArrow(run, "node long, root long")


def components(links: DataFrame, a: str, b: str, most_rounds: int = 60, one_task: int = 1_000_000) -> DataFrame:
    """(node, root) for every node that has a link to another one; root is the least node reachable.

    Null ends, links of a node to itself and repeated links are ignored.
    """
    links = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    links = common.cut(links.filter("a <> b").distinct())
    state = _state(links)
    if not state[0] or state[0] <= one_task:
        return _at_once(links)
    for _ in range(most_rounds):
        links = common.cut(_small_star(_large_star(links)).distinct())
        was, state = state, _state(links)
        if was == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = links.select("b").distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("b", "b"))
