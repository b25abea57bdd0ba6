"""SimHash near-duplicates with vantage-point trees.

Fingerprints: words of the text, A-Z lower-cased, make shingles of ``words``
words, repeats included; a bit of the fingerprint is 1 if it is set in over
half the shingles' XXH64 hashes (seed 42).

Links: two fingerprints link at ``radius`` or fewer differing bits.  Equal
fingerprints are one node.  A vantage point splits nodes by their Hamming
distance d from it: near ones have d <= m, far ones d > m.  By the triangle
inequality the distances of two linked nodes differ by at most ``radius``, so a
link that crosses the split has its near end at d > m - radius: those nodes
also enter the far side.  Every linked pair thus meets in some leaf.  The upper
levels, chosen on a bounded sample, deal nodes to shards; in its shard a task
builds the lower levels and compares pairs in the leaves.  A shard reports
links that span its groups, at most one a node, never all pairs of a group.

Each upper level deals some nodes twice, so they are ``deepest`` at most, and
what is dealt stays in proportion to the nodes.  Shards of more than ``most``
nodes, of very many documents or of a ball of near fingerprints that no vantage
point parts, are parted exactly: of ``radius`` + k stretches of the bits, linked
nodes have k in common, so they meet in the part of those k.  Parts that are
still larger are parted by more stretches; those of the last step can hold
2^18 fingerprints and no more.

A radius of 3 bits finds copies that differ in a word or two of a long text.
Texts of a 5-word similarity of 0.8 differ in 10 bits of 64 on average and in
up to 18, and at such a radius no vantage point parts random fingerprints: the
distances from it spread by 4 bits only, so that each side of a split would be
dealt nearly all nodes.  ``keep_one`` with a similarity therefore takes
fingerprints of 256 bits and a tree of many vantage points a level
(``wide_simhash``), and compares what it finds exactly (``near_copies``).

Null and empty texts and those of white space alone have fingerprint zero and
link like any other.  Rows that repeat a doc_id are documents of their own with
that id.  A null doc_id gets a fingerprint but no component (null).
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common, near_copies
from .components import components


@dataclass(frozen=True)
class Config:
    words: int = 3  #: words of a shingle
    radius: int = 3  #: differing bits of a link
    shard: int = 32_768  #: distinct fingerprints that a shard is planned for, before overlaps
    sample: int = 16_384  #: fingerprints that the upper levels are chosen on, at least
    sample_each: int = 64  #: more of them: so many for each shard that is planned
    sample_most: int = 2_000_000  #: of them at most, which plans for 10^9 fingerprints
    deepest: int = 6  #: upper levels, at most
    most: int = 131_072  #: nodes of a shard that one task compares; larger ones are parted by ``stretches``
    stretches: tuple[int, ...] = (1, 3, 9)  #: stretches of bits that are alike in a part, of ``radius`` more, step by step
    leaf: int = 1024  #: nodes that are compared pair by pair
    tries: int = 6  #: vantage points tried for a split
    similarity: float | None = None  #: for ``keep_one``: link by Jaccard similarity of shingle sets, at least this, instead of by bits


#: Near copies as the pipeline takes them.
NEAR = Config(words=5, similarity=0.8)


WEIGHTS = np.left_shift(np.uint64(1), np.arange(63, -1, -1, dtype=np.uint64))


def fingerprint(text: str, words: int = 3) -> int:
    """The 64 bits as an unsigned number."""
    # of bytes, lower() changes A-Z only, and split() parts at [\x20\x09-\x0D]+ only
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        hashes = [xxh64_intdigest(b" ".join(parts), 42)]
    else:
        joined = b" ".join(parts)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[:len(parts) - words + 1].tolist()
        hashes = [xxh64_intdigest(joined[i:j], 42) for i, j in zip(starts, ends[words - 1:].tolist(), strict=True)]
    total, n = np.zeros(64, np.int64), len(hashes)
    for s in range(0, n, 4096):
        block = np.array(hashes[s:s + 4096], ">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(block, axis=1).sum(0, dtype=np.int64)
    return int(WEIGHTS[2 * total > n].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", config: Config = Config()) -> DataFrame:
    """(id, fp): one row a document, fp the fingerprint's bits as a long."""
    common.small_batches(docs.sparkSession)
    words = config.words

    def run(batches):
        for b in batches:
            bits = np.array([fingerprint(t, words) for t in common.texts_of(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits, pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, fp long")


def distances(points: np.ndarray, one: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ one).astype(np.int16)


def split(points: np.ndarray, config: Config, rng) -> tuple[np.uint64, int] | None:
    """The vantage point and distance that leave the fewest pairs to compare, None if no split saves a tenth of them."""
    best = None
    if len(points) > 4096:
        points = points[rng.choice(len(points), 4096, replace=False)]
    n = len(points)
    for one in points[rng.choice(n, min(config.tries, n), replace=False)]:
        counts = np.bincount(distances(points, one), minlength=65)
        near = np.cumsum(counts)
        for m in range(config.radius, 64):
            inner, outer = near[m], n - near[m - config.radius]
            cost = float(inner) ** 2 + float(outer) ** 2
            if best is None or cost < best[0]:
                best = (cost, one, m)
    return best[1:] if best and best[0] <= 0.9 * float(n) ** 2 else None


def upper_levels(sample: np.ndarray, total: int, config: Config) -> list:
    """A tree as a list of nodes: (vantage, distance, near node, far node), or (shard,)."""
    rng, nodes, shards = np.random.default_rng(1), [], 0
    least = max(8.0, config.shard * len(sample) / max(1, total))

    def grow(points: np.ndarray, depth: int) -> int:
        nonlocal shards
        own = len(nodes)
        nodes.append(None)
        cut = split(points, config, rng) if len(points) > least and depth < config.deepest else None
        if cut is None:
            nodes[own] = (shards,)
            shards += 1
            return own
        d = distances(points, cut[0])
        near = grow(points[d <= cut[1]], depth + 1)
        nodes[own] = (cut[0], cut[1], near, grow(points[d > cut[1] - config.radius], depth + 1))
        return own

    grow(sample, 0)
    return nodes


def deal(nodes: list, points: np.ndarray, radius: int) -> list[tuple[int, np.ndarray]]:
    """(shard, places of the points that enter it)."""
    out, open_ = [], [(0, np.arange(len(points)))]
    while open_:
        k, places = open_.pop()
        if not len(places):
            continue
        if len(nodes[k]) == 1:
            out.append((nodes[k][0], places))
            continue
        one, m, near, far = nodes[k]
        d = distances(points[places], one)
        open_ += [(near, places[d <= m]), (far, places[d > m - radius])]
    return out


def masks(alike: int, radius: int) -> list[int]:
    """Every choice of ``alike`` of ``alike`` + ``radius`` stretches of the 64 bits, as signed longs."""
    n = alike + radius
    ends = [64 * i // n for i in range(n + 1)]
    stretches = [(1 << j) - (1 << i) for i, j in zip(ends, ends[1:], strict=False)]
    return [(m ^ 1 << 63) - (1 << 63) for m in map(sum, combinations(stretches, alike))]


def parted(rows: DataFrame, config: Config) -> DataFrame:
    """``rows`` (shard, fp, rep) with the ``task`` that compares them: a shard, or several parts of shards of more than ``most`` rows."""
    done = None
    for alike in config.stretches:
        large = common.cut(rows.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > config.most).select("shard"))
        if large.isEmpty():
            break
        small = rows.join(large, "shard", "left_anti")
        small = small.withColumn("task", F.col("shard")) if done is None else _tasks(small, config)
        done = small if done is None else done.unionByName(small)
        parts = F.array(*(F.xxhash64("shard", F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(masks(alike, config.radius))))
        rows = common.cut(common.salted_join(rows, large, ["shard"], ["fp"]).select(F.explode(parts).alias("shard"), "fp", "rep"))
    return rows.withColumn("task", F.col("shard")) if done is None else done.unionByName(_tasks(rows, config))


def _tasks(rows: DataFrame, config: Config) -> DataFrame:
    """Deals parts, most of which are small, to tasks of about ``shard`` rows; a part stays whole."""
    return rows.withColumn("task", -1 - F.pmod(F.xxhash64("shard"), F.lit(1 + rows.count() // config.shard)))


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def _leaf(points: np.ndarray, places: np.ndarray, union: Union, radius: int) -> None:
    """Joins what links within a leaf.

    Few links: rows of a distance table.  Where they are many (a dense ball of
    near copies), a search that takes out what it has reached, so that a pair
    costs one comparison and no memory.
    """
    p = points[places]
    if len(p) <= 2048:
        i, j = np.nonzero(np.triu(np.bitwise_count(p[:, None] ^ p[None, :]) <= radius, 1))
        if len(i) <= 8 * len(p):
            for a, b in zip(places[i].tolist(), places[j].tolist(), strict=True):
                union.join(a, b)
            return
    left = np.arange(len(p))
    while len(left):
        first, left = left[0], left[1:]
        edge = [int(first)]
        while edge and len(left):
            hit = np.bitwise_count(p[left] ^ p[edge.pop()]) <= radius
            for j in left[hit].tolist():
                union.join(int(places[first]), int(places[j]))
                edge.append(j)
            left = left[~hit]


def groups(points: np.ndarray, config: Config) -> np.ndarray:
    """For each of the distinct points, the least place of its group in this shard."""
    rng, union = np.random.default_rng(2), Union(len(points))
    open_ = [np.arange(len(points))]
    while open_:
        places = open_.pop()
        cut = None
        if len(places) > config.leaf:
            cut = split(points[places], config, rng)
        if cut is None:
            if len(places) > 1:
                _leaf(points, places, union, config.radius)
            continue
        d = distances(points[places], cut[0])
        open_ += [places[d <= cut[1]], places[d > cut[1] - config.radius]]
    return np.array([union.root(i) for i in range(len(points))], np.int64)


def links(nodes: DataFrame, config: Config = Config()) -> DataFrame:
    """(a, b): links that span the groups of ``nodes`` (fp, rep), rep being a fingerprint's number; fp is distinct."""
    spark = nodes.sparkSession
    total = nodes.count()
    # the sample grows with the shards that are planned, so that the upper levels do; those of the least hash are taken
    wanted = min(config.sample_most, max(config.sample, config.sample_each * (total // config.shard)))
    bound = (1 << 62) if total <= wanted else int((1 << 62) * wanted / total)
    sample = np.sort(np.array([r[0] for r in nodes.select("fp").filter(common.sample_rank("fp") < bound).collect()], np.int64)).view(np.uint64)
    tree = spark.sparkContext.broadcast(upper_levels(sample, total, config))  # of bounded size: at most twice the sample's nodes

    def route(batches):
        for part in common.blocks(batches, 65_536):
            points = part.column("fp").to_numpy().view(np.uint64)
            dealt = deal(tree.value, points, config.radius)
            took = np.concatenate([places for _, places in dealt])
            shard = np.repeat([s for s, _ in dealt], [len(places) for _, places in dealt])
            reps = part.column("rep").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(points[took].view(np.int64)), pa.array(reps[took])], names=["shard", "fp", "rep"])

    def compare(group: pa.Table) -> pa.Table:
        shard = group.column("shard").to_numpy()
        order = np.argsort(shard, kind="stable")
        points, reps = group.column("fp").to_numpy().view(np.uint64)[order], group.column("rep").to_numpy()[order]
        starts = np.flatnonzero(np.diff(shard[order], prepend=shard[order[0]] - 1)).tolist()
        root = np.concatenate([groups(points[i:j], config) + i for i, j in zip(starts, [*starts[1:], len(order)], strict=True)])
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": pa.array(reps[linked], pa.int64()), "b": pa.array(reps[root[linked]], pa.int64())})

    rows = common.cut(nodes.select("fp", "rep").mapInArrow(route, "shard long, fp long, rep long"))
    return parted(rows, config).groupBy("task").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", config: Config = Config()) -> DataFrame:
    """(id, fp, component): component is the least id that links reach, the row's own included."""
    prints = common.cut(fingerprints(docs, id_col=id_col, text_col=text_col, config=config))
    nodes = common.cut(prints.filter("id is not null").groupBy("fp").agg(F.min("id").alias("rep")))
    # one id may stand for several fingerprints if ids repeat: then they are one node of the graph, as they are one document
    found = components(links(nodes, config), "a", "b")
    named = nodes.join(found, nodes.rep == found.node, "left").select("fp", F.coalesce("root", "rep").alias("component"))
    return (prints.join(named, "fp", "left")
            .select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component")))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", config: Config = Config()) -> DataFrame:
    """The rows of ``docs`` that have the least id of their group, with the columns of ``docs``.

    With ``config.similarity`` set, texts link by the similarity of their shingle
    sets (see ``near_copies``) instead of by differing bits.  Of rows that repeat an
    id, all are kept or none, but for equal texts in the first case.  Rows without
    an id are kept.
    """
    if config.similarity is not None:
        return near_copies.keep_one(docs, id_col=id_col, text_col=text_col, config=near_copies.Config(words=config.words, least=config.similarity))
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, config=config)
    gone = found.filter("component <> id").select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")
