import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from paperloom.llm import components, simhash


def plain_fingerprint(text):
    words = [w for w in "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in (text or "")).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(edges, nodes):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("text", ["", None, " \t\n", "One", "one two", "a b c", "a b c d a b c d", "ÀÉ Üb x\x0by z w q", "word " * 9000])
def test_fingerprint(text):
    assert simhash.fingerprint(text or "") == plain_fingerprint(text)


def test_groups_find_every_link():
    rng = np.random.default_rng(4)
    config = simhash.Config(leaf=32)
    base = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    near = base[:300].copy()
    for k in range(len(near)):
        for b in rng.choice(64, rng.integers(1, 6), replace=False):
            near[k] ^= np.uint64(1) << np.uint64(b)
    ball = base[:1] ^ (np.uint64(1) << rng.integers(0, 12, 400, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 12, 400, dtype=np.uint64))
    points = np.unique(np.concatenate([base, near, ball]))
    edges = [(i, j) for i in range(len(points)) for j in (np.flatnonzero(np.bitwise_count(points[i + 1:] ^ points[i]) <= 3) + i + 1).tolist()]
    want = plain_components(edges, range(len(points)))
    assert simhash.groups(points, config).tolist() == [want[i] for i in range(len(points))]


def test_shards_keep_every_link_together():
    rng = np.random.default_rng(8)
    points = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    points = np.unique(np.concatenate([points, points ^ np.uint64(0b10101)]))
    config = simhash.Config(shard=256)
    tree = simhash.upper_levels(points[:2000], len(points), config)
    shards = [set(places.tolist()) for _, places in simhash.deal(tree, points, config.radius)]
    assert len(shards) > 8 and max(map(len, shards)) < len(points)
    for i in range(len(points)):
        for j in (np.flatnonzero(np.bitwise_count(points[i + 1:] ^ points[i]) <= 3) + i + 1).tolist():
            assert any(i in s and j in s for s in shards)


def test_large_shards_are_parted_and_keep_every_link(spark):
    rng = np.random.default_rng(12)
    flips = lambda points, most: points ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, most + 1), replace=False)) for _ in points], np.uint64)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    points = np.unique(np.concatenate([base, flips(base, 4), flips(np.repeat(base[:1], 900), 9), flips(np.repeat(base[1:2], 200), 3)]))
    edges = [(i, j) for i in range(len(points)) for j in (np.flatnonzero(np.bitwise_count(points[i + 1:] ^ points[i]) <= 3) + i + 1).tolist()]
    want = plain_components(edges, range(len(points)))
    nodes = spark.createDataFrame([(int(p), k) for k, p in enumerate(points.view(np.int64))], "fp long, rep long")
    for most, deepest in ((100_000, 0), (400, 0), (40, 0), (4, 3)):
        config = simhash.Config(shard=200, most=most, deepest=deepest)
        got = {r.node: r.root for r in components.components(simhash.links(nodes, config), "a", "b").collect()}
        assert got == {i: r for i, r in want.items() if list(want.values()).count(r) > 1}


@pytest.mark.parametrize("alike", simhash.Config().stretches)
def test_linked_fingerprints_are_alike_under_some_mask(alike):
    rng = np.random.default_rng(3)
    masks = [m & (1 << 64) - 1 for m in simhash.masks(alike, 3)]
    for _ in range(300):
        difference = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(not difference & m for m in masks)
    assert min(m.bit_count() for m in masks) >= 64 - 3 * -(-64 // (alike + 3))


def test_rows_dealt_grow_with_the_rows():
    rng = np.random.default_rng(3)
    dealt = []
    for n in (1_000_000, 4_000_000, 16_000_000):  # a sample stands for the fingerprints, as the tree is chosen on one
        points = rng.integers(0, 1 << 64, 60_000, dtype=np.uint64)
        config = simhash.Config()
        tree = simhash.upper_levels(points[:config.sample], n, config)
        dealt.append(sum(len(places) for _, places in simhash.deal(tree, points, config.radius)) / len(points))
    assert max(dealt) < 5 and dealt[2] < 1.1 * dealt[0]


@pytest.mark.parametrize("one_task", [0, 1_000_000])
def test_components(spark, one_task):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5000, 6000 + k) for k in range(50)] + [(7, 7), (None, 3)]
    nodes = {n for e in edges if None not in e and e[0] != e[1] for n in e}
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "x long, y long"), "x", "y", one_task=one_task).collect()}
    assert got == plain_components([e for e in edges if None not in e and e[0] != e[1]], nodes)
    assert components.components(spark.createDataFrame([], "x long, y long"), "x", "y", one_task=one_task).count() == 0


def test_long_chains_settle_in_few_steps():
    order = np.random.default_rng(1).permutation(200_000)
    nodes, roots = components.least_reachable(order[:-1], order[1:])
    assert len(nodes) == 200_000 and not roots.any()


def test_near_duplicates(spark):
    rng = random.Random(6)
    words = ["w%d" % k for k in range(500)]
    rows = [(k, " ".join(rng.choices(words, k=rng.choice([0, 2, 30, 400])))) for k in range(80)]
    rows += [(100 + k, rows[k][1]) for k in range(20)]
    for k in range(20):
        parts = rows[k][1].split()
        if parts:
            parts[rng.randrange(len(parts))] = "changed"
        rows.append((200 + k, " ".join(parts)))
    rows += [(300, None), (301, ""), (302, " \n"), (300, None), (None, "no id here")]
    got = simhash.near_duplicates(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fp long, component long"), config=simhash.Config(shard=16, leaf=4)).collect()
    assert len(got) == len(rows)
    prints = {(i, plain_fingerprint(t)) for i, t in rows if i is not None}
    by = sorted(prints)
    edges = [(a[0], b[0]) for a in by for b in by if a < b and (a[1] ^ b[1]).bit_count() <= 3]
    want = plain_components(edges, {i for i, _ in by})
    for r in got:
        assert r.component == (None if r.id is None else want[r.id])
        if r.id is not None:
            assert (r.id, r.fp & (1 << 64) - 1) in prints
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {r for r in want.values()} | {None}
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
