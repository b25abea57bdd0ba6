"""Benchmark decontamination by spaced-seed hashing.

A text's tokens are its words, lower-cased, without what is no letter or digit
at their ends.  Fixed masks lay some token positions of a stretch open and
ignore the others, so that a stretch with substituted tokens still hashes like
the original under a mask that ignores those.  Hashes of all stretches of every
text are joined with those of the benchmark.  A hit gives an item and an offset;
the item is then laid beside the text at that offset, and the best stretch of
their overlap (one point for an equal token, ``miss`` off for another) is
measured.  It counts if it holds at least ``overlap`` tokens, or ``share`` of
the item where the item is shorter than that, and at least ``share`` of the
stretch's tokens are equal; so does the whole item if ``share`` of its tokens are
equal.  Items of 6 to 14 tokens have masks of their own, which leave out each
part of the stretch (or each two) in turn, so that no placement of one (6 to 9
tokens) or two substitutions is missed; shorter items are looked up whole.

A benchmark of at most ``block_chars`` code points is one block, sent to every
task, and nothing of the texts is shuffled.  A larger one becomes a table of
seeds that is joined with the texts' seeds by a shuffle; a bit table of fixed
size keeps seeds that no item has from travelling.

Null, empty and tokenless texts and items match nothing.  Rows that repeat a
doc_id or item_id are matched each; one row is reported for each row of texts
and item_id, and of an item_id's rows the best match.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from . import common

#: 1 for a position that counts, 0 for one that is ignored.
MASKS = ("111011", "110101011", "1011001101", "11000100111")
SHORTEST = 6  #: tokens of the shortest item that is looked up under masks


def parted(span: int, parts: int, out: int) -> list[str]:
    """Masks of ``span`` positions in ``parts`` parts of which each ``out`` in turn are ignored."""
    edges = [round(span * k / parts) for k in range(parts + 1)]
    return ["".join("01"[not any(edges[k] <= i < edges[k + 1] for k in gone)] for i in range(span)) for gone in combinations(range(parts), out)]


@dataclass(frozen=True)
class Config:
    masks: tuple[str, ...] = MASKS
    overlap: int = 13  #: tokens of the shortest stretch that counts, for items that have as many
    share: float = 0.8  #: equal tokens of the stretch; and of a shorter item, its tokens that the stretch holds
    miss: float = 3.0  #: what a substituted token takes from a stretch's worth
    block_chars: int = 4_000_000  #: code points of a benchmark that is sent to every task; a larger one is joined by a shuffle
    salts: int = 8  #: places that the rows of one seed are dealt to in that join


def token_hash(word: str) -> int:
    """A word's 64-bit hash as a signed number; 0 for a word without letters or digits."""
    if not word.isalnum():
        start, end = 0, len(word)
        while start < end and not word[start].isalnum():
            start += 1
        while end > start and not word[end - 1].isalnum():
            end -= 1
        word = word[start:end]
    if not word:
        return 0
    h = xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 7) or 1
    return h - (1 << 64) if h >> 63 else h


def tokens(text: str, memo: common.Memo) -> np.ndarray:
    words = text.lower().split()
    h = np.fromiter(map(memo.__getitem__, words), np.int64, len(words)).view(np.uint64)
    return h[h != 0]


def seeds(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The hash under ``mask`` of every stretch of ``h``."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, (salt + 1) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out ^= out >> np.uint64(29)
            out *= np.uint64(0xBF58476D1CE4E5B9)
            out += h[i:i + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31))


def plan(sizes: set[int], config: Config) -> list[tuple[str, int, int]]:
    """(mask, least tokens, most tokens) of the masks that items of these sizes need, each with the items it is for."""
    out = [(m, SHORTEST, 1 << 40) for m in config.masks]
    out += [(m, 6, 9) for m in parted(6, 3, 1)] if any(6 <= n <= 9 for n in sizes) else []
    out += [(m, 10, 14) for m in parted(10, 5, 2)] if any(10 <= n <= 14 for n in sizes) else []
    return out + [("1" * n, n, n) for n in sorted(sizes) if 0 < n < SHORTEST]


def item_seeds(t: np.ndarray, masks: list[tuple[str, int, int]]) -> list[tuple[int, np.ndarray]]:
    """(mask's number, hashes of all stretches) of an item."""
    return [(k, seeds(t, m, k)) for k, (m, least, most) in enumerate(masks) if least <= len(t) <= most and len(m) <= len(t)]


def verify(t: np.ndarray, h: np.ndarray, offset: int, c: Config) -> tuple[int, int, int] | None:
    """(equal tokens, stretch's tokens, its first text position) of the best stretch of item t at ``offset`` of text h, if it counts."""
    first, last = max(0, -offset), min(len(t), len(h) - offset)
    equal = t[first:last] == h[offset + first:offset + last]
    worth = np.concatenate([[0.0], np.cumsum(np.where(equal, 1.0, -c.miss))])
    floor = np.minimum.accumulate(worth)
    end = int(np.argmax(worth - floor))
    start = int(np.flatnonzero(worth[:end + 1] == floor[end])[0])
    size, same = end - start, int(equal[start:end].sum())
    need = c.overlap if len(t) >= c.overlap else c.share * len(t)
    # a whole item with scattered substitutions may be no one good stretch
    whole = int(equal.sum())
    if whole >= c.share * len(t) and whole >= same:
        return whole, len(equal), offset + first
    return (same, size, offset + first + start) if size >= need and same >= c.share * size else None


def better(one: tuple, other: tuple | None) -> bool:
    """Whether a match (id, equal, size, first) is better than another: more equal tokens, then earlier."""
    return other is None or (one[1], -one[3]) > (other[1], -other[3])


class Block:
    """Items with the hashes of their stretches, in order; what a task needs to match texts."""

    def __init__(self, items: list[tuple[int, str]], config: Config):
        self.config, memo = config, common.Memo(token_hash)
        self.ids = [i for i, _ in items]
        self.tokens = [tokens(t or "", memo) for _, t in items]
        plans = plan(set(map(len, self.tokens)), config)
        self.masks = [m for m, _, _ in plans]
        self.hashes, self.items, self.at, self.seen = [], [], [], []
        found: list[list] = [[] for _ in plans]
        for k, t in enumerate(self.tokens):
            for salt, s in item_seeds(t, plans):
                found[salt].append((s, np.full(len(s), k), np.arange(len(s))))
        for rows in found:
            h, item, at = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int))
            order = np.argsort(h, kind="stable")
            self.hashes.append(h[order])
            self.items.append(item[order])
            self.at.append(at[order])
            shift = np.uint64(64 - max(10, (8 * len(h)).bit_length()))
            bits = np.zeros(1 << (64 - int(shift)), bool)
            bits[h >> shift] = True
            self.seen.append((shift, bits))

    def hits(self, texts: list[np.ndarray]) -> list[set[tuple[int, int]]]:
        """For each text's tokens, (item, text position of the item's first token) of all hits."""
        out: list[set[tuple[int, int]]] = [set() for _ in texts]
        ends = np.cumsum([len(h) for h in texts])
        flat = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
        for salt, mask in enumerate(self.masks):
            s = seeds(flat, mask, salt)
            if not len(s) or not len(self.hashes[salt]):
                continue
            shift, bits = self.seen[salt]
            maybe = np.flatnonzero(bits[s >> shift])
            low = np.searchsorted(self.hashes[salt], s[maybe], "left")
            high = np.searchsorted(self.hashes[salt], s[maybe], "right")
            owner = np.searchsorted(ends, maybe, "right")
            true = (high > low) & (maybe + len(mask) <= ends[owner])  # a stretch over two texts is none
            for p, i, j, k in zip(maybe[true].tolist(), low[true].tolist(), high[true].tolist(), owner[true].tolist(), strict=True):
                first = p - int(ends[k]) + len(texts[k])
                out[k].update((int(self.items[salt][x]), first - int(self.at[salt][x])) for x in range(i, j))
        return out

    def verify(self, h: np.ndarray, item: int, offset: int) -> tuple[int, int, int] | None:
        return verify(self.tokens[item], h, offset, self.config)

    def matches(self, texts: list[str], memo: common.Memo) -> list[list[tuple[int, int, int, int]]]:
        """For each text, (item_id, equal tokens, stretch's tokens, first token position): of each item the best stretch."""
        hashed = [tokens(t, memo) for t in texts]
        out = []
        for h, found in zip(hashed, self.hits(hashed), strict=True):
            best: dict[int, tuple[int, int, int, int]] = {}
            for item, offset in found:
                got = self.verify(h, item, offset)
                if got:
                    own = (self.ids[item], *got)
                    if better(own, best.get(self.ids[item])):
                        best[self.ids[item]] = own
            out.append(sorted(best.values()))
        return out


MATCH = "id long, item_id long, equal_tokens long, overlap_tokens long, first_token long"


def _one_block(benchmark: DataFrame, item_col: str, text_col: str, config: Config) -> Block | None:
    """The benchmark as a block; None if it is larger than one."""
    chars = benchmark.agg(F.sum(F.char_length(text_col))).first()[0] or 0
    if chars > config.block_chars:
        return None
    return Block(sorted((tuple(r) for r in benchmark.select(F.col(item_col).cast("long"), text_col).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), config)


class Bits:
    """A table of 2^26 bits by a hash's upper ones, for union in any order."""

    SHIFT = np.uint64(64 - 26)

    @staticmethod
    def of(hashes: np.ndarray) -> bytes:
        cells = np.zeros(1 << 26, bool)
        cells[hashes >> Bits.SHIFT] = True
        return np.packbits(cells).tobytes()

    @staticmethod
    def has(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        cell = hashes >> Bits.SHIFT
        return (table[cell >> np.uint64(3)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8)) & 1 == 1


def joined(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, config: Config) -> DataFrame:
    """The matches of a benchmark of any size: seeds of items and texts meet in a shuffle join, then each candidate is verified.

    Equal texts are one, by a 64-bit hash; so are equal items.  A candidate is a
    text, an item and an offset; what travels to its verification are the item's
    tokens and as many of the text's.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")).filter("text is not null")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("item")).filter("item is not null")

    def hashed(batches):
        memo = common.Memo(token_hash)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tokens(t, memo).view(np.int64) for t in common.texts_of(b.column(1))], pa.list_(pa.int64()))], names=["item_id", "item"])

    items = common.cut(items.mapInArrow(hashed, "item_id long, item array<long>").filter("size(item) > 0").withColumn("item_key", F.xxhash64("item")))
    masks = plan({r[0] for r in items.select(F.least(F.size("item"), F.lit(15))).distinct().collect()}, config)

    def seeded(batches):
        for b in batches:
            keys, salts, at, hashes = [], [], [], []
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for salt, s in item_seeds(np.array(t, np.int64).view(np.uint64), masks):
                    keys += [key] * len(s)
                    salts += [salt] * len(s)
                    at += range(len(s))
                    hashes.append(s)
            flat = np.concatenate([*hashes, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(salts, pa.int32()), pa.array(at, pa.int64()), pa.array(flat)], names=["item_key", "mask", "at", "seed"])

    of_items = common.cut(items.dropDuplicates(["item_key"]).select("item_key", "item").mapInArrow(seeded, "item_key long, mask int, at long, seed long"))

    def told(batches):
        cells = np.zeros(1 << 23, np.uint8)
        for b in batches:
            cells |= np.frombuffer(Bits.of(b.column(0).to_numpy().view(np.uint64)), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([cells.tobytes()], pa.binary())], names=["bits"])

    cells = np.zeros(1 << 23, np.uint8)  # 8 MB, whatever the benchmark's size; the partitions' tables come one by one
    for r in of_items.select("seed").coalesce(64).mapInArrow(told, "bits binary").toLocalIterator():
        cells |= np.frombuffer(r[0], np.uint8)
    sent = spark.sparkContext.broadcast(cells)

    def looked_up(batches):
        memo = common.Memo(token_hash)
        for b in batches:
            out = [[], [], [], []]
            for key, text in zip(b.column(0).to_pylist(), common.texts_of(b.column(1)), strict=True):
                h = tokens(text, memo)
                for salt, (mask, _, _) in enumerate(masks):
                    s = seeds(h, mask, salt)
                    at = np.flatnonzero(Bits.has(sent.value, s))
                    for column, values in zip(out, (np.full(len(at), key), np.full(len(at), salt, np.int32), at, s[at].view(np.int64)), strict=True):
                        column.append(values)
            kinds = (np.int64, np.int32, np.int64, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*c, np.zeros(0, k)]).astype(k)) for c, k in zip(out, kinds, strict=True)], names=["key", "mask", "pos", "seed"])

    common.small_batches(spark)
    of_texts = texts.select("key", "text").mapInArrow(looked_up, "key long, mask int, pos long, seed long")
    # both sides may have a seed often: rows of a seed are dealt by the text's side and copied on the item's
    salt = F.pmod(F.xxhash64("key", "pos"), F.lit(config.salts)).cast("int")
    copies = of_items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(config.salts - 1))))
    hits = (of_texts.withColumn("salt", salt).join(copies, ["mask", "seed", "salt"])
            .select("key", "item_key", (F.col("pos") - F.col("at")).alias("offset")).distinct())
    asked = hits.join(items.select("item_key", F.size("item").alias("size")).distinct(), "item_key").groupBy("key").agg(F.collect_list(F.struct("item_key", "offset", "size")).alias("asked"))

    def windows(batches):
        memo = common.Memo(token_hash)
        for b in batches:
            rows = []
            for key, text, wanted in zip(b.column(0).to_pylist(), common.texts_of(b.column(1)), b.column(2).to_pylist(), strict=True):
                h = tokens(text, memo)
                rows += [(key, w["item_key"], w["offset"], h[max(0, w["offset"]):max(0, w["offset"] + w["size"])].view(np.int64)) for w in wanted]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["key", "item_key", "offset", "window"])

    beside = texts.select("key", "text").dropDuplicates(["key"]).join(asked, "key").select("key", "text", "asked").mapInArrow(windows, "key long, item_key long, offset long, window array<long>")

    def verified(batches):
        for b in batches:
            rows = []
            for key, item_key, offset, window, item in zip(*(c.to_pylist() for c in b.columns), strict=True):
                before = max(0, offset)
                got = verify(np.array(item, np.int64), np.array(window, np.int64), offset - before, config)
                if got:
                    rows.append((key, item_key, got[0], got[1], got[2] + before))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=["key", "item_key", "equal_tokens", "overlap_tokens", "first_token"])

    each = beside.join(items.select("item_key", "item").dropDuplicates(["item_key"]), "item_key").select("key", "item_key", "offset", "window", "item")
    found = each.mapInArrow(verified, "key long, item_key long, equal_tokens long, overlap_tokens long, first_token long")
    rank = F.struct(F.col("equal_tokens"), (-F.col("first_token")).alias("early"), F.col("overlap_tokens"))
    best = (found.join(items.select("item_key", "item_id"), "item_key").groupBy("key", "item_id").agg(F.max(rank).alias("m"))
            .select("key", "item_id", "m.equal_tokens", "m.overlap_tokens", (-F.col("m.early")).alias("first_token")))
    return texts.select("id", "key").join(best, "key").select("id", "item_id", "equal_tokens", "overlap_tokens", "first_token")


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", config: Config = Config()) -> DataFrame:
    """(id, item_id, equal_tokens, overlap_tokens, first_token): a row for each row of ``docs`` and item it holds."""
    spark = docs.sparkSession
    common.small_batches(spark)
    block = _one_block(benchmark, item_col, item_text_col, config)
    if block is None:
        return joined(docs, benchmark, id_col, text_col, item_col, item_text_col, config)
    sent = spark.sparkContext.broadcast(block)  # of checked size: block_chars

    def run(batches):
        memo = common.Memo(token_hash)
        for b in batches:
            found = sent.value.matches(list(common.texts_of(b.column(1))), memo)
            rows = [(i, *m) for i, ms in zip(b.column(0).to_pylist(), found, strict=True) for m in ms]
            names = ["id", "item_id", "equal_tokens", "overlap_tokens", "first_token"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=names)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, MATCH)


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
          config: Config = Config()) -> DataFrame:
    """The rows of ``docs`` that hold no item, with the columns of ``docs``."""
    spark = docs.sparkSession
    common.small_batches(spark)
    block = _one_block(benchmark, item_col, item_text_col, config)
    if block is None:
        # equal texts are one; the hash stands for the id
        keyed = docs.select(F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")).dropDuplicates(["key"])
        gone = joined(keyed, benchmark, "key", "text", item_col, item_text_col, config).select("id").distinct()
        return docs.join(gone, F.xxhash64(docs[text_col]) == gone["id"], "left_anti")
    at = docs.columns.index(text_col)
    sent = spark.sparkContext.broadcast(block)  # of checked size: block_chars

    def run(batches):
        memo = common.Memo(token_hash)
        for b in batches:
            found = sent.value.matches(list(common.texts_of(b.column(at))), memo)
            yield b.filter(pa.array([not m for m in found], pa.bool_()))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
