"""Document fingerprints with DataFrame functions alone: threshold-scaled sketches.

A text is lower-cased and cut into words; every shingle of ``words`` words is
hashed (a text of fewer words is one shingle, one without words none), and a
sketch keeps every hash below a fixed fraction of the hash range.  As the
fraction is the same for all, the sketch of two texts together is the union of
theirs, and the share of one text's shingles that another holds can be told
from the sketches, however unequal the texts are.

A sketch always keeps the least hash, so only a text without words has an
empty one.  Where the sketch of a text or of its edited text has at most ``few``
hashes, both are compared by all their shingles; a text is compared so with the
next document where both sketches have.  A fingerprint is the sketch written as
one string, 16 hex digits a hash, in ascending (signed) order.

Null texts are empty.  Two texts without words have likeness 1; any other has
likeness 0 with them.  Equal texts have equal sketches.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common


@dataclass(frozen=True)
class Config:
    words: int = 5  #: words of a shingle
    one_in: int = 4  #: one hash in so many is kept
    few: int = 20  #: hashes of a sketch up to which a text is compared by all its shingles


def _bound(config: Config) -> int:
    return min((1 << 63) - 1, -(1 << 63) + (1 << 64) // config.one_in)


def sketch(text: Column, config: Config = Config()) -> Column:
    """The sorted distinct hashes that the sketch keeps: all under the bound, or the least one where none is."""
    n = config.words
    words = F.filter(F.split(F.lower(text), "\\s+"), lambda w: w != "")
    # words are hashed once each; a shingle is the hash of its words' hashes
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        long = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
        return F.when(F.size(h) >= n, long).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    def kept(every: Column) -> Column:
        under = F.filter(every, lambda x: x <= F.lit(_bound(config)))
        return common.bind(under, lambda u: F.when((F.size(u) > 0) | (F.size(every) == 0), u).otherwise(F.array(F.array_min(every))))

    return F.array_sort(F.array_distinct(common.bind(common.bind(hashes, shingles), kept)))


def written(sketched: Column) -> Column:
    """A sketch as one string."""
    return F.array_join(F.transform(sketched, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def whole(text: Column, config: Config = Config()) -> Column:
    """The sorted distinct hashes of all shingles."""
    return sketch(text, replace(config, one_in=1))


def likeness(a: Column, b: Column) -> Column:
    """The share of common shingles among all of both (Jaccard), from sketches."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(a) + F.size(b) - both
    return F.when(all_ == 0, F.lit(1.0)).otherwise(both / all_)


def containment(a: Column, b: Column) -> Column:
    """The share of a's shingles that b holds, from sketches; 1 for an empty a."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merge(a: Column, b: Column, config: Config = Config()) -> Column:
    """The sketch of two texts together; a lone least hash over the bound goes where the other text has one under it."""
    under = F.filter(F.array_union(a, b), lambda x: x <= F.lit(_bound(config)))
    least = F.slice(F.array_sort(F.array_union(a, b)), 1, 1)
    return F.when(F.size(under) > 0, F.array_sort(under)).otherwise(least)


def with_next(ids: DataFrame, id_col: str, other: str) -> DataFrame:
    """(id, next_id, before): for each row of distinct ids, the next id and ``other`` of the one before, in a ring.

    Ids are put in order by ranges, each range is one window, and the ends of
    ranges are joined by the least and last row of each, one of them a range.
    The ranges are fixed by a checkpoint, as Spark draws them from a sample.
    """
    spark = ids.sparkSession
    ranged = ids.select(F.col(id_col).alias("id"), F.col(other).alias("other"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = common.cut(ranged.repartitionByRange(n, "id").withColumn("part", F.spark_partition_id()))
    ends = ranged.groupBy("part").agg(F.min("id").alias("first"), F.max_by("other", "id").alias("last_other"))
    # one row a range: as many as there are shuffle partitions
    ring = Window.orderBy("part")
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lead("first").over(ring), F.first("first").over(every)).alias("first_after"),
                       F.coalesce(F.lag("last_other").over(ring), F.last("last_other").over(every)).alias("last_before"))
    own = Window.partitionBy("part").orderBy("id")
    inside = ranged.select("id", "part", F.lead("id").over(own).alias("lead"), F.lag("other").over(own).alias("lag"))
    return (inside.join(ends, "part")
            .select("id", F.coalesce("lead", "first_after").alias("next_id"), F.coalesce("lag", "last_before").alias("before")))


def fingerprint_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", config: Config = Config()) -> DataFrame:
    """Each text's sketch, that of its edited text, and how like they are.

    The edited text has its last floor(n / 4) code points replaced by the first as
    many (or all) of the next document by ascending id; after the last comes the
    first.  Returns id, n_chars, edited (text), fingerprint, edited_fingerprint,
    near_edited, near_next and contained_edited.  Rows with a null id are left
    out; of rows that repeat an id, the one of the least text stands.

    A text travels once; to the document before it goes only the piece that its
    edit needs, and the sketch.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("id is not null")
    sizes = rows.groupBy("id").agg(F.max(F.char_length("text")).alias("size"))
    order = with_next(sizes, "id", "size").select(F.col("id"), "next_id", "before")
    # who needs this document: the one before it; ``order`` is read both ways, so the row names its follower
    base = rows.groupBy("id").agg(F.min("text").alias("text")).join(order, "id").withColumn("fingerprint", sketch(F.col("text"), config))
    base = base.withColumn("all", F.when(F.size("fingerprint") <= config.few, whole(F.col("text"), config)))
    before = order.select(F.col("next_id").alias("id"), F.col("id").alias("owner"))
    given = (base.select("id", F.expr("substring(text, 1, cast(before div 4 as int))").alias("piece"), F.col("fingerprint").alias("next_fingerprint"), F.col("all").alias("next_all"))
             .join(before, "id").select(F.col("owner").alias("id"), "piece", "next_fingerprint", "next_all"))
    out = base.select("id", "text", "fingerprint", "all").join(given, "id").withColumn("n_chars", F.char_length("text").cast("long"))
    out = out.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 4 as int)), substring(piece, 1, cast(n_chars div 4 as int)))"))
    out = out.withColumn("edited_fingerprint", sketch(F.col("edited"), config))
    # the two texts of a row: all shingles where either has few
    either = F.col("all").isNotNull() | (F.size("edited_fingerprint") <= config.few)
    one, two = F.coalesce("all", whole(F.col("text"), config)), whole(F.col("edited"), config)
    near_next = (F.when(F.col("all").isNotNull() & F.col("next_all").isNotNull(), likeness(F.col("all"), F.col("next_all")))
                 .otherwise(likeness(F.col("fingerprint"), F.col("next_fingerprint"))))
    return out.select(F.col("id").alias(id_col), "n_chars", "edited", "fingerprint", "edited_fingerprint",
                      F.when(either, likeness(one, two)).otherwise(likeness(F.col("fingerprint"), F.col("edited_fingerprint"))).alias("near_edited"),
                      near_next.alias("near_next"),
                      F.when(either, containment(one, two)).otherwise(containment(F.col("fingerprint"), F.col("edited_fingerprint"))).alias("contained_edited"))
