"""Helpers shared by the operators: reading, checkpoints, names, batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of one Arrow batch.  Texts may be long; a Python worker holds a few of
#: these at a time, whatever the table's size.  A row that is larger is a batch.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds for the Python stages of a query."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    A local session without one gets a temporary folder of its machine; a
    cluster without one is an error, as its executors could not share such a folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="paperloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Runs ``df`` once and keeps its rows in the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) mod ``modulus`` is ``remainder``; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def class_bounds(rows: DataFrame, class_col: str, per_class: int) -> list[tuple]:
    """(class, rows, bound): a row of the class is in the sample if its ``sample_rank`` is under the bound.

    One aggregation, however many classes there are.  The rank is uniform, so
    ``per_class`` rows are expected under a bound, and a tenth more are let through
    for ``per_class`` to be there in the end.
    """
    counts = rows.filter(F.col(class_col).isNotNull()).groupBy(class_col).count().collect()
    return [(c, n, (1 << 62) if n <= per_class else int((1 << 62) * (1.1 * per_class + 50) / n)) for c, n in sorted(counts)]


def sample_rank(*of: str) -> Column:
    """A number from 0 to 2^62 by a hash: an order that does not depend on how rows lie in files."""
    return F.shiftrightunsigned(F.xxhash64(*(F.col(c).cast("string") for c in of), F.lit("sample")), 2)


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str,
                   modulus: int, remainder: int, per_class: int, most_chars: int = 24_000_000) -> tuple[list[str], np.ndarray, dict]:
    """A bounded sample of training texts, their labels, and how often each label occurs.

    At most ``per_class`` rows of each label, those of the least hash of their id,
    and of these as many, in that order, as ``most_chars`` code points allow; every
    picked text is whole.  Rows of the held-out fold (``modulus``, ``remainder``) and
    null labels are never training rows.  Repeated ids count once each time they
    occur in ``docs``.
    """
    spark = docs.sparkSession
    train = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"))
             .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & ~in_fold(F.col("id"), modulus, remainder)))
    bounds = class_bounds(train, "label", per_class)
    freq = {c: n for c, n, _ in bounds}
    if not bounds:
        return [], np.zeros(0, np.int64), freq
    limit = F.coalesce(*(F.when(F.col("label") == c, F.lit(most)) for c, _, most in bounds))
    found = sorted(train.withColumn("rank", sample_rank("id")).filter(F.col("rank") < limit).select("label", "rank", "id").collect())
    picked, taken = {}, dict.fromkeys(freq, 0)
    for label, _, i in found:
        if taken[label] < per_class and i not in picked:
            picked[i] = (label, taken[label])
            taken[label] += 1
    chosen = spark.createDataFrame([(i, *x) for i, x in picked.items()], "id long, label long, place long")
    # at most per_class rows of three numbers for each class: small enough to broadcast, by construction
    whole = (docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
             .join(F.broadcast(chosen), "id"))
    sizes = sorted(map(tuple, whole.select("place", "id", F.char_length("text")).collect()))
    total, until = 0, per_class
    for place, _, size in sizes:
        total += size
        if total > most_chars and place:
            until = place
            break
    got = sorted((r["id"], r["text"], r["label"]) for r in whole.filter(F.col("place") < until).collect())
    return [r[1] for r in got], np.array([r[2] for r in got], np.int64), freq


class Memo(dict):
    """A dict that computes missing values and holds ``room`` bytes at most.  Long strings are not kept.

    When half the room is taken, what it holds becomes the older half, from which
    values that are asked for again come back, and the half before that goes.
    """

    def __init__(self, make, room: int = 32 << 20):
        super().__init__()
        self.make, self.room, self.took, self.older = make, room, 0, {}

    def __missing__(self, key):
        value = self.older.get(key, self)
        if value is self:
            value = self.make(key)
        if type(key) is not str or len(key) <= 64:
            # an entry's share of the table, the key and the value
            self.took += 90 + sys.getsizeof(key) + sys.getsizeof(value)
            if self.took > self.room // 2:
                self.older = dict(self)
                self.clear()
                self.took = 0
            self[key] = value
        return value


def bind(value: Column, use) -> Column:
    """``use`` of a value that is computed once: a lambda's variable is how a column function binds one."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def give_back() -> None:
    """Hands memory that training has freed back to the machine, where the C library can."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def texts_of(column) -> Iterable[str]:
    """The strings of an Arrow column, nulls as empty."""
    return (x or "" for x in column.to_pylist())


def blocks(batches: Iterable[pa.RecordBatch], rows: int) -> Iterable[pa.Table]:
    """Batches of narrow rows, put together to tables of about ``rows`` rows; no empty ones."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def plus(df: DataFrame, *more: tuple[str, T.DataType]) -> T.StructType:
    """The schema of ``df`` with further columns."""
    return T.StructType([*df.schema.fields, *(T.StructField(name, kind) for name, kind in more)])


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], spread: list[str], salts: int = 8) -> DataFrame:
    """Inner join of ``many`` with ``one``, which has a row for each key at most and comes from an aggregation by it.

    Rows of a hot key go to ``salts`` places by a hash of ``spread``, and the key's
    row to each of them.  Without the salt the join would take over the
    aggregation's partitions, and Spark could then not split a skewed one.
    """
    salt = fresh(many, "salt")
    dealt = many.withColumn(salt, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = one.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*keys, salt]).drop(salt)
