"""Substring dedup by sliding sentence spans.

A text is cut into sentences after . ! or ? with white space behind, and at
newlines.  From every sentence on, the shortest run of consecutive sentences
that has ``words`` words is hashed, and so is the shortest that ends at every
sentence; a sentence of that many words is a run by itself (96 bits, white
space within a sentence squeezed).  So each sentence of a repeated passage of
``words`` words is in a run that lies within the passage.

A run found more than once is repeated.  Within a document its first place
stays; between documents that of the least id does.  Sentences covered by any
run at another place go, and what is left is put together again as it stood.

Rows that repeat an id are one document: a run that only they share stays in
all of them, and a run is looked up by id and a hash of the text.  Null ids: the
row is left as it is.  Null and empty texts have no sentences.

No run is gathered: the least and greatest id of a run come from an aggregation
with map-side combine, and the join back with all places is one that Spark may
split where one run has very many.  A run's later places in one document are
told where the document is read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from . import common

#: A run of white space is looked at once, from its start, so that blanks cost linear time.
GAP = re.compile(r"(?<=[.!?])\s+|(?<!\s)\s*\n\s*")


@dataclass(frozen=True)
class Config:
    words: int = 15  #: words of a run, at least
    salts: int = 4  #: places that the rows of one run are dealt to


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence, in code points."""
    out, at = [], 0
    for m in GAP.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def runs(text: str, config: Config) -> list[tuple[int, int, bytes]]:
    """(first sentence, sentences, digest) of every run that counts."""
    parts = [text[a:b].split() for a, b in sentences(text)]
    words = np.cumsum([0, *map(len, parts)])
    keys = [" ".join(p).encode("utf-8", "surrogatepass") for p in parts]
    n = len(parts)
    until = np.searchsorted(words, words[:-1] + config.words).tolist()
    since = (np.searchsorted(words, words[1:] - config.words, "right") - 1).tolist()
    spans = {(i, j) for i, j in enumerate(until) if j <= n} | {(i, j + 1) for j, i in enumerate(since) if i >= 0}
    return [(i, j - i, xxh3_128_digest(b"\n".join(keys[i:j]))[:12]) for i, j in sorted(spans)]


def without(text: str, gone: set[int]) -> str:
    """The text without the sentences of these positions; each takes the gap behind it along."""
    spans, out, at = sentences(text), [], 0
    for i, (start, _) in enumerate(spans):
        until = spans[i + 1][0] if i + 1 < len(spans) else len(text)
        if i == 0 and start > 0:
            out.append(text[:start])
        if i not in gone:
            out.append(text[start:until])
        at = until
    return "".join(out) if spans else text


def places(docs: DataFrame, id_col: str, text_col: str, config: Config) -> DataFrame:
    """(id, text_hash, at, size, h1, h2, again): every run of every document; ``again`` where the document had it before."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = [(i, h, runs(t, config)) for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), common.texts_of(b.column(2)), strict=True)]
            sizes = [len(r) for _, _, r in rows]
            again = []
            for _, _, r in rows:
                first = set()
                for _, _, digest in r:
                    again.append(digest in first)
                    first.add(digest)
            digests = np.frombuffer(b"".join(x[2] for _, _, r in rows for x in r), [("h1", "<i8"), ("h2", "<i4")])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array([r[0] for r in rows], np.int64), sizes)), pa.array(np.repeat(np.array([r[1] for r in rows], np.int32), sizes)),
                 pa.array([x[0] for _, _, r in rows for x in r], pa.int32()), pa.array([x[1] for _, _, r in rows for x in r], pa.int32()),
                 pa.array(digests["h1"].copy()), pa.array(digests["h2"].copy()), pa.array(again, pa.bool_())], names=["id", "text_hash", "at", "size", "h1", "h2", "again"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.hash(text_col).alias("text_hash"), text_col).filter("id is not null")
    return rows.mapInArrow(run, "id long, text_hash int, at int, size int, h1 long, h2 int, again boolean")


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", config: Config = Config()) -> DataFrame:
    """(id, text_hash, gone): of each row that loses sentences, their positions, from 0."""
    found = places(docs, id_col, text_col, config)
    often = (found.filter("not again").groupBy("h1", "h2").agg(F.min("id").alias("keeper"), F.max("id").alias("last"))
             .filter("keeper <> last").select("h1", "h2", "keeper"))
    # a left join, so that places are made once for both: a document's own repeats go whether others have the run or not
    salt = common.fresh(found, "salt")
    dealt = found.withColumn(salt, F.pmod(F.xxhash64("id", "at"), F.lit(config.salts)).cast("int"))
    copies = often.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(config.salts - 1))))
    later = dealt.join(copies, ["h1", "h2", salt], "left").filter("again or id <> keeper")
    return (later.select("id", "text_hash", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("s"))
            .groupBy("id", "text_hash").agg(F.collect_set("s").alias("gone")))


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", config: Config = Config()) -> DataFrame:
    """``docs`` with repeated sentences cut out of the text, and ``n_sentences_dropped``; a column of that name is replaced."""
    kept = docs.drop("n_sentences_dropped")
    names = [common.fresh(kept, c) for c in ("gone_id", "gone_text", "gone_sentences")]
    gone = repeats(docs, id_col=id_col, text_col=text_col, config=config).toDF(*names)
    joined = kept.join(gone, (kept[id_col].cast("long") == gone[names[0]]) & (F.hash(kept[text_col]) == gone[names[1]]), "left").drop(*names[:2])
    columns = kept.columns
    at = columns.index(text_col)

    def run(batches):
        for b in batches:
            lists = b.column(len(b.columns) - 1).to_pylist()
            texts = b.column(at).to_pylist()
            new = [without(t, set(g)) if g else t for t, g in zip(texts, lists, strict=True)]
            rest = [pa.array(new, pa.string()) if k == at else c for k, c in enumerate(b.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([len(g) if g else 0 for g in lists], pa.int64())], names=[*columns, "n_sentences_dropped"])

    return joined.mapInArrow(run, common.plus(kept, ("n_sentences_dropped", T.LongType())))
