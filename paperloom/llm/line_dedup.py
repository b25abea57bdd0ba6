"""Line dedup with DataFrame functions alone.

A text's lines are its parts between newlines; a null or empty text is one
empty line.  A line's key is the line with white space stripped at both ends
and A-Z lower-cased.  Keys of ``least_chars`` code points or more that occur in
``min_docs`` documents or more lose all their lines but those of the least id
that holds them.  The lines left, joined by newlines, are the new text.

Documents are told by id: rows that repeat an id are one document in the count,
and each keeps or loses its own lines as that document does.  Rows with a null
id are not counted and keep all their lines.  Equal keys are told by 128 bits
of hash, rows with one id by a hash of their text.

What is shuffled is 16 bytes of hash, an id and a position for each line that
may go, and each text once.  A key is never gathered: the count is an
aggregation with map-side combine, and the join back is one that Spark may
split where one key has very many lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: ASCII white space: space and \x09-\x0D.
BLANK = "[\\x20\\x09-\\x0D]"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit("\x20\x09\x0a\x0b\x0c\x0d")))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, least_chars: int, min_docs: int) -> DataFrame:
    """(id, text_hash, drop): of each row that loses lines, their positions, from 0."""
    keys = F.transform(_lines(F.col(text_col)), key)
    # the hash is taken below the explosion: above it, it would be taken of the whole text for every line
    rows = (docs.filter(F.col(id_col).isNotNull())
            .select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), keys.alias("keys")))
    found = (rows.select("id", "text_hash", F.posexplode("keys").alias("pos", "key"))
             .filter(F.char_length("key") >= least_chars)
             .select("id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), F.col("key")).alias("h2")))
    if min_docs == 2:
        # at least two documents: the least and the greatest id differ
        often = found.groupBy("h1", "h2").agg(F.min("id").alias("keeper"), F.max("id").alias("last")).filter("keeper <> last")
    else:
        once = found.select("h1", "h2", "id").distinct()
        often = once.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("keeper")).filter(F.col("n") >= min_docs)
    gone = common.salted_join(found, often.select("h1", "h2", "keeper"), ["h1", "h2"], ["id"]).filter("id <> keeper")
    return gone.groupBy("id", "text_hash").agg(F.collect_set("pos").alias("drop"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with the text rebuilt, and ``n_lines`` (before) and ``n_dropped``; columns of these names are replaced."""
    kept = docs.drop("n_lines", "n_dropped")
    gone = repeated_lines(docs, id_col, text_col, least_chars, min_docs)
    own_id, own_hash, drop = (common.fresh(kept, c) for c in ("dropped_id", "dropped_text", "dropped_lines"))
    gone = gone.toDF(own_id, own_hash, drop)
    joined = kept.join(gone, (kept[id_col] == gone[own_id]) & (F.xxhash64(kept[text_col]) == gone[own_hash]), "left")
    none = F.col(drop).isNull()

    def rebuilt(parts: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(drop))
        return F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")

    # the split is bound once: within the lambda of each kept line it would be made anew
    text = F.when(none, F.col(text_col)).otherwise(common.bind(_lines(F.col(text_col)), rebuilt))
    breaks = F.char_length(F.coalesce(F.col(text_col), F.lit(""))) - F.char_length(F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\n"), F.lit("")))
    counted = joined.withColumns({"n_lines": (breaks + 1).cast("long"), "n_dropped": F.when(none, 0).otherwise(F.size(drop)).cast("long")})
    return counted.withColumn(text_col, text).select(*kept.columns, "n_lines", "n_dropped")
