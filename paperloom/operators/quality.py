"""Image and recognition quality as columns over a provider's measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: from where on a measure is a flag
FLAGS = {"dark": ("brightness", "<", 85.0), "bright": ("brightness", ">", 210.0), "low_contrast": ("contrast", "<", 38.0), "blurred": ("sharpness", "<", 90.0), "noisy": ("noise", ">", 9.0),
         "skewed": ("skew", "abs", 0.4), "uneven_lighting": ("shadow", ">", 0.10), "dark_borders": ("border", ">", 0.15), "document_boundary_detected": ("perspective", ">", 0.55)}


def flags(measures: DataFrame) -> Column:
    """The names of the faults that a row's measures show."""
    over = {"<": lambda c, x: c < x, ">": lambda c, x: c > x, "abs": lambda c, x: F.abs(c) > x}
    found = [F.when(over[sign](F.col(c), limit), F.lit(name)) for name, (c, sign, limit) in FLAGS.items() if c in measures.columns]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def image_score(contrast: Column, sharpness: Column, brightness: Column, foreground: Column) -> Column:
    """From 0 to 1: contrast, sharpness, brightness near 172, and a foreground of about 0.18."""
    up_to_one = lambda c: F.least(F.lit(1.0), c)
    return F.greatest(F.lit(0.0), 0.32 * up_to_one(contrast / 70.0) + 0.30 * up_to_one(sharpness / 450.0) + 0.23 * (1 - up_to_one(F.abs(brightness - 172.0) / 172.0))
                      + 0.15 * (1 - up_to_one(F.abs(foreground - 0.18) / 0.35)))


def best_of(candidates: DataFrame, score: str = "score") -> DataFrame:
    """The candidate of each document with the best score, the first of equals; ``candidate`` is its number."""
    return candidates.groupBy("doc_id").agg(F.min_by("candidate", F.struct(-F.col(score), F.col("candidate"))).alias("candidate"), F.max(score).alias(score))


def consensus(candidates: DataFrame) -> DataFrame:
    """(doc_id, consensus): 1 with under two candidates, else 0.85."""
    return candidates.groupBy("doc_id").agg(F.when(F.count("*") < 2, 1.0).otherwise(0.85).alias("consensus"))


def needs_fallback(lines: Column, chars: Column, confidence: Column) -> Column:
    """Whether recognition found so little that other languages should be tried."""
    return (lines < 4) | (chars < 40) | (confidence < 0.60)


def ocr_report(lines: DataFrame, *, low: float = 0.75, verified: float = 0.85) -> DataFrame:
    """One row a document: lines, uncertain lines, mean confidence, and the text of verified lines."""
    line = F.struct("page", "line_idx", "text", "confidence")
    g = lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("confidence") < low).alias("n_uncertain"), F.round(F.avg("confidence"), 4).alias("mean_confidence"), F.array_sort(F.collect_list(line)).alias("ls"))
    return g.withColumn("verified_text", F.array_join(F.transform(F.filter("ls", lambda x: x["confidence"] >= verified), lambda x: x["text"]), "\n")).drop("ls")
