"""Uploaded files: validation, routing, limits, and the field store's sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: what an upload may be, and what its first bytes must be
UPLOAD_MAGIC = {"pdf": ("25504446",), "png": ("89504E470D0A1A0A",), "jpg": ("FFD8FF",), "jpeg": ("FFD8FF",), "svg": ()}
PIPELINE_EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp", "svg")
UPLOAD_BYTES = 5 * 1024 * 1024
PIPELINE_BYTES = 25 * 1024 * 1024
LEAST_SIDE, MOST_SIDE, MOST_PIXELS, LONG_EDGE = 80, 6000, 25_000_000, 3200


def scan(spark: SparkSession, path: str, *, pattern: str = "*", content: bool = True) -> DataFrame:
    """(path, name, ext, length, modified, content) of the files under ``path``; without ``content`` no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("ext"), "length", F.col("modificationTime").alias("modified"), "content")
    return out if content else out.drop("content")


def reject_reason(ext: Column, content: Column, *, most_bytes: int = UPLOAD_BYTES) -> Column:
    """Why an upload is refused, tested in this order: extension, emptiness, first bytes, size; null if it is taken."""
    head = F.hex(F.substring(content, 1, 8))
    fits = F.lit(False)
    for e, marks in UPLOAD_MAGIC.items():
        for m in marks or ("",):
            fits = fits | ((ext == e) & F.startswith(head, F.lit(m)))
    return (F.when(~F.coalesce(ext.isin(*UPLOAD_MAGIC), F.lit(False)), "extension").when(F.coalesce(F.octet_length(content), F.lit(0)) == 0, "empty")
            .when(~fits, "content").when(F.octet_length(content) > most_bytes, "size"))


def validated(files: DataFrame, *, most_bytes: int = UPLOAD_BYTES) -> DataFrame:
    return files.withColumn("reject_reason", reject_reason(F.col("ext"), F.col("content"), most_bytes=most_bytes))


def within_limits(width: Column, height: Column) -> Column:
    return (F.least(width, height) >= LEAST_SIDE) & (F.greatest(width, height) <= MOST_SIDE) & (width.cast("bigint") * height <= MOST_PIXELS)


def scaled(width: Column, height: Column) -> Column:
    """Width and height brought down so that the long edge is at most LONG_EDGE."""
    by = F.least(F.lit(1.0), F.lit(float(LONG_EDGE)) / F.greatest(width, height))
    return F.struct(F.greatest(F.lit(1), F.round(width * by)).cast("int").alias("width"), F.greatest(F.lit(1), F.round(height * by)).cast("int").alias("height"))


def route(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files for the native path (pdf) and for the image path (all else)."""
    return files.filter("ext = 'pdf'"), files.filter("ext is null or ext <> 'pdf'")


def needs_ocr(text: Column, least: int = 24) -> Column:
    """Whether a page's own text is too short to go without recognition."""
    return F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)\\s+", "")) < least


def object_key(ext: Column, uploaded: Column, identity: Column) -> Column:
    """A dated key under which an upload is kept; equal uploads have equal keys."""
    return F.concat(F.lit("uploads/"), F.date_format(uploaded, "yyyy-MM-dd"), F.lit("/"), F.substring(F.sha2(identity.cast("string"), 256), 1, 32), F.lit("_"), F.date_format(uploaded, "HHmmss"), F.lit("."), ext)


def write_fields(fields: DataFrame, path: str) -> None:
    """Replaces the fields of the jobs at hand and leaves those of all other jobs; running it again changes nothing.

    Jobs are dealt to a fixed number of buckets, so that the number of folders does not grow with jobs.
    """
    spark = fields.sparkSession
    bucket = F.pmod(F.xxhash64("job_id"), F.lit(BUCKETS)).cast("int")
    fresh = fields.withColumn("bucket", bucket)
    try:
        old = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        fresh.write.partitionBy("bucket").parquet(path)
        return
    touched = fresh.select("bucket").distinct()  # BUCKETS rows at most
    kept = old.join(F.broadcast(touched), "bucket").join(fresh.select("job_id").distinct(), "job_id", "left_anti").select(*fresh.columns)
    kept.unionByName(fresh).checkpoint().write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


BUCKETS = 64


def write_exports(exports: DataFrame, path: str) -> None:
    """Appends exports (job_id, exported_data) with the time they were made."""
    exports.withColumn("exported_at", F.current_timestamp()).write.mode("append").parquet(path)


def write_json(documents: DataFrame, path: str, *, column: str = "json") -> None:
    """One JSON document a line."""
    documents.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
