"""WARC archives: records with segments and chunked framing, written and read back.

Writing: each row's payload becomes one record: an HTTP response whose body is
sent in chunks.  Of rows with equal payloads of ``least`` bytes or more, the one
with the least id is the response; others become revisit records, which name it
and have no body.  A record longer than ``segment`` bytes is cut: the first
part stays in the response record, with segment number 1, and the others are
continuation records that name its record id as their origin; the last one
states the total length.  Record ids are made from the row's id and its payload's
digest.  Rows with a null payload have an empty one; rows with a null id, and
rows that repeat an id with the least of equal payloads, are responses.

Reading takes any archive, its own and others: records are parsed one by one,
continuation records are grouped by their origin and put in order by segment
number, numbers and total length are verified, and the HTTP message is decoded
from its chunks.  Groups are as large as one record was, whatever the size of the
archive; where all segments come several times, so does the record.  Payload
digests of any algorithm of ``ALGORITHMS``, in hexadecimal or base 32, are
verified; others are taken as they are.  What is broken becomes a row with a
``problem``, and reading goes on with the next record.

Archives are files of Spark's text writer: a record is one row that ends in the
first of its two closing line ends, and the writer adds the second.  So they
can be written to, and read from, any store that Spark reaches.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space for URLs


@dataclass(frozen=True)
class Config:
    least: int = 100  #: bytes of the shortest payload that is not repeated
    segment: int = 48 * 1024  #: bytes of a record's block, at most
    chunk: int = 8 * 1024  #: bytes of a chunk of the HTTP body
    records_per_file: int = 512  #: so that a reader's task holds records_per_file * segment bytes at most
    salts: int = 8  #: places that rows of one payload are dealt to
    date: str = "1970-01-01T00:00:00Z"  #: archives of equal rows are equal


#: Digest algorithms of public archives and the bytes of each.
ALGORITHMS = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}


def record_id(row_id: int | None, digest: str, number: int = 1) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{row_id}/{digest}/{number}')}>"


def chunked(body: bytes, size: int) -> bytes:
    """HTTP/1.1 chunked framing."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (body[i:i + size] for i in range(0, len(body), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The body of a chunked message; ValueError if the framing is broken.  Chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk without size")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk of another size")
        out.append(body[at:at + size])
        at += size + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the last of its closing line ends."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    return VERSION + head.encode() + b"\r\n" + block + b"\r\n"


def records(row_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, config: Config) -> Iterator[bytes]:
    """The records of one row; ``digest`` is the payload's SHA-256 in hexadecimal, ``first`` the id of the row that it repeats."""
    own_id = record_id(row_id, digest)
    row = [] if row_id is None else [("WARC-Row", row_id)]
    base = [("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", "", url or "") or f"urn:row:{row_id}"), ("WARC-Date", config.date)]
    told = [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if first is not None:
        profile = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first, digest))]
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", own_id), *row, *base, *profile, *told], http)
        return
    block = http + chunked(payload, config.chunk)
    pieces = [block[i:i + config.segment] for i in range(0, len(block), config.segment)]
    for n, piece in enumerate(pieces, 1):
        if n == 1:
            own = [("WARC-Type", "response"), ("WARC-Record-ID", own_id), *row, *base, *told]
        else:
            own = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(row_id, digest, n)), *base, ("WARC-Segment-Origin-ID", own_id)]
        if len(pieces) > 1:
            own += [("WARC-Segment-Number", n)]
            own += [("WARC-Segment-Total-Length", len(block))] if n == len(pieces) else []
        yield record(own, piece)


def write(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", config: Config = Config()) -> None:
    """Writes one record a row, and continuation records, to gzipped archives in ``path``."""
    common.small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("row_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    often = (rows.filter(F.octet_length("payload") >= config.least).groupBy("digest")
             .agg(F.min("row_id").alias("first"), F.max("row_id").alias("last")).filter("first <> last").select("digest", "first"))
    # rows of a frequent payload are dealt to several places, and its first row's id is sent to each
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(config.salts)).cast("int"))
    copies = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(config.salts - 1))))
    joined = salted.join(copies, ["digest", "salt"], "left").select("row_id", "url", "payload", "digest", F.when(F.col("row_id") != F.col("first"), F.col("first")).alias("first"))

    def run(batches):
        for b in batches:
            found = [r for row in zip(*(c.to_pylist() for c in b.columns), strict=True) for r in records(*row, config)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["record"])

    (joined.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.mode("overwrite").option("lineSep", "\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", config.records_per_file).text(path))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(headers with lower-case names, block, problem) of the records in an uncompressed archive."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            # what is no record, up to where one may start
            then = data.find(b"\nWARC/", at) + 1 or len(data)
            if data[at:then].strip(b"\r\n"):
                yield {}, data[at:then], "no record"
            at = then
            continue
        start = data.find(b"\n", at) + 1
        gap = re.compile(rb"\r?\n\r?\n").search(data, start - 1) if start else None
        if gap is None:
            yield {}, data[at:], "cut short"
            return
        lines = re.sub(r"\r?\n[ \t]+", " ", data[start:gap.start()].decode("utf-8", "replace"))  # a folded line goes on
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in re.split(r"\r?\n", lines) if x)}
        size = headers.get("content-length", "")
        if not re.fullmatch(r"[0-9]+", size):
            then = data.find(b"\nWARC/", gap.end() - 1) + 1 or len(data)
            yield headers, data[gap.end():then], "no length"
            at = then
            continue
        block = data[gap.end():gap.end() + int(size)]
        if len(block) < int(size):
            yield headers, block, "cut short"
            return
        yield headers, block, None
        at = gap.end() + int(size)
        while data[at:at + 1] in (b"\r", b"\n") and at < len(data):
            at += 1


def inflated(data: bytes) -> tuple[bytes, bool]:
    """The bytes of an archive, gzipped as a whole, by record, or not at all, and whether all of them could be read."""
    if data[:2] != b"\x1f\x8b":
        return data, True
    out = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        try:
            out.append(d.decompress(data))
        except zlib.error:
            return b"".join(out), False
        if not d.eof:
            return b"".join(out), False
        data = d.unused_data
    return b"".join(out), True


def agrees(payload: bytes, digest: str) -> bool | None:
    """Whether a payload has a digest, ``algorithm:value``; None where that cannot be told."""
    name, _, value = digest.partition(":")
    size = ALGORITHMS.get(name.lower().replace("-", ""))
    if size is None or not value:
        return None
    own = hashlib.new(name.lower().replace("-", ""), payload).digest()
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def body(message: bytes) -> bytes:
    """The payload of an HTTP message."""
    head, _, rest = message.partition(END)
    return unchunked(rest) if re.search(rb"(?im)^transfer-encoding:.*\bchunked\b", head) else rest


PART = ("record_id string, origin string, number int, total long, block binary, row_id long, url string, type string, refers_to_id string, "
        "digest string, payload binary, payload_bytes long, problem string")
FOUND = "record_id string, row_id long, url string, type string, refers_to_id string, digest string, payload binary, payload_bytes long, problem string"
KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _in_batches(rows: Iterable[tuple], schema: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of about ``most`` bytes of binaries."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, bytes)) + 200
        if size > most:
            yield _batch(schema, held)
            held, size = [], 0
    if held:
        yield _batch(schema, held)


def _whole_number(text: str | None, bits: int) -> int | None:
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,18}", text) and abs(int(text)) < 1 << bits else None


def _digest(h: dict[str, str]) -> str | None:
    """SHA-256 in hexadecimal bare, others with their algorithm."""
    value = h.get("warc-payload-digest")
    bare = (value or "").removeprefix("sha256:")
    return bare.lower() if re.fullmatch("[0-9a-fA-F]{64}", bare) else value


def decoded(kind: str | None, http: bool, digest: str | None, message: bytes, keep: bool) -> tuple[bytes | None, int | None, str | None]:
    """(payload, its bytes, problem) of a whole record."""
    if kind == "revisit":
        return None, None, None
    try:
        payload = body(message) if http else message
    except ValueError as e:
        return None, None, str(e)
    if digest and agrees(payload, digest if ":" in digest else f"sha256:{digest}") is False:
        return None, None, "another digest"
    return payload if keep else None, len(payload), None


def _parts(content: bytes, keep: bool) -> Iterator[tuple]:
    """The rows of PART that an archive holds: whole records decoded, segments with their blocks."""
    data, all_read = inflated(content)
    for h, block, problem in parse(data):
        number, kind, digest = _whole_number(h.get("warc-segment-number"), 31), h.get("warc-type"), _digest(h)
        name = h.get("warc-record-id")
        head = (_whole_number(h.get("warc-row"), 63), h.get("warc-target-uri"), kind, h.get("warc-refers-to"), digest)
        if problem is None and number is not None:
            origin = h.get("warc-segment-origin-id", name)
            yield name, origin, number, _whole_number(h.get("warc-segment-total-length"), 63), block, *head, None, None, None
            continue
        if problem is None and kind == "continuation":
            problem = "no segment number"
        found = (None, None, problem) if problem else decoded(kind, h.get("content-type", "").startswith("application/http"), digest, block, keep)
        yield name, None, None, None, None, *head, *found
    if not all_read:
        yield *[None] * 12, "archive cut short"


def read_parts(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives in ``path``: whole ones decoded, segments of cut ones (``number`` is not null) with their blocks."""
    common.small_batches(spark)

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            for content in b.column(0).to_pylist():
                yield from _in_batches(_parts(content, payload), PART)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, PART)


def reassembled(segments: list[dict], total: int | None, head: dict | None, keep: bool) -> list[tuple]:
    """The rows of FOUND that the segments of one origin make; ``segments`` are in order."""
    h = head or {}
    kind, digest = h.get("type"), h.get("digest")
    numbers = [s["number"] for s in segments]
    times = numbers.count(1)
    # where every segment comes several times, and is the same, so does the record
    alike = times > 1 and all(segments[i] == segments[i - i % times] for i in range(len(segments)))
    once = segments[::times] if alike else segments
    message = b"".join(s["block"] for s in once)
    found, problem = (None, None, None), None
    if not head:
        problem = "no origin"
    elif [s["number"] for s in once] != list(range(1, len(once) + 1)):
        problem = "segments missing or repeated"
    elif total != len(message):
        problem = "another total length"
    else:
        found = decoded(kind, h["http"], digest, message, keep)
    row = h.get("record_id"), h.get("row_id"), h.get("url"), kind, h.get("refers_to_id"), digest, *(found[:2] if problem is None else (None, None)), problem or found[2]
    return [row] * (times if alike else 1)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The columns of FOUND: one row a record that is no continuation, or a stretch of an archive that is none.

    ``problem`` says what is wrong with a record: a segment that is missing or
    comes twice, a total length or digest that does not hold, broken framing, a
    length that is not there, or an end that is; the payload is null then.  A
    revisit's payload and its length are null too; see ``resolve``.  ``row_id`` is
    null in archives that ``write`` did not make.

    A record without a segment number is whole and decoded where it is read.
    Only cut ones are grouped, by their origin.  Without ``payload`` records are
    verified all the same, and what was read is kept by a checkpoint, as it is
    narrow, so that archives are read once; with it they are read twice.
    """
    parts = read_parts(spark, path, payload)
    if not payload:
        parts = common.cut(parts)

    def together(batches):
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            yield _batch(FOUND, [r for row in rows for r in reassembled(*row, payload)])

    names = [x.split()[0] for x in FOUND.split(", ")]
    first = F.struct("record_id", "row_id", "url", "type", "refers_to_id", "digest", F.lit(True).alias("http"))
    cut = (parts.filter("number is not null").groupBy("origin")
           .agg(F.sort_array(F.collect_list(F.struct("number", "block"))).alias("segments"), F.max("total").alias("total"),
                F.first(F.when(F.col("type") != "continuation", first), True).alias("head"))
           .select("segments", "total", "head").mapInArrow(together, FOUND))
    return parts.filter("number is null").select(*names).unionByName(cut)


def resolve(found: DataFrame) -> DataFrame:
    """``found`` with ``refers_to``, the row of the record that a revisit names, and the ``payload_bytes`` of revisits taken from it."""
    there = (found.filter("type = 'response' and record_id is not null").groupBy("record_id")
             .agg(F.min("row_id").alias("refers_to"), F.max("payload_bytes").alias("there")).withColumnRenamed("record_id", "at"))
    return (found.join(there, found.refers_to_id == there["at"], "left")
            .withColumn("payload_bytes", F.coalesce("payload_bytes", "there")).drop("at", "there"))
