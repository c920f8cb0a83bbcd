"""Web archives: one transaction of three records per capture, written by Spark and put together again when read.

The reference project keeps no web captures, so this operator is general: a capture is an id, an address and a payload.

``write_archives`` writes a response, a request and a metadata record for every capture; the latter two name the response
in WARC-Concurrent-To. A payload of at least ``REVISIT_BYTES`` that several captures share is stored once, by the smallest
id; the others become revisit records that refer to it. ``read_captures`` parses the files record by record, joins the
three records of a transaction through the concurrent-to identifiers and emits one nested row per capture.

Files are written by Spark's own text writer, so any store Spark can write to will do, and a repeated task replaces its
file. A file is one gzip stream of at most ``FILE_RECORDS`` captures and is read as a stream.
"""
from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REVISIT_BYTES = 100
FILE_RECORDS = 1000
BATCH_BYTES = 16 << 20
CRLF = "\r\n"
#: every capture gets this date, so that archives written again are equal
WRITTEN = "2000-01-01T00:00:00Z"
RECORD_TYPES = ("response", "revisit", "request", "metadata")


def _record_id(kind: str, capture: Column) -> Column:
    return F.concat(F.lit(f"<urn:capture:{kind}:"), capture, F.lit(">"))


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """One record with its two closing line ends; a header whose value is null is left out."""
    lines = [F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value)) for name, value in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), *lines, length), F.lit(CRLF * 2), block, F.lit(CRLF * 2))


def digest_of(payload: Column) -> Column:
    return F.sha2(payload.cast("binary"), 256)


def captures_of(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """One row per capture with its digest and, where the payload is a repeated one, the capture that stores it.

    A missing payload is empty. Rows that repeat id, address and payload are one capture; rows without an id are none.
    The choice of the storing capture runs on ids and digests alone; payloads are joined by their id, so a payload that
    a third of all captures share does not meet in one task.
    """
    rows = pages.filter(F.col(page_id).isNotNull()).select(
        F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"),
        F.coalesce(F.col(payload), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": digest_of(F.col("html")), "bytes": F.octet_length("html").cast("long")})
    slim = rows.filter(F.col("bytes") >= REVISIT_BYTES).select("page_id", "digest")
    stores = slim.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id")).filter(
        "first_id < last_id").drop("last_id")  # payloads that one capture holds alone need no look-up
    revisits = slim.join(stores, "digest").filter("page_id > first_id").select("page_id", "digest", "first_id").distinct()
    return rows.join(revisits, ["page_id", "digest"], "left").select(
        "page_id", "url", "html", "digest", "bytes", F.col("first_id").alias("refers_to")).dropDuplicates(
        ["page_id", "url", "digest"])


def write_archives(captures: DataFrame, folder: str) -> None:
    """Write the captures of ``captures_of`` as gzip archives into a folder that Spark can write to."""
    number = F.col("page_id").cast("string")
    revisit = F.col("refers_to").isNotNull()
    kind = F.when(revisit, "revisit").otherwise("response")
    # the address of a capture may repeat under another id or payload, never with both
    capture = F.concat_ws("-", number, F.substring("digest", 1, 16), F.substring(F.sha2("url", 256), 1, 16))
    head = F.concat(F.lit(CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "])),
                    F.col("bytes").cast("string"), F.lit(CRLF * 2))
    target = F.regexp_replace("url", r"[\x00-\x20\x7F]", "")  # a header is one line
    common = [("WARC-Date", WRITTEN), ("WARC-Target-URI", target)]
    own = _record_id("response", capture)
    held = _record(
        [("WARC-Type", kind), ("WARC-Record-ID", own), *common, ("X-Capture-ID", number),
         ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), ("X-Payload-Length", F.col("bytes").cast("string")),
         ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
         ("X-Refers-To-Capture", F.col("refers_to").cast("string")),
         ("Content-Type", "application/http; msgtype=response")],
        F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("html"))))
    asked = _record([("WARC-Type", "request"), ("WARC-Record-ID", _record_id("request", capture)), *common,
                     ("WARC-Concurrent-To", own), ("Content-Type", "application/http; msgtype=request")],
                    F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1" + CRLF * 2)))
    told = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", _record_id("metadata", capture)), *common,
                    ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")],
                   F.concat(F.lit("capture: "), number, F.lit(CRLF)))
    # the text writer ends each row with a line feed: the last one of the transaction
    rows = captures.select(F.concat(held, asked, told).alias("value")).select(
        F.expr("substring(value, 1, length(value) - 1)").alias("value"))
    rows.write.mode("overwrite").option("lineSep", "\n").option("compression", "gzip").option(
        "maxRecordsPerFile", FILE_RECORDS).text(folder)


RECORD_SCHEMA = ("record_type string, record_id string, concurrent_to string, url string, date string, page_id bigint, "
                 "payload_digest string, payload_bytes bigint, refers_to bigint, block binary")
_ARROW = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("url", pa.string()),
                    ("date", pa.string()), ("page_id", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                    ("refers_to", pa.int64()), ("block", pa.binary())])


class _Stream(io.RawIOBase):
    """The text of a gzip file, unpacked as it is read."""

    def __init__(self, packed: bytes):
        self.packed, self.at, self.engine, self.ready = memoryview(packed), 0, zlib.decompressobj(47), b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.ready and self.at < len(self.packed):
            chunk = self.packed[self.at:self.at + (1 << 16)]
            self.at += len(chunk)
            self.ready = self.engine.decompress(chunk)
            if self.engine.eof and self.engine.unused_data:  # the next member
                self.at -= len(self.engine.unused_data)
                self.engine = zlib.decompressobj(47)
        n = min(len(buffer), len(self.ready))
        buffer[:n] = self.ready[:n]
        self.ready = self.ready[n:]
        return n


def parse_records(packed: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, by its Content-Length; a file cut off within a record raises ValueError."""
    stream = io.BufferedReader(_Stream(packed), 1 << 16)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers.get("content-length", -1))
        block = stream.read(length) if length >= 0 else b""
        if length < 0 or len(block) < length:
            raise ValueError("the file ends within a record")
        yield headers, block


def _row(headers: dict[str, str], block: bytes, payload: bool) -> tuple:
    kind = headers.get("warc-type")
    number = lambda name: int(headers[name]) if name in headers else None
    body = block.partition(b"\r\n\r\n")[2] if kind in ("response", "revisit") else block
    # a response's digest is that of the bytes read, so a payload damaged on the way shows; a revisit has only the stated one
    stated = headers.get("warc-payload-digest", "").rpartition(":")[2] or None
    digest = hashlib.sha256(body).hexdigest() if kind == "response" else stated
    size = number("x-payload-length") if kind == "revisit" else len(body) if kind == "response" else None
    return (kind, headers.get("warc-record-id"), headers.get("warc-concurrent-to"), headers.get("warc-target-uri"),
            headers.get("warc-date"), number("x-capture-id"), digest, size, number("x-refers-to-capture"), body if payload else None)


def read_records(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """One row per record of the archives in a folder."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for packed in batch.column("content"):
                for headers, block in parse_records(packed.as_py()):
                    rows.append(_row(headers, block, payload))
                    held += len(block) if payload else 200
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInArrow(parse, RECORD_SCHEMA)


def read_captures(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """One nested row per capture: ``page_id``, ``response``, ``request``, ``metadata``.

    The request and metadata records name the response they belong to; where one is missing its column is null, and
    records whose response is missing give no row. ``payload=False`` leaves the blocks out, so they are not shuffled.
    """
    records = read_records(spark, folder, payload)
    main = F.col("record_type").isin("response", "revisit")
    fields = ("record_type", "record_id", "url", "date", "payload_digest", "payload_bytes", "refers_to", "block")
    # the transaction's key is the id of its response: a record's own, or the one it is concurrent to
    keyed = records.withColumn("capture", F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to")))

    def of(condition: Column, *names: str) -> Column:
        return F.first(F.when(condition, F.struct(*names)), ignorenulls=True)

    return keyed.groupBy("capture").agg(
        F.first(F.when(main, F.col("page_id")), ignorenulls=True).alias("page_id"), of(main, *fields).alias("response"),
        of(F.col("record_type") == "request", "record_id", "url", "date", "block").alias("request"),
        of(F.col("record_type") == "metadata", "record_id", "url", "date", "block").alias("metadata"),
    ).filter("response IS NOT NULL").drop("capture")
