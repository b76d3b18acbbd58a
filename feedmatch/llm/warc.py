"""WARC archives as a chunked record table.

A record is a run of rows (record, chunk_no): its bytes, header block included,
in chunks of ``chunk_bytes`` payload bytes, each with the SHA-1 of the payload
so far. Joining ``data`` over (record, chunk_no) gives a WARC/1.1 stream.
Writer and reader hold one chunk of a record at a time. The table is written by
Spark's committer to shared storage, so a lost executor costs its tasks only.

Of records with equal payloads (length and SHA-1) of at least ``min_bytes``,
that with the largest page_id is a response, the others are revisits without a
payload that refer to it; smaller payloads are all responses.

Defined results: a null html is an empty payload; a null page_id never refers
or is referred to (its records are responses); rows that repeat the largest
page_id are responses each; line ends in an url are percent-encoded, a null url
leaves its header out; other columns are ignored; an empty table writes an
empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 16
SALTS = 16
WARC_DATE = "2000-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = b"\r\n\r\n"
CHUNK_SCHEMA = "record long, chunk_no int, last boolean, data binary, sha1_so_far string"
_CHUNK = pa.schema([("record", pa.int64()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("data", pa.binary()), ("sha1_so_far", pa.string())])
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("record_type", pa.string()), ("refers_to", pa.int64())])


def _base32(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def chunks(page_id: int | None, url: str | None, payload: memoryview, refers_to: int | None, chunk_bytes: int) -> Iterator[tuple[int, bool, bytes, str]]:
    """(chunk_no, last, data, sha1 so far) of one record."""
    revisit = refers_to is not None
    digest = hashlib.sha1(payload)
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", WARC_DATE),
              ("WARC-Payload-Digest", f"sha1:{_base32(digest)}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", _urn(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    body = payload[:0] if revisit else payload
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(HTTP_HEAD) + len(body)))]
    head = ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + HTTP_HEAD
    so_far, number = hashlib.sha1(), 0
    for begin in range(0, max(1, len(body)), chunk_bytes):
        part = body[begin:begin + chunk_bytes]
        so_far.update(part)
        last = begin + chunk_bytes >= len(body)
        yield number, last, b"".join((head if not number else b"", part, END if last else b"")), _base32(so_far)
        number += 1


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write a record per page to the chunk table at ``path``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("digest", F.concat_ws("-", F.octet_length("payload"), F.sha1("payload")))
    narrow = keyed.where(F.octet_length("payload") >= min_bytes).select("page_id", "digest").where("page_id IS NOT NULL")
    first = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("refers_to > least")
    first = first.select("digest", "refers_to", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))  # a payload may be that of many pages
    salted = narrow.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    revisits = salted.join(first, ["digest", "salt"]).where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record = TaskContext.get().partitionId() << 33
        for batch in batches:
            out, held = [], 0
            for row in range(batch.num_rows):
                page_id, url, refers_to = (batch.column(c)[row].as_py() for c in ("page_id", "url", "refers_to"))
                for chunk in chunks(page_id, url, memoryview(batch.column("payload")[row].as_buffer()), refers_to, chunk_bytes):
                    out.append((record, *chunk))
                    held += len(chunk[2])
                    if held >= 4 << 20:
                        yield table(out)
                        out, held = [], 0
                record += 1
            yield table(out)

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_CHUNK)], schema=_CHUNK)

    joined = keyed.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "refers_to")
    joined.mapInArrow(records, CHUNK_SCHEMA).write.parquet(path)


class RecordReader:
    """Takes the chunks of one record in order; ``row`` checks lengths and digest."""

    def __init__(self) -> None:
        self.head: dict[str, str] | None = None
        self.digest, self.size, self.held = hashlib.sha1(), 0, b""

    def feed(self, data: memoryview, so_far: str | None, last: bool) -> None:
        if self.head is None:
            head, _, rest = bytes(data).partition(END)
            version, *lines = head.decode().split("\r\n")
            if version != "WARC/1.1":
                raise ValueError(f"not a WARC record: {version!r}")
            self.head = dict(line.split(": ", 1) for line in lines)
            if not rest.startswith(HTTP_HEAD):
                raise ValueError("HTTP header block missing")
            data = memoryview(rest)[len(HTTP_HEAD):]
        if last:
            if bytes(data[-4:]) != END:
                raise ValueError("record end missing")
            data = data[:-4]
        self.digest.update(data)
        self.size += len(data)
        if so_far is not None and _base32(self.digest) != so_far:
            raise ValueError("chunk differs from its digest")

    def row(self) -> tuple:
        head = self.head or {}
        if int(head["Content-Length"]) != len(HTTP_HEAD) + self.size:
            raise ValueError("record length differs from its header")
        revisit = head["WARC-Type"] == "revisit"
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else _base32(self.digest)
        if not revisit and f"sha1:{digest}" != head["WARC-Payload-Digest"]:
            raise ValueError("payload differs from its digest")
        number = {k: int(head[k]) if k in head else None for k in ("X-Page-Id", "X-Refers-To-Page")}
        return (number["X-Page-Id"], head.get("WARC-Target-URI"), int(head["X-Payload-Length"]) if revisit else self.size, digest,
                head["WARC-Type"], number["X-Refers-To-Page"])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row per record, parsed from its bytes: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    table = spark.read.schema(CHUNK_SCHEMA).parquet(path)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RecordReader()
        for batch in batches:
            out = []
            for data, so_far, last in zip(batch.column("data"), batch.column("sha1_so_far").to_pylist(), batch.column("last").to_pylist(), strict=True):
                reader.feed(memoryview(data.as_buffer()), so_far, last)
                if last:
                    out.append(reader.row())
                    reader = RecordReader()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_RECORD)], schema=_RECORD)

    whole = table.where("last AND chunk_no = 0")  # records of one chunk stay where they are
    long = table.where("NOT (last AND chunk_no = 0)").repartition("record").sortWithinPartitions("record", "chunk_no")
    return whole.mapInArrow(parse, RECORD_SCHEMA).union(long.mapInArrow(parse, RECORD_SCHEMA))
