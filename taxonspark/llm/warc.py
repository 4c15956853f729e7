"""WARC archives: write captures as request, response or revisit, and metadata records; read them back
and assemble one nested row per capture through the records' concurrent-to identifiers.

Archives are written by Spark's text writer (a record is one value, the blank lines between
records are the separator), so any shared file system will do and a retried task replaces its
file. ``pages_per_file`` bounds a file, as a file is read whole by one task.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, small_broadcast, staged, workers

_VALUE = pa.schema([("value", pa.binary())])
_NS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, rid: str, date: str, block: bytes, ctype: str, more: list[tuple[str, str | None]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{rid}>"), ("WARC-Date", date), *more,
            ("Content-Type", ctype), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None).encode() + b"\r\n" + block


def _clean(url: str | None) -> str | None:
    return None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")


def _records(date: str):
    """mapInArrow (page_id, url, payload, refers_to) -> WARC records, a warcinfo first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        out = [_record("warcinfo", str(uuid.uuid5(_NS, f"info/{part}")), date, b"format: WARC File Format 1.1\r\n",
                       "application/warc-fields", [])]
        size = 0
        for b in batches:
            for page_id, url, payload, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                row += 1
                digest = digest32(payload)
                req, res, meta = (str(uuid.uuid5(_NS, f"{k}/{part}/{row}/{page_id}/{digest}")) for k in ("req", "res", "meta"))
                uri, same = ("WARC-Target-URI", _clean(url)), ("WARC-Concurrent-To", f"<urn:uuid:{res}>")
                path = "/" + (_clean(url) or "").partition("://")[2].partition("/")[2]
                out.append(_record("request", req, date, f"GET {path} HTTP/1.1\r\n\r\n".encode(), "application/http; msgtype=request", [uri, same]))
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                more = [uri, ("WARC-Payload-Digest", f"sha1:{digest}")]
                if refers is None:
                    out.append(_record("response", res, date, head + payload, "application/http; msgtype=response", more))
                else:
                    more.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
                    out.append(_record("revisit", res, date, head, "application/http; msgtype=response", more))
                fields = "".join(f"{k}: {v}\r\n" for k, v in (("page-id", page_id), ("refers-to-page", refers)) if v is not None)
                out.append(_record("metadata", meta, date, fields.encode(), "application/warc-fields", [uri, same]))
                size += len(payload)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], schema=_VALUE)
                    out, size = [], 0
        if row and out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], schema=_VALUE)
    return run


def write_archives(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", payload: str = "html",
                   date: str = "1970-01-01T00:00:00Z", min_revisit_bytes: int = 0, pages_per_file: int = 1000,
                   compression: str = "none") -> None:
    """Write ``pages`` as WARC files in the folder ``path``.

    Of captures with equal payloads (compared by SHA-256 and length) of at least ``min_revisit_bytes``
    the one of the largest page_id is a response, the others are revisits of it, without payload. A null
    payload is empty; rows that repeat the largest page_id are all responses; a null page_id is smaller
    than all others; line ends in a URL are percent-encoded, a null URL is left out; no pages
    give archives without captures; other columns are not read."""
    workers(pages)
    rows = pages.select(F.col(page_id).cast("long").alias("p"), F.col(url).cast("string").alias("u"),
                        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("b"))
    rows = rows.withColumn("k", F.when(F.octet_length("b") >= min_revisit_bytes, F.sha2("b", 256)))
    same = rows.where("k is not null").groupBy("k", F.octet_length("b").alias("z")).agg(F.max("p").alias("last"), F.count("*").alias("c"))
    same = staged(same.where("c > 1 and last is not null").select("k", "z", "last"), "payloads")
    refers = F.when(F.col("p").isNull() | (F.col("p") < F.col("last")), F.col("last"))
    marked = rows.withColumn("z", F.octet_length("b")).join(small_broadcast(same, 200_000), ["k", "z"], "left").select("p", "u", "b", refers.alias("r"))
    (marked.mapInArrow(_records(date), "value binary").select(F.col("value").cast("string"))
     .write.option("lineSep", "\r\n\r\n").option("compression", compression)
     .option("maxRecordsPerFile", 3 * pages_per_file).text(path))


RECORD = ("record_id string, kind string, concurrent_to string, target_uri string, date string, payload_bytes long, "
          "payload_digest string, stated_digest string, fields map<string,string>, payload binary, error string")


def _fields(head: bytes) -> list[tuple[str, str]]:
    out = []
    for line in head.split(b"\r\n"):
        k, colon, v = line.decode("utf-8", "replace").partition(":")
        if colon:
            out.append((k.strip().lower(), v.strip()))
    return out


def _unpacked(data: bytes) -> tuple[bytes, str | None]:
    """The content of an archive, plain or of gzip members, as far as it can be read, and what ended it early."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        for lo in range(0, len(data), 1 << 16):
            try:
                out.append(member.decompress(data[lo:lo + (1 << 16)]))
            except zlib.error as e:
                return b"".join(out), f"damaged gzip: {e}"
            if member.eof:
                data = member.unused_data + data[lo + (1 << 16):]
                break
        if not member.eof:
            return b"".join(out), "gzip ends early"
    return (b"".join(out), "bytes after gzip" if data.strip(b"\0") else None) if out else (data, None)


def _broken(why: str, record_id: str | None = None) -> tuple:
    return record_id, None, None, None, None, None, None, None, [], None, why


def parse(data: bytes, with_payload: bool) -> Iterator[tuple]:
    """The records of one archive (plain or gzip); what can't be read ends it with an error row."""
    data, ended = _unpacked(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        head = dict(reversed(_fields(data[at:end]))) if end >= 0 else {}
        length = head.get("content-length", "")
        if not (length.isascii() and length.isdigit()) or end + 4 + int(length) > len(data):
            yield _broken(f"broken record at byte {at}" + (f" ({ended})" if ended else ""), head.get("warc-record-id"))
            return
        block = memoryview(data)[end + 4:end + 4 + int(length)]
        kind = head.get("warc-type")
        size, found, payload, fields = None, None, None, []
        stated = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if kind in ("response", "revisit"):
            top = data.find(b"\r\n\r\n", end + 4, end + 4 + int(length))
            top = end + 4 + int(length) if top < 0 else top + 4
            fields = list(dict(_fields(data[end + 4:top])).items())
            if kind == "response":
                body = bytes(block[top - end - 4:])
                size, found, payload = len(body), digest32(body), body if with_payload else None
            else:  # a revisit states what it left out
                left = dict(fields).get("content-length") or "0"
                size, found = int(left) if left.isascii() and left.isdigit() and len(left) < 19 else None, stated
        elif head.get("content-type") == "application/warc-fields":
            fields = list(dict(_fields(bytes(block))).items())
        yield (head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), head.get("warc-target-uri"), head.get("warc-date"),
               size, found, stated, fields, payload, None)
        at = end + 4 + int(length)
    if ended:
        yield _broken(ended)


def read_records(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives in ``path``; a damaged file ends with a row that has ``error``."""
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(),
             pa.map_(pa.string(), pa.string()), pa.binary(), pa.string()]
    names = [c.split(" ")[0] for c in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows, size = [], 0
                for r in parse(data.as_py(), with_payload):
                    rows.append(r)
                    size += len(r[-2] or b"") + 500
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").load(path).select("content")
    workers(files)
    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response (or revisit; null if the archives have none),
    requests, metadata. Records belong to the one that their concurrent-to identifier names, or
    that this one's own names; warcinfo and damaged records belong to no capture."""
    r = records.where("record_id is not null and error is null and kind in ('request', 'response', 'revisit', 'metadata')")
    hop = r.where("concurrent_to is not null and kind <> 'metadata'").groupBy(F.col("record_id").alias("_id")).agg(
        F.min("concurrent_to").alias("_to"))
    # a record that names no other looks up itself in vain, so that such records aren't dealt to one task
    r = r.join(hop, F.coalesce("concurrent_to", "record_id") == F.col("_id"), "left").withColumn("_to", F.when(
        F.col("concurrent_to").isNotNull(), F.col("_to"))).withColumn("capture_id", F.coalesce("_to", "concurrent_to", "record_id"))
    row = F.struct(*(c for c in records.columns if c not in ("concurrent_to", "error")))
    return r.groupBy("capture_id").agg(
        F.first(F.when(F.col("kind").isin("response", "revisit"), row), ignorenulls=True).alias("response"),
        F.collect_list(F.when(F.col("kind") == "request", row)).alias("requests"),
        F.collect_list(F.when(F.col("kind") == "metadata", row)).alias("metadata"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write_archives(pages, path)
    captures = assemble(read_records(spark, path, with_payload=False))
    meta = F.col("metadata")[0]["fields"]
    return captures.select(
        meta["page-id"].cast("long").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.kind").alias("record_type"),
        meta["refers-to-page"].cast("long").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), m AS (SELECT h, max(page_id) AS last FROM p GROUP BY h),
x AS (SELECT page_id, strlen(p.h) AS n, last, [CAST('0x' || substr(sha1(p.h), 5 * j + 1, 5) AS INTEGER) for j in range(8)] AS v FROM p JOIN m USING (h))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(flatten([[(a // 32768) % 32, (a // 1024) % 32, (a // 32) % 32, a % 32] for a in v]),
                       lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(i AS INTEGER) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM x
"""
