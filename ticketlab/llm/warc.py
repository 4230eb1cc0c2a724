"""WARC archives as a chunked record table.

Writing. A record's payload is cut into chunks of at most ``chunk_bytes``; each
chunk is a row (record id, chunk number) and becomes one WARC segment: the
first a ``response`` record, the others ``continuation`` records that name
their origin (WARC 1.1, segmentation). A row carries the SHA-1 of the payload
up to its end, so a reader can stop at the first damaged chunk. Rows are cut
from the column's buffer without copying a payload, and written by Spark's text
writer, which commits whole tasks: a lost executor's files never appear.

Reading. Archives are split at ``WARC/1.1`` lines by Spark's text reader, from
any store it knows and in bounded memory: the writer cuts a payload inside
every ``WARC/1.1`` it holds, so the mark never stands within a chunk. Lengths are
checked against Content-Length. Records of one chunk are digested where they
are; the chunks of longer ones are brought together by record id, sorted, and
streamed through the digest, one chunk in memory at a time.

Copies. Of records with equal payloads (SHA-1 and length) of at least
``min_bytes`` the smallest page_id is the response; others are ``revisit``
records without a block.

Edge cases: a null html is an empty payload; a null url gives no target URI; a
null page_id is never the one referred to unless a group has no other id, and then
all of the group are responses. Rows that repeat a page_id and its payload are
as many equal records, all responses if they hold the group's smallest id.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, scratch_path

MARK = "WARC/1.1"
CRLF = "\r\n"
CHUNK_BYTES = 64 << 10
BATCH_BYTES = 4 << 20
#: Of every record; archives hold no clock, so that equal input gives equal files.
DATE = "2000-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def cuts(payload: memoryview, chunk_bytes: int) -> list[int]:
    """Ends of the chunks of a UTF-8 payload: at most ``chunk_bytes`` apart, between
    characters, and one inside every mark. An empty payload has one chunk."""
    n = len(payload)
    inside = [m.start() + 4 for m in re.finditer(MARK.encode(), payload)] + [n]
    ends, at = [], 0
    for stop in inside:
        while at < stop:
            end = min(at + chunk_bytes, stop)
            while end < n and end > at + 1 and payload[end] & 0xC0 == 0x80:
                end -= 1
            ends.append(end)
            at = end
    return ends or [0]


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [MARK, *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block)}", "", ""]
    return CRLF.join(lines).encode() + block


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}>"


def _segments(page_id, url, payload: memoryview, sha1: str, first_id, chunk_bytes: int) -> Iterator[bytes]:
    digest = b32(bytes.fromhex(sha1))
    rid = record_id(page_id, digest)
    target = [] if url is None else [("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~").replace(MARK, "WARC%2F1.1"))]
    common = [("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if first_id is not None and first_id != page_id:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", rid), *target, *common,
                       ("WARC-Refers-To", record_id(first_id, digest)),
                       ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], b"")
        return
    ends = cuts(payload, chunk_bytes)
    running, at = hashlib.sha1(), 0
    for number, end in enumerate(ends, 1):
        chunk = payload[at:end]
        running.update(chunk)
        head = [("WARC-Type", "response" if number == 1 else "continuation"),
                ("WARC-Record-ID", rid if number == 1 else f"{rid[:-1]}:{number}>"), *target, *common]
        if len(ends) > 1:
            head += [("WARC-Segment-Number", str(number)), ("X-Digest-So-Far", f"sha1:{b32(running.copy().digest())}")]
            if number > 1:
                head.append(("WARC-Segment-Origin-ID", rid))
            if number == len(ends):
                head.append(("WARC-Segment-Total-Length", str(len(payload))))
        if number == 1:
            head.append(("Content-Type", "application/http; msgtype=response"))
        yield _record(head, (HTTP.format(len(payload)).encode() if number == 1 else b"") + bytes(chunk))
        at = end


def write_archive(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, min_bytes: int = 0) -> None:
    """Write columns page_id (integer), url, html of ``pages`` as gzip-compressed
    WARC files under ``path``, a file for each task."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1(F.col("payload").cast("binary"))).withColumn("bytes", F.octet_length("payload"))
    groups = (rows.select("page_id", "sha1", "bytes").where(F.col("bytes") >= min_bytes).groupBy("sha1", "bytes")
              .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha1", "bytes", "first_id"))
    rows = rows.join(materialize(groups, "warc-copies"), ["sha1", "bytes"], "left").select("page_id", "url", "payload", "sha1", "first_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for b in batches:
            payloads = b.column(2).cast(pa.large_binary())
            offsets, data = np.frombuffer(payloads.buffers()[1], np.int64)[payloads.offset:], memoryview(payloads.buffers()[2] or b"")
            for i, (page_id, url, sha1, first_id) in enumerate(zip(*[b.column(c).to_pylist() for c in (0, 1, 3, 4)])):
                for segment in _segments(page_id, url, data[offsets[i]: offsets[i + 1]], sha1, first_id, chunk_bytes):
                    out.append(segment)
                    size += len(segment)
                    if size >= BATCH_BYTES:
                        yield pa.record_batch([pa.array(out, pa.binary()).cast(pa.string())], ["value"])
                        out, size = [], 0
        if out:
            yield pa.record_batch([pa.array(out, pa.binary()).cast(pa.string())], ["value"])

    rows.mapInArrow(cut, "value string").write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)
    _drop_empty_first(pages.sparkSession, path)


EMPTY_GZIP = 20   # bytes of a gzip file of nothing


def _drop_empty_first(spark: SparkSession, path: str) -> None:
    """Spark writes a file for the first task though it has no rows; it goes where others stand beside it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    first = fs.globStatus(hadoop(f"{path}/part-00000-*"))
    if len(first) == 1 and first[0].getLen() <= EMPTY_GZIP and len(fs.globStatus(hadoop(f"{path}/part-*"))) > 1:
        fs.delete(first[0].getPath(), False)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of archives: record_id (the origin's for continuations),
    page_id, type, url, chunk, last, stated_digest, so_far, refers_to, payload
    (binary; without the HTTP header)."""
    raw = spark.read.option("lineSep", MARK + CRLF).text(path).where("value != ''")
    raw = raw.withColumn("head", F.substring_index("value", CRLF * 2, 1))
    # after the header's blank line, before the two line ends of the record
    raw = raw.withColumn("block", F.expr("substring(value, length(head) + 5, length(value) - length(head) - 8)"))
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?:^|\r\n){name}: ([^\r]*)", 1), F.lit(""))
    rows = raw.select(
        field("WARC-Type").alias("type"), F.coalesce(field("WARC-Segment-Origin-ID"), field("WARC-Record-ID")).alias("record_id"),
        field("WARC-Target-URI").alias("url"), F.coalesce(field("WARC-Segment-Number").cast("int"), F.lit(1)).alias("chunk"),
        (field("WARC-Segment-Number").isNull() | field("WARC-Segment-Total-Length").isNotNull()).alias("last"),
        field("WARC-Payload-Digest").alias("stated_digest"), field("X-Digest-So-Far").alias("so_far"),
        field("WARC-Refers-To").alias("refers_to"), field("Content-Length").cast("long").alias("length"), "block")
    fault = F.concat(F.lit("WARC record "), "record_id", F.lit(" does not have its Content-Length"))
    block = F.when(F.octet_length("block") == F.col("length"), F.col("block")).otherwise(F.raise_error(fault))
    rows = rows.withColumn("block", block)
    payload = F.when(F.col("type") == "response", F.expr("substring(block, locate('\\r\\n\\r\\n', block) + 4)")).otherwise(F.col("block"))
    return rows.select("record_id", page_of("record_id").alias("page_id"), "type", "url", "chunk", "last", "stated_digest",
                       "so_far", "refers_to", payload.cast("binary").alias("payload"))


def page_of(rid: str):
    return F.nullif(F.regexp_extract(rid, "<urn:x-page:(-?[0-9]*):", 1), F.lit("")).cast("long")


def _stream_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From chunks sorted by record and number: a row for each record, with its
    digest, length, and how often it stands in the archives."""
    schema = pa.schema([("record_id", pa.string()), ("sha1", pa.binary()), ("bytes", pa.int64()), ("copies", pa.int64())])
    record, number, copies, size, running, last_seen = None, 0, 0, 0, hashlib.sha1(), False
    done: list[tuple] = []

    def close():
        if record is not None:
            if not last_seen:
                raise ValueError(f"WARC record {record} lacks its last segment")
            done.append((record, running.digest(), size, copies))

    for b in batches:
        ids, numbers, lasts, sofar = (b.column(c).to_pylist() for c in (0, 1, 2, 3))
        for i, rid in enumerate(ids):
            if rid != record:
                close()
                record, number, copies, size, running, last_seen = rid, 0, 0, 0, hashlib.sha1(), False
            if numbers[i] == number:   # the same chunk of an equal record
                copies += number == 1
                continue
            if numbers[i] != number + 1:
                raise ValueError(f"WARC record {rid} lacks segment {number + 1}")
            number += 1
            copies += number == 1
            chunk = b.column(4)[i].as_buffer()
            running.update(chunk)
            size += len(chunk)
            last_seen = last_seen or lasts[i]
            if sofar[i] is not None and sofar[i] != f"sha1:{b32(running.copy().digest())}":
                raise ValueError(f"WARC record {rid}: segment {number} is damaged")
        if len(done) >= 1000:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in done], schema)
            done = []
    close()
    if done:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in done], schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives: page_id, url is left in the chunk
    table; payload_bytes, payload_digest (recomputed from the payload; a
    revisit's are those of the response), record_type, refers_to (page_id)."""
    chunks = read_chunks(spark, path)
    whole = chunks.where("type = 'response' and chunk = 1 and last").select(
        "record_id", F.unhex(F.sha1("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"), F.lit(1).cast("long").alias("copies"))
    parts = chunks.where("type in ('response', 'continuation') and not (chunk = 1 and last)")
    parts = (parts.select("record_id", "chunk", "last", "so_far", "payload").repartition("record_id")
             .sortWithinPartitions("record_id", "chunk"))
    long = parts.mapInArrow(_stream_digest, "record_id string, sha1 binary, bytes long, copies long")

    @F.arrow_udf("string")
    def to_b32(d: pa.Array) -> pa.Array:
        return pa.array([None if x is None else b32(x) for x in d.to_pylist()], pa.string())

    responses = materialize(whole.unionByName(long).withColumn("digest", to_b32("sha1")).drop("sha1"), "warc-responses")
    named = responses.select(page_of("record_id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
                             F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"),
                             F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")
    first = responses.select(F.col("record_id").alias("refers_to"), "bytes", "digest").dropDuplicates(["refers_to"])
    revisits = (chunks.where("type = 'revisit'").select("record_id", "refers_to").join(first, "refers_to", "left")
                .select(page_of("record_id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
                        F.lit("revisit").alias("record_type"), page_of("refers_to").alias("refers_to")))
    return named.unionByName(revisits)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archive(read(spark, sf_dir, "pages"), path)
    return read_records(spark, path)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, body, sha1(body) AS hex FROM p),
g AS (SELECT body, min(page_id) AS first_id FROM d GROUP BY body),
bits AS (SELECT d.*, first_id, array_to_string(list_transform(string_split(hex, ''), lambda c: lpad(bin(('0x' || c)::INT), 4, '0')), '') AS b
         FROM d JOIN g USING (body))
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(0, 5), lambda j: CASE WHEN substr(b, 5 * i + j + 1, 1) = '1' THEN (1 << (4 - j)) ELSE 0 END))::INT, 1)), '') AS payload_digest,
  CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id IS NULL OR page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM bits
"""
