"""WARC archives by way of a chunked record table.

A page becomes rows (record, chunk number) of at most ``chunk`` payload bytes right behind the scan, in SQL; Python never sees a whole payload.
Each chunk is a WARC record of its own: the first is the response, further ones continue it as numbered segments. Digests are carried
from chunk to chunk, when payloads are compared, when they are written (the last segment has the digest of the payload) and when they
are read. A chunk that holds the line that starts records is written in base64, so that this line only ever starts a record
and archives can be split and read in parallel at it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm.common import fresh_path, ship, sliced, table, written

CHUNK = 32 << 10
#: Payloads of fewer bytes are never revisits.
LEAST = 1000
DATE = "2024-01-01T00:00:00Z"
_MARK = b"WARC/1.1\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Chunk rows that Python holds at once.
_ROWS = 64


def chunked(pages: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunked record table of ``pages(html binary, ...)``: its other columns with ``size`` (bytes of the payload), ``chunk``, ``last`` and
    ``data``. Chunks of a page follow one another in its partition. An empty payload has one empty chunk."""
    others = [c for c in pages.columns if c != "html"]
    rows = pages.withColumn("size", F.octet_length("html").cast("long")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / size).cast("int") - 1, F.lit(0)))))
    return rows.select(*others, "size", "chunk", ((F.col("chunk") + 1).cast("long") * size >= F.col("size")).alias("last"), F.substring("html", F.col("chunk") * size + 1, F.lit(size)).alias("data"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows (page_id, key, size, chunk, last, data), chunk after chunk, to (page_id, key, size, digest)."""
    sha = hashlib.sha1()
    for b in sliced(batches, _ROWS):
        rows: list[tuple] = []
        for page, key, size, chunk, last, data in zip(*b.columns, strict=True):
            if not chunk.as_py():
                sha = hashlib.sha1()
            sha.update(memoryview(data.as_buffer()))
            if last.as_py():
                rows.append((page.as_py(), key.as_py(), size.as_py(), sha.hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["page_id", "key", "size", "digest"])


def _line(name: str, value: object) -> bytes:
    return f"{name}: {value}\r\n".encode() if value is not None else b""


def _records(date: str):
    """Chunk rows (page_id, url, refers_to, digest, size, chunk, last, data) to WARC records without the leading mark line."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, row, sha = TaskContext.get().partitionId(), 0, hashlib.sha1()
        for b in sliced(batches, _ROWS):
            out: list[bytes] = []
            for page, url, refers, digest, size, chunk, last, data in zip(*b.columns, strict=True):
                page, url, refers, number, last = page.as_py(), url.as_py(), refers.as_py(), chunk.as_py() + 1, last.as_py()
                if number == 1:
                    row, sha = row + 1, hashlib.sha1()
                target = url.replace("\r", "%0D").replace("\n", "%0A").replace("WARC/", "WARC%2F") if url is not None else None
                own = f"urn:x-page:{page}:{task}-{row}"
                same = _line("X-Page-ID", page) + _line("WARC-Target-URI", target) + _line("WARC-Date", date)
                if refers is not None:
                    head = _line("WARC-Type", "revisit") + _line("WARC-Record-ID", f"<{own}>") + same + _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
                    out.append(head + _line("WARC-Refers-To", f"<urn:x-page:{refers}>") + _line("WARC-Payload-Digest", f"sha1:{digest.as_py()}") + _line("Content-Length", 0) + b"\r\n\r\n")
                    continue
                piece = data.as_py()
                sha.update(piece)
                coded = _MARK in piece + b"\r\n"
                block = (_HTTP if number == 1 else b"") + (base64.b64encode(piece) if coded else piece)
                if number == 1:
                    head = _line("WARC-Type", "response") + _line("WARC-Record-ID", f"<{own}>") + same + _line("Content-Type", "application/http;msgtype=response")
                    head += b"" if last else _line("WARC-Segment-Number", 1)
                else:
                    head = _line("WARC-Type", "continuation") + _line("WARC-Record-ID", f"<{own}:{number}>") + same + _line("WARC-Segment-Origin-ID", f"<{own}>") + _line("WARC-Segment-Number", number)
                    head += _line("WARC-Segment-Total-Length", len(_HTTP) + size.as_py()) if last else b""
                head += _line("X-Block-Encoding", "base64") if coded else b""
                head += _line("WARC-Payload-Digest", f"sha1:{sha.hexdigest()}") if last else b""
                out.append(head + _line("Content-Length", len(block)) + b"\r\n" + block + b"\r\n")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return records


def write_archives(pages: DataFrame, at: str, chunk: int = CHUNK, least: int = LEAST, date: str = DATE) -> None:
    """Write a WARC record for each row of ``pages(page_id, url, html)`` to files under ``at``.

    Of equal payloads of at least ``least`` bytes the one with the largest page_id is a response, others revisit it; repeated rows
    of that page are responses too, as is a page_id of null if there is no other. Null html is an empty payload; other columns are ignored.
    """
    ship(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    # the key tells rows of one page_id with different payloads apart; what payloads are equal is decided by their digests alone
    own = own.withColumn("key", F.xxhash64("html"))
    digests = written(chunked(own.where(F.octet_length("html") >= least).select("page_id", "key", "html"), chunk).mapInArrow(_digests, "page_id long, key long, size long, digest string"), "digests")
    best = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("refers_to")).where("n > 1").select("digest", "refers_to")
    # both sides are tables: a page body that a third of all pages share can be split
    best = written(best, "best")
    repeats = digests.join(best, "digest").where(~F.col("refers_to").eqNullSafe(F.col("page_id"))).select(F.col("page_id").alias("__page"), F.col("key").alias("__key"), "digest", "refers_to").distinct()
    # as a table its size is known before the join is planned: pages are only shuffled if revisits are many
    repeats = written(repeats, "repeats")
    rows = own.join(repeats, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("key") == F.col("__key")), "left")
    rows = chunked(rows.select("page_id", "url", "refers_to", "digest", F.when(F.col("refers_to").isNull(), F.col("html")).otherwise(F.lit(b"")).alias("html")), chunk)
    archive = rows.mapInArrow(_records(date), "record binary").select(F.concat(F.lit("WARC/1.1\r\n").cast("binary"), F.col("record")).cast("string").alias("value"))
    archive.write.option("lineSep", "\r\n").text(at)


#: A chunk as read: digest and size are those of the whole payload if there is one chunk only, else data holds the piece.
CHUNKS = "page_id long, record string, chunk int, last boolean, type string, refers_to long, said string, size long, digest string, data binary"


def _checked(sha, said: str, record: str) -> str:
    if sha.hexdigest() != said:
        raise ValueError(f"the payload of {record} does not have the digest that it was written with")
    return said


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "record", "chunk", "last", "type", "refers_to", "said", "size", "digest", "data"]
    types = [pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    for b in sliced(batches, _ROWS):
        rows: list[tuple] = []
        for x in b.column(0):
            raw = x.as_py()
            if not raw:
                continue
            end = raw.index(b"\r\n\r\n")
            head = dict(h.split(": ", 1) for h in raw[:end].decode().split("\r\n"))
            block = memoryview(raw)[end + 4 : end + 4 + int(head["Content-Length"])]
            if len(block) != int(head["Content-Length"]):
                raise ValueError(f"record {head['WARC-Record-ID']} is cut short")
            kind, number = head["WARC-Type"], int(head.get("WARC-Segment-Number", 0))
            page = int(head["X-Page-ID"]) if "X-Page-ID" in head else None
            record = head.get("WARC-Segment-Origin-ID", head["WARC-Record-ID"])
            said = head.get("WARC-Payload-Digest", "sha1:")[5:]
            if kind == "revisit":
                rows.append((page, record, 0, True, kind, int(head["WARC-Refers-To"].rstrip(">").rsplit(":", 1)[1]), said, None, None, None))
                continue
            if kind == "response":
                block = block[len(_HTTP) :]
            if head.get("X-Block-Encoding") == "base64":
                block = base64.b64decode(block)
            if number:
                rows.append((page, record, number, "WARC-Segment-Total-Length" in head, kind, None, said, len(block), None, bytes(block)))
            else:
                rows.append((page, record, 0, True, kind, None, said, len(block), _checked(hashlib.sha1(block), said, record), None))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read_chunks(spark: SparkSession, at: str) -> DataFrame:
    """The chunked record table of the archives under ``at``, read in parallel splits."""
    ship(spark)
    return spark.read.option("lineSep", "WARC/1.1\r\n").text(at).select(F.col("value").cast("binary").alias("value")).mapInArrow(_parse, CHUNKS)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows sorted by (record, chunk) to a row for each record; the digest is carried from chunk to chunk."""
    names = ["page_id", "type", "refers_to", "said", "size", "digest"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    sha, size, expected = hashlib.sha1(), 0, 1
    for b in sliced(batches, _ROWS):
        rows: list[tuple] = []
        for page, record, chunk, last, kind, refers, own, n, digest, data in zip(*b.columns, strict=True):
            number = chunk.as_py()
            if not number:
                rows.append((page.as_py(), kind.as_py(), refers.as_py(), own.as_py(), n.as_py(), digest.as_py()))
                continue
            if number == 1:
                sha, size, expected = hashlib.sha1(), 0, 1
            if number != expected:
                raise ValueError(f"segment {expected} of {record.as_py()} is missing")
            expected += 1
            sha.update(memoryview(data.as_buffer()))
            size += n.as_py()
            if last.as_py():
                rows.append((page.as_py(), "response", None, own.as_py(), size, _checked(sha, own.as_py(), record.as_py())))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read_records(spark: SparkSession, at: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all records; revisits take the payload's size and digest
    from the response they refer to."""
    rows = read_chunks(spark, at).repartition("record").sortWithinPartitions("record", "chunk").mapInArrow(_whole, "page_id long, type string, refers_to long, said string, size long, digest string")
    first = rows.where("type = 'response'").groupBy(F.col("page_id").alias("__page"), F.col("digest").alias("__said")).agg(F.max("size").alias("__size"))
    joined = rows.join(first, (F.col("refers_to") == F.col("__page")) & (F.col("said") == F.col("__said")), "left")
    return joined.select("page_id", F.coalesce("size", "__size").alias("payload_bytes"), F.coalesce("digest", "__said").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), at)
    return read_records(spark, at)


QUERIES = {"op3_warc": op3_warc}
ORACLES: dict[str, str] = {
    "op3_warc": """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS d FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY d) AS best FROM p
)
SELECT page_id, octet_length(b) AS payload_bytes, d AS payload_digest,
       CASE WHEN octet_length(b) >= 1000 AND best <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(b) >= 1000 AND best <> page_id THEN best END AS refers_to
FROM g"""
}
