"""WARC archives as a chunked record table.

Payloads travel as (record, chunk number, bytes) rows of at most CHUNK bytes, each with the SHA-1 of its record up to and
including it, so neither the writer nor the reader holds a record. Writing: payload digests are computed where the rows are
scanned; equal payloads are found by joining digests that occur more than once. Up to FEW of those are broadcast, so payloads
stay where they are read; more of them meet the pages in a shuffle, which AQE splits. Tasks then stream gzip members, one per
record, into files of the shared folder. A file's name has the task attempt in it and
only files of successful attempts are in the manifest table that the write returns, so a lost executor leaves at most a file
that is never read. Reading streams each file of the manifest back, one task per file.

A record's id is a UUID made of page_id, payload digest, task and place in the task's file, so no two records of an archive
share one, whatever page_id repeats or is null. page_id, and that of the response that a revisit repeats, have headers of their own.

Defined results: a null payload is empty; a null page_id is written without a number and read back as null; rows that repeat
the page_id and the payload of a response are responses too (the same capture again); an empty table gives an empty archive.
Line breaks in an url become %0D and %0A. Other columns are ignored.
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

from curato.llm import shared

CHUNK = 1 << 20
#: Digests of 40 characters that are broadcast at most, some 20 MB.
FEW = 200_000
#: All records carry this date, so that reruns write the same bytes.
DATE = "2000-01-01T00:00:00Z"
MANIFEST = "path string, records long, bytes long"
CHUNKS = "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, chunk_no int, data binary, bytes_so_far long, digest_so_far string, is_last boolean, intact boolean"


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunk_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of all records in DataFrame functions; a record without bytes, or a revisit, has one empty chunk.

    Of records with equal payloads of at least min_bytes, the one with the largest page_id is the response.
    """
    raw = F.coalesce(F.encode(pages[payload], "UTF-8") if dict(pages.dtypes)[payload] != "binary" else pages[payload], F.lit(b""))
    link = pages[url].cast("string") if url in pages.columns else F.lit(None).cast("string")
    rows = pages.select(pages[page_id].cast("long").alias("page_id"), link.alias("url"), raw.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    again = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = shared.keep(again, "digests")
    again = F.broadcast(again) if again.count() <= FEW else again
    told = rows.join(again, "sha1", "left").withColumn("refers_to", F.when(F.col("first") > F.coalesce("page_id", F.lit(-(2**63))), F.col("first")))
    parts = F.when(F.col("refers_to").isNull(), F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / chunk))).otherwise(F.lit(1)).cast("int")
    return (
        told.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("page_id", "url", "sha1", "payload_bytes", "refers_to", "chunk_no", (F.col("chunk_no") == parts - 1).alias("is_last"), F.when(F.col("refers_to").isNull(), F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk))).otherwise(F.lit(b"")).alias("data"))
    )


def head(page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None, place: str) -> bytes:
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}:{place}')}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {size if refers_to is None else 0}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"X-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def open_store(uri: str):
    """pyarrow's file system of an URI or local path, and the path inside it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(chunks: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Writes chunk rows, of which those of a record follow one another, as gzip members; returns the manifest.

    A payload whose bytes don't have the digest told fails the task.
    """
    store, base = open_store(folder)
    store.create_dir(base, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, store = TaskContext.get(), open_store(folder)[0]
        path = f"{base}/part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        out = None
        records = size = 0
        for batch in batches:
            out = out or store.open_output_stream(path, compression=None)
            for page, url, sha1, n, refers, no, last, data in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "sha1", "payload_bytes", "refers_to", "chunk_no", "is_last", "data")), strict=True):
                if no == 0:
                    gz, running = zlib.compressobj(level, wbits=31), hashlib.sha1()
                    out.write(gz.compress(head(page, url, b32(bytes.fromhex(sha1)), n, refers, f"{task.partitionId()}:{records}")))
                out.write(gz.compress(data))
                running.update(data)
                if last:
                    if refers is None and running.hexdigest() != sha1:
                        raise ValueError(f"record {page}: chunks don't make up the payload")
                    out.write(gz.compress(b"\r\n\r\n") + gz.flush())
                    records, size = records + 1, size + n
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]}, pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return shared.keep(chunks.mapInArrow(write, MANIFEST), "warc-manifest")


class Inflated:
    """Bytes of a file of gzip members, some at a time."""

    def __init__(self, stream, step: int):
        self.stream, self.step, self.gz, self.held = stream, step, zlib.decompressobj(wbits=31), bytearray()

    def more(self) -> bool:
        raw = self.gz.unused_data if self.gz.eof else self.gz.unconsumed_tail
        raw = raw or self.stream.read(self.step)
        if not raw:
            return False
        if self.gz.eof:
            self.gz = zlib.decompressobj(wbits=31)
        self.held += self.gz.decompress(raw, self.step)
        return True

    def line(self) -> bytes:
        """Up to and without CR LF; nothing at the end of the file."""
        while (at := self.held.find(b"\r\n")) < 0:
            if not self.more():
                return b""
        out = bytes(self.held[:at])
        del self.held[: at + 2]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("a record is cut short")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def ended(self) -> bool:
        while not self.held:
            if not self.more():
                return True
        return False


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of all records in the manifest's files, with running digests; intact is told at a record's last chunk."""

    def records(path: str) -> Iterator[tuple]:
        with open_store(folder)[0].open_input_stream(path, compression=None) as stream:
            source = Inflated(stream, min(chunk, 1 << 18))
            while not source.ended():
                if source.line() != b"WARC/1.1":
                    raise ValueError(f"{path}: no record begins here")
                said = {}
                while line := source.line():
                    name, _, value = line.decode().partition(": ")
                    said[name] = value
                number = lambda name: int(said[name]) if name in said else None
                left, no, running, seen = int(said["Content-Length"]), 0, hashlib.sha1(), 0
                digest, size = said["WARC-Payload-Digest"].removeprefix("sha1:"), int(said["X-Payload-Length"])
                while True:
                    data = source.take(min(chunk, left))
                    left, seen = left - len(data), seen + len(data)
                    running.update(data)
                    so_far = b32(running.digest())
                    intact = (said["WARC-Type"] == "revisit" or so_far == digest and seen == size) if not left else None
                    yield said["WARC-Record-ID"], number("X-Page-ID"), said.get("WARC-Target-URI"), said["WARC-Type"], number("X-Refers-To-Page-ID"), size, digest, no, data, seen, so_far, not left, intact
                    no += 1
                    if not left:
                        break
                if source.take(4) != b"\r\n\r\n":
                    raise ValueError(f"{path}: a record does not end where it should")

    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
    schema = pa.schema([(x.split()[0], t) for x, t in zip(CHUNKS.split(", "), types, strict=True)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                held, size = [], 0
                for row in records(path):
                    held.append(row)
                    size += len(row[8]) + 200
                    if size > 4 * chunk:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types, strict=True)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types, strict=True)], schema=schema)

    files = manifest.select("path")
    return files.repartition(max(1, files.count()), "path").mapInArrow(read, CHUNKS)


def archive_pages(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes all pages to archives and returns their chunk table, read back."""
    spark = pages.sparkSession
    folder = folder or shared.fresh(spark, "warc")
    return read_archives(spark, write_archives(chunk_records(pages, min_bytes=min_bytes), folder), folder)


def page_digests(pages: DataFrame) -> DataFrame:
    """One row per page from the last chunk of its record."""
    return archive_pages(pages).where("is_last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


#: base32 of the 20 digest bytes: eight groups of 20 bits, four letters each.
ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, h, max(page_id) OVER (PARTITION BY h) AS first,
    list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(h, 1 + 5 * (j // 4), 5))::BIGINT // [32768, 1024, 32, 1][1 + j % 4] % 32)::INT, 1) for j in range(32)], 'string_agg', '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first > page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first > page_id THEN first END AS refers_to, TRUE AS intact FROM d"""
