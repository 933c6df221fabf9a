"""Operator 1: WARC archives as chunked record tables.

``write_archives`` writes one WARC/1.1 record for each row (gzip, one member a record) and ``read_archives`` gives the archives back as a
chunk table: one row for each record and chunk number, with the digest of the payload so far. On both sides a payload passes in
chunks of ``chunk_bytes``; neither Python side ever holds a whole record.

Equal payloads of ``min_revisit_bytes`` or more are stored once: the record of the smallest id is a response, others are revisits that
refer to it. The smallest id of each digest is a combinable aggregate; joining it back is a sort-merge join, whose skewed
partitions (a payload in a third of all rows) Spark splits. Each task writes files of its own under a fresh name and reports them
in its manifest rows, so what a failed or repeated attempt left behind is never read. A file begins with a warcinfo record. Record ids are UUIDs made of
page id and digest, so a revisit can name its response's; page ids themselves are in fields of their own.

Edge cases: a null payload is an empty one; a null id is written as null, comes after all others, and is a response only where no row
of its payload has an id; repeated rows of a smallest id are all responses, with one record id; ASCII white space in a URL is removed; an empty table writes nothing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import partitions, shared_dir

CHUNK_BYTES = 1 << 20
FILE_BYTES = 1 << 30
DATE = "2000-01-01T00:00:00Z"
#: White space that a URI cannot hold.
_SPACE = re.compile("[\t-\r ]+")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "page_id long, record_type string, refers_to long, uri string, chunk_no long, chunk_bytes long, payload_bytes long, payload_digest string, is_last boolean, chunk binary"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def chunk_records(rows: DataFrame, body: str, chunk_bytes: int) -> DataFrame:
    """One row for each chunk of column body (binary), in order, as columns chunk_no and chunk; other columns repeat."""
    last = F.greatest(F.floor((F.octet_length(body) - 1) / chunk_bytes), F.lit(0)).cast("int")
    rows = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    return rows.withColumn("chunk", F.substring(F.col(body), F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))).drop(body)


class _Archive:
    """Files of one task."""

    def __init__(self, uri: str):
        self.fs, self.dir = fs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.dir, recursive=True)
        self.out, self.path, self.size, self.records = None, "", 0, 0

    def begin(self, head: bytes) -> None:
        if self.out is None:
            self.path, self.size, self.records = f"{self.dir}/{uuid.uuid4().hex}.warc.gz", 0, 0
            self.out = self.fs.open_output_stream(self.path, compression=None)
            self.member = zlib.compressobj(1, zlib.DEFLATED, 31)
            self.put(_info(self.path.rpartition("/")[2]))
            self.end()
            self.records = 0
        self.member = zlib.compressobj(1, zlib.DEFLATED, 31)
        self.put(head)

    def put(self, data: bytes) -> None:
        data = self.member.compress(data)
        self.size += len(data)
        self.out.write(data)

    def end(self) -> None:
        self.put(b"\r\n\r\n")
        data = self.member.flush()
        self.size += len(data)
        self.records += 1
        self.out.write(data)

    def close(self) -> list[tuple[str, int, int]]:
        if self.out is None:
            return []
        self.out.close()
        self.out = None
        return [(self.path, self.size, self.records)]


def record_id(page: int | None, digest: str) -> str:
    """The same for equal rows, so that a revisit knows its response's; a row without an id has one that nothing refers to."""
    return f"<{(uuid.uuid4() if page is None else uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')).urn}>"


def _head(page: int | None, uri: str, digest: str, length: int, first: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(page, digest)}", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {_SPACE.sub('', uri)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Page-ID: {'null' if page is None else page}"]
    if first is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first, digest)}", f"Refers-To-Page-ID: {first}"]
    lines.append(f"Content-Length: {len(http) + (length if first is None else 0)}")
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


def _info(name: str) -> bytes:
    """The record that begins a file."""
    body = "software: codeloom\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <{uuid.uuid4().urn}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + body).encode()


def write_archives(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """pages (page_id, url, html) -> manifest: path, file_bytes, records. Files are written when the result is read."""
    folder = folder or shared_dir(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("body"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("body"))).withColumn("n", F.octet_length("body").cast("long"))
    firsts = rows.where(F.col("n") >= min_revisit_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"))
    rows = rows.join(firsts, "sha1", "left")
    # a null id is a revisit where some id is known
    rows = rows.withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    rows = rows.withColumn("body", F.when(F.col("first").isNull(), F.col("body")).otherwise(F.lit(b"")))
    rows = chunk_records(rows.select("page_id", "url", "sha1", "n", "first", "body"), "body", chunk_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Archive(folder)
        done: list[tuple[str, int, int]] = []
        running = hashlib.sha1()
        length = 0
        for batch in batches:
            for page, url, sha1, n, first, number, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number == 0:
                    running, length = hashlib.sha1(), 0
                    files.begin(_head(page, url, base32(sha1), n, first))
                if first is None:
                    running.update(chunk)
                    length += len(chunk)
                    files.put(chunk)
                if first is not None or length == n:
                    if first is None and running.digest() != sha1:
                        raise ValueError(f"page {page}: the payload does not have its digest")
                    files.end()
                    if files.size >= file_bytes:
                        done += files.close()
        done += files.close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "file_bytes", "records"])

    return rows.select("page_id", "url", "sha1", "n", "first", "chunk_no", "chunk").mapInArrow(run, "path string, file_bytes long, records long")


class _Members:
    """Decompressed bytes of a file of gzip members, read as they are needed."""

    def __init__(self, stream, block: int = 1 << 18):
        self.stream, self.block, self.raw, self.plain = stream, block, b"", bytearray()
        self.member = zlib.decompressobj(31)

    def more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.stream.read(self.block)
                if not self.raw:
                    return False
            data = self.member.decompress(self.raw, self.block)
            self.raw = self.member.unconsumed_tail
            if self.member.eof:
                self.raw = self.member.unused_data
                self.member = zlib.decompressobj(31)
            if data:
                self.plain += data
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.plain.find(mark)) < 0:
            if not self.more():
                if self.plain:
                    raise ValueError("the archive ends in a header")
                return None
        out = bytes(self.plain[: at + len(mark)])
        del self.plain[: at + len(mark)]
        return out

    def take(self, most: int) -> bytes:
        if not self.plain and not self.more():
            raise ValueError("the archive ends in a record")
        out = bytes(self.plain[:most])
        del self.plain[:most]
        return out


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:]) if k}


def _page(value: str | None) -> int | None:
    return None if value in (None, "null") else int(value)


def records(stream, chunk_bytes: int, with_payload: bool) -> Iterator[tuple]:
    """Rows of the chunk table."""
    source = _Members(stream)
    while (head := source.until(b"\r\n\r\n")) is not None:
        warc = _fields(head)
        if warc["warc-type"] not in ("response", "revisit"):  # what begins a file, or a record of another writer
            left = int(warc["content-length"])
            while left:
                left -= len(source.take(left))
            source.until(b"\r\n\r\n")
            continue
        http = source.until(b"\r\n\r\n")
        left = int(warc["content-length"]) - len(http)
        digest = warc["warc-payload-digest"].removeprefix("sha1:")
        own = (_page(warc["page-id"]), warc["warc-type"], _page(warc.get("refers-to-page-id")), warc["warc-target-uri"])
        if own[1] == "revisit":
            yield *own, 0, 0, int(_fields(http)["content-length"]), digest, True, None
        else:
            running, total, number = hashlib.sha1(), 0, 0
            while True:
                parts, size = [], 0
                while size < chunk_bytes and left:
                    x = source.take(min(left, chunk_bytes - size))
                    running.update(x)
                    size, left = size + len(x), left - len(x)
                    if with_payload:
                        parts.append(x)
                total += size
                if not left and base32(running.digest()) != digest:
                    raise ValueError(f"{warc['warc-record-id']}: the payload does not have its digest")
                yield *own, number, size, total, base32(running.copy().digest()), not left, b"".join(parts) if with_payload else None
                number += 1
                if not left:
                    break
        if source.until(b"\r\n\r\n") != b"\r\n\r\n":
            raise ValueError("a record is longer than it says")


def read_archives(manifest: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, with_payload: bool = True) -> DataFrame:
    """manifest (path) -> chunk table (CHUNKS). payload_bytes and payload_digest are of the payload up to and with the chunk; a
    revisit has one row, with the figures of the payload it refers to."""
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("uri", pa.string()), ("chunk_no", pa.int64()), ("chunk_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("is_last", pa.bool_()), ("chunk", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(folder)[0]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(path, compression=None) as stream:
                    rows, size = [], 0
                    for row in records(stream, chunk_bytes, with_payload):
                        rows.append(row)
                        size += 100 + (row[5] if with_payload else 0)
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return manifest.select("path").repartition(partitions(manifest.sparkSession), "path").mapInArrow(run, CHUNKS)


def archive_pages(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write, read back -> page_id, payload_bytes, payload_digest, record_type, refers_to, uri, n_chunks."""
    folder = shared_dir(pages.sparkSession, "warc")
    chunks = read_archives(write_archives(pages, folder, min_revisit_bytes), folder, with_payload=False)
    return chunks.where("is_last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", (F.col("chunk_no") + 1).alias("n_chunks"))
