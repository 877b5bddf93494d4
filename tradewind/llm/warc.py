"""WARC archives as a chunked record table.

A payload travels as rows of (record, chunk number, at most CHUNK bytes). The writer takes
such rows in order and streams them into gzip members; the reader streams archives back
into such rows, each with the length and the digest of the payload so far, so that no task
of Python ever holds a whole record. Every task writes files of its own, and only those that
its committed output names are read: a lost executor's files are left aside.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm.common import dropped_at_exit, shared_dir, staged

#: Payload bytes of one chunk row.
CHUNK = 1 << 20
#: Compressed bytes at which a task begins another archive.
ARCHIVE = 256 << 20
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNK_SCHEMA = (
    "record_id string, chunk int, record_type string, page_id long, refers_to long, target_uri string, "
    "payload binary, payload_bytes long, payload_digest string, last boolean, intact boolean"
)


def records(pages: DataFrame, least_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The chunked record table to write for pages.

    Payload: html in UTF-8, null as empty. Of records with equal payloads of at least
    `least_bytes` that with the smallest page_id (null ids last, then the smallest url, null
    last) is a response; the others, also rows that repeat it altogether, are revisits of
    it and carry no payload. Smaller payloads are all responses. Other columns are not
    read; empty input gives no records.

    A revisit needs no payload, so only digests meet by payload: a payload that holds much
    of the input moves as narrow rows, and its text only from the one page that responds.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    plain = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    plain = plain.select("*", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1"))
    keyed = plain.withColumn("key", F.unhex(F.sha2("payload", 256)))
    # One value for a row's id, address and payload: it can be null nowhere, so joins and groups share its shuffle.
    same = F.unhex(F.sha2(F.concat(*_known(F.col("page_id"), F.col("url"), F.hex("key"))).cast("binary"), 256))
    large = keyed.where(F.col("bytes") >= least_bytes).withColumn("same", same)
    distinct = staged(large.groupBy("same", "key", "page_id", "url", "bytes", "sha1").agg(F.count(F.lit(1)).alias("copies")), "digests")
    rank = F.struct(F.col("page_id").isNull(), "page_id", F.col("url").isNull(), "url")
    first = distinct.groupBy("key").agg(F.min_by(F.struct("page_id", "url", "same"), rank).alias("first"))

    again = distinct.join(first, "key").withColumn("again", F.col("copies") - F.when(F.col("same") == F.col("first.same"), 1).otherwise(0))
    again = again.where("again > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("again").cast("int"))))
    revisits = again.select(
        _identity(F.col("page_id"), F.col("url"), F.hex("key"), F.col("copy").cast("string")).alias("record_id"),
        F.lit("revisit").alias("record_type"),
        *("page_id", "url", "bytes", "sha1"),
        F.col("first.page_id").alias("refers_to"),
        _identity(F.col("first.page_id"), F.col("first.url"), F.hex("key")).alias("refers_to_record"),
        F.lit(0).alias("chunk"),
        F.lit(b"").alias("payload"),
    )

    # Equal rows that respond are one record: the join has put them side by side.
    whole = large.join(first.select("first.same").hint("merge"), "same", "left_semi")
    whole = whole.groupBy("same").agg(*(F.first(c).alias(c) for c in ("key", "page_id", "url", "payload", "bytes", "sha1"))).drop("same")
    whole = whole.withColumn("record_id", _identity(F.col("page_id"), F.col("url"), F.hex("key")))
    if least_bytes > 0:
        copy = F.monotonically_increasing_id().cast("string")
        small = keyed.where(F.col("bytes") < least_bytes).withColumn("record_id", _identity(F.col("page_id"), F.col("url"), F.hex("key"), copy))
        whole = whole.unionByName(small)
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("bytes") / CHUNK).cast("int") - 1, F.lit(0)))
    responses = whole.withColumn("chunk", F.explode(parts)).select(
        *("record_id", F.lit("response").alias("record_type"), "page_id", "url", "bytes", "sha1"),
        F.lit(None).cast("long").alias("refers_to"),
        F.lit(None).cast("string").alias("refers_to_record"),
        *("chunk", F.substring("payload", F.col("chunk") * CHUNK + 1, F.lit(CHUNK)).alias("payload")),
    )
    return responses.unionByName(revisits)


def _known(*parts: F.Column) -> list[F.Column]:
    texts = [c.cast("string") for c in parts]
    return [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in texts]


def _identity(*parts: F.Column) -> F.Column:
    return F.regexp_replace(F.md5(F.concat(*_known(*parts)).cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "urn:uuid:$1-$2-$3-$4-$5")


def write_archives(table: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE) -> DataFrame:
    """Write a chunked record table (chunks of a record side by side, in order) as .warc.gz
    files below `folder`, a URI that all executors reach. Returns the archives: path,
    records, bytes; files of attempts that failed are not among them. No rows, no archives."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = fs.FileSystem.from_uri(folder)
        target.create_dir(base, recursive=True)
        context = TaskContext.get()
        sink, member, path, count, seq, left = None, None, "", 0, 0, 0

        def closed() -> pa.RecordBatch:
            size = sink.tell()
            sink.close()
            return pa.record_batch([pa.array([path]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                if row["chunk"].as_py() == 0:
                    if sink and sink.tell() >= archive_bytes:
                        yield closed()
                        sink = None
                    if sink is None:
                        name = f"{context.partitionId():05d}-{seq:03d}-{uuid.uuid4().hex}.warc.gz"
                        path, seq, count = f"{folder}/{name}", seq + 1, 0
                        sink = target.open_output_stream(f"{base}/{name}", compression=None)
                        sink.write(_zipped(_warcinfo(name, date)))
                    member, count = zlib.compressobj(6, zlib.DEFLATED, 31), count + 1
                    left = row["bytes"].as_py() if row["record_type"].as_py() == "response" else 0
                    sink.write(member.compress(_head({c: v.as_py() for c, v in row.items() if c != "payload"}, date)))
                piece = row["payload"].as_buffer()
                left -= len(piece)
                sink.write(member.compress(piece))
                if left <= 0:
                    sink.write(member.compress(b"\r\n\r\n") + member.flush())
        if sink:
            yield closed()

    return staged(table.mapInArrow(write, "path string, records long, bytes long"), "archives")


def _lines(*pairs: tuple[str, object]) -> bytes:
    return b"".join(f"{k}: {v}\r\n".encode() for k, v in pairs if v is not None)


def _zipped(record: bytes) -> bytes:
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    return member.compress(record) + member.flush()


def _warcinfo(name: str, date: str) -> bytes:
    block = b"software: tradewind\r\nformat: WARC File Format 1.1\r\n"
    head = (("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(block)))
    return VERSION + b"\r\n" + _lines(*head) + b"\r\n" + block + b"\r\n\r\n"


def _uri(url: str | None) -> str | None:
    """Characters that no header may hold are escaped."""
    return None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")


def _digest(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def _head(row: dict, date: str) -> bytes:
    """WARC header and, for a response, the head of the HTTP message."""
    http = b""
    kind = row["record_type"]
    if kind == "response":
        http = b"HTTP/1.1 200 OK\r\n" + _lines(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", row["bytes"])) + b"\r\n"
    refers = row["refers_to_record"]
    return (
        VERSION
        + b"\r\n"
        + _lines(
            ("WARC-Type", kind),
            ("WARC-Record-ID", f"<{row['record_id']}>"),
            ("WARC-Date", date),
            ("WARC-Target-URI", _uri(row["url"])),
            ("WARC-Payload-Digest", "sha1:" + _digest(bytes.fromhex(row["sha1"]))),
            ("WARC-Profile", PROFILE if refers else None),
            ("WARC-Refers-To", f"<{refers}>" if refers else None),
            ("X-Refers-To-Page-ID", row["refers_to"]),
            ("X-Page-ID", row["page_id"]),
            ("X-Payload-Length", row["bytes"]),
            ("Content-Type", "application/http;msgtype=response"),
            ("Content-Length", len(http) + (row["bytes"] if http else 0)),
        )
        + b"\r\n"
        + http
    )


class _Stream:
    """Bytes of an archive, decompressed as they are asked for."""

    def __init__(self, source, zipped: bool, step: int = 1 << 16):
        self.source, self.step = source, step
        self.held, self.at = b"", 0
        self.member = zlib.decompressobj(31) if zipped else None
        self.rest = b""

    def _more(self) -> bool:
        raw = self.rest or self.source.read(self.step)
        self.rest = b""
        if self.member is not None:
            if raw and self.member.eof:
                self.member = zlib.decompressobj(31)
            # A small input can be a giant in gzip: what one call makes is bounded.
            plain = self.member.decompress(raw, 4 * self.step)
            self.rest = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            raw = plain if plain or not (raw or self.rest) else None
        if raw:
            self.held, self.at = self.held[self.at :] + raw, 0
        return raw != b""

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the archive."""
        while (end := self.held.find(b"\n", self.at)) < 0:
            if not self._more():
                if self.at < len(self.held):
                    raise ValueError("the archive ends within a header")
                return None
        out, self.at = self.held[self.at : end], end + 1
        return out.rstrip(b"\r")

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if self.at == len(self.held) and not self._more():
                raise ValueError("the archive ends within a record")
            piece = self.held[self.at : self.at + n]
            self.at += len(piece)
            n -= len(piece)
            if piece:
                yield piece

    def fields(self) -> tuple[dict[str, str], int]:
        """Header fields up to the empty line, and the bytes that they took with CRLF ends."""
        out, size = {}, 0
        while line := self.line():
            size += len(line) + 2
            name, _, value = line.partition(b":")
            out[name.strip().lower().decode()] = value.strip().decode()
        if line is None:
            raise ValueError("the archive ends within a header")
        return out, size + 2


def parse(stream: _Stream, chunk: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of an archive's records, in order."""
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        head, _ = stream.fields()
        left, kind = int(head["content-length"]), head["warc-type"]
        if kind == "response" and head.get("content-type", "").startswith("application/http"):
            status = stream.line()
            left -= len(status) + 2 + stream.fields()[1]
        claimed = head.get("warc-payload-digest", "").removeprefix("sha1:")
        row = {
            "record_id": head["warc-record-id"].strip("<>"),
            "record_type": kind,
            "page_id": int(head["x-page-id"]) if "x-page-id" in head else None,
            "refers_to": int(head["x-refers-to-page-id"]) if "x-refers-to-page-id" in head else None,
            "target_uri": head.get("warc-target-uri"),
        }
        digest, size, number, held = hashlib.sha1(), 0, 0, []
        for piece in stream.take(left):
            at = 0
            while at < len(piece):
                part = piece[at : at + chunk - sum(map(len, held))]
                at += len(part)
                held.append(part)
                if sum(map(len, held)) == chunk and size + chunk < left:
                    payload = b"".join(held)
                    digest.update(payload)
                    size += len(payload)
                    yield row | {"chunk": number, "payload": payload, "payload_bytes": size, "payload_digest": _digest(digest.digest()), "last": False, "intact": None}
                    number, held = number + 1, []
        payload = b"".join(held)
        digest.update(payload)
        size += len(payload)
        found = _digest(digest.digest())
        if kind == "revisit":
            size, found = int(head.get("x-payload-length", size)), claimed or found
        yield row | {"chunk": number, "payload": payload, "payload_bytes": size, "payload_digest": found, "last": True, "intact": not claimed or claimed == found}


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The chunked record table of archives (column path; .gz by name): CHUNK_SCHEMA.

    payload_bytes and payload_digest (base32 SHA-1) cover a payload up to and with its
    chunk; `last` marks the whole one, and `intact` says whether it has the digest that the
    header claims. A revisit's are those of the payload that it stands for. Each archive is
    read by one task in bounded memory; one that ends within a record is an error.
    """
    fields = ["record_id", "chunk", "record_type", "page_id", "refers_to", "target_uri", "payload", "payload_bytes", "payload_digest", "last", "intact"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                source, name = fs.FileSystem.from_uri(path)
                with source.open_input_stream(name, compression=None) as raw:
                    rows, size = [], 0
                    for row in parse(_Stream(raw, path.endswith(".gz"))):
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        size += 200 + len(row["payload"] or b"")
                        if size >= 8 * CHUNK:
                            yield _batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows)

    def _batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[f] for r in rows], k) for f, k in zip(fields, kinds)], fields)

    paths = archives.select("path")
    return paths.repartition(max(1, paths.count())).mapInArrow(read, CHUNK_SCHEMA)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared one, as a URI; it goes when the driver ends."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    dropped_at_exit(spark, uri)
    return uri.replace("file:/", "file:///") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages as archives, read them back, and return what each record says (see `records`)."""
    folder = shared_folder(pages.sparkSession, "warc")
    read = read_archives(write_archives(records(pages, least_bytes), folder), with_payload=False)
    whole = read.where("last AND record_type IN ('response', 'revisit')")
    return whole.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


ORACLE = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, row_number() OVER (ORDER BY page_id, url) AS id, sha1(coalesce(html, '')) AS hex FROM pages
), bits AS (
  SELECT *, list_transform(string_split(hex, ''), lambda c: strpos('0123456789abcdef', c) - 1) AS nibbles FROM payloads
), digits AS (
  SELECT *, list_transform(range(32), lambda i: list_reduce(list_prepend(0, list_transform(range(5), lambda b:
      (nibbles[1 + (5 * i + b) // 4] >> (3 - (5 * i + b) % 4)) & 1)), lambda value, bit: 2 * value + bit)) AS fives
  FROM bits
), firsts AS (
  SELECT *, first_value(id) OVER same AS first_id, first_value(page_id) OVER same AS first_page FROM digits
  WINDOW same AS (PARTITION BY payload ORDER BY page_id NULLS LAST, id)
)
SELECT page_id, strlen(payload) AS payload_bytes,
       list_aggregate(list_transform(fives, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + v, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN id = first_id THEN NULL ELSE first_page END AS refers_to, true AS intact
FROM firsts
"""
