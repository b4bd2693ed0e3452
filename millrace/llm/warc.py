"""WARC archives through a chunked record table.

Writing: one archive a partition, a record a page. A payload is taken in chunks of CHUNK
bytes, each compressed into the record's own gzip member as it comes, so no record is built
in memory. The digest of a payload, by which equal ones are found beforehand, is Spark's.
Reading: an archive is inflated as a stream; each record becomes rows of record identifier,
chunk number, bytes, and the running digest and length so far, the last of which are those
of the record. Chunks hold CHUNK bytes at most.

Archives lie in the shared folder and are written under a name of their own attempt, then
moved, so a task that runs twice leaves one file. Of pages with equal payloads of at least
``min_bytes`` the smallest page_id is the response and the others revisit it; smaller
payloads are all responses. Null html is an empty payload, null urls are empty; urls and
payloads may be of any length. Pages with null ids sort last: they revisit the page of the
smallest id, or are all responses where no page of their payload has one. An empty table
gives no archive. Further columns may have any name. Rows that share the
smallest id of a payload are all responses; rows that share an id but not a payload are
decided each for its own.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch

CHUNK = 1 << 18
SALTS = 64
CRLF = b"\r\n"
RECORD_SCHEMA = "archive string, n_records long"
CHUNK_SCHEMA = "record_id string, page_id long, record_type string, refers_to long, chunk_no long, data binary, n_bytes long, digest string, last boolean, payload_bytes long, payload_digest string"


def sha1_base32(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def open_at(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def payload_key() -> Column:
    body = F.coalesce("html", F.lit(""))
    return F.struct(F.unhex(F.sha1(body)).alias("sha"), F.xxhash64(body).alias("x"))


def decisions(pages: DataFrame, scratch: Scratch, min_bytes: int = 0) -> DataFrame:
    """The pages that revisit another one: page_id, key of the payload and refers_to.

    Only the first page of each digest is gathered, by partial aggregation. The pages of a
    digest meet it under SALTS salts of their id and url, so that those of a hot digest are spread.
    """
    body = F.coalesce("html", F.lit(""))
    light = scratch.put(pages.where(F.octet_length(body) >= min_bytes).select("page_id", payload_key().alias("key"), F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("salt")), "warc_keys")
    first = light.groupBy("key").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null")
    first = scratch.put(first.select("key", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), "warc_first")
    again = light.join(first, ["key", "salt"]).where("page_id is null or page_id > refers_to")
    return scratch.put(again.select("page_id", "key", "refers_to").distinct(), "warc_revisits")


def record_id(page_id, again: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{again}')}>"


def pieces(raw, size: int = CHUNK) -> Iterator[memoryview]:
    view = memoryview(raw)
    for at in range(0, len(view), size):
        yield view[at : at + size]


class Writer:
    """A WARC file, one gzip member a record."""

    def __init__(self, out):
        self.out, self.n = out, 0

    def record(self, kind: str, rid: str, page_id, url: str, payload, refers_to=None) -> None:
        digest = hashlib.sha1(usedforsecurity=False)
        for part in pieces(payload):
            digest.update(part)
        head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}",
                f"WARC-Payload-Digest: sha1:{sha1_base32(digest.digest())}", f"X-Payload-Length: {len(payload)}", f"X-Page-ID: {'' if page_id is None else page_id}"]
        if kind == "revisit":
            head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, 0)}", f"X-Refers-To-Page: {refers_to}"]
        block = b"" if kind == "revisit" else payload
        head += ["Content-Type: text/html;charset=utf-8", f"Content-Length: {len(block)}"]
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        self.out.write(z.compress(CRLF.join(x.encode() for x in head) + CRLF * 2))
        for part in pieces(block):
            self.out.write(z.compress(part))
        self.out.write(z.compress(CRLF * 2) + z.flush())
        self.n += 1


def one_line(url: str | None) -> str:
    """A header holds no line breaks."""
    return "" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Archive paths, one a partition. pages: page_id, url, html and refers_to (null: a response)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        fs, at = open_at(folder)
        fs.create_dir(at, recursive=True)
        name, own = f"{at}/part-{ctx.partitionId():06d}.warc.gz", f"{at}/.{uuid.uuid4().hex}"
        seen: dict[tuple, int] = {}
        with fs.open_output_stream(own, compression=None) as out:
            w = Writer(out)
            for batch in batches:
                cols = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "html", "refers_to")]
                for i in range(batch.num_rows):
                    page_id, url, refers_to = cols[0][i].as_py(), cols[1][i].as_py(), cols[3][i].as_py()
                    html = cols[2][i].as_buffer() if cols[2][i].is_valid else b""
                    payload = memoryview(html) if html is not None else b""
                    kind = "response" if refers_to is None else "revisit"
                    again = seen[page_id] = seen.get(page_id, -1) + 1
                    w.record(kind, record_id(page_id, again), page_id, one_line(url), payload, refers_to)
        if w.n:
            fs.move(own, name)
        else:
            fs.delete_file(own)
        if w.n:
            yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name.rpartition("/")[2]}"], "n_records": [w.n]}, schema=pa.schema([("archive", pa.string()), ("n_records", pa.int64())]))

    return pages.mapInArrow(write, RECORD_SCHEMA)


class Inflated:
    """The bytes of a file of gzip members, one after another, in bounded pieces."""

    def __init__(self, stream):
        self.stream, self.z, self.rest, self.buf = stream, None, b"", b""

    def _more(self) -> bool:
        while True:
            if not self.rest:
                self.rest = self.stream.read(CHUNK)
                if not self.rest:
                    return False
            if self.z is None:
                self.z = zlib.decompressobj(31)
            got = self.z.decompress(self.rest, CHUNK)
            if self.z.eof:
                self.rest, self.z = self.z.unused_data, None
            else:
                self.rest = self.z.unconsumed_tail
            if got:
                self.buf += got
                return True

    def line(self) -> bytes | None:
        while (at := self.buf.find(CRLF)) < 0:
            if not self._more():
                return None
        out, self.buf = self.buf[:at], self.buf[at + 2 :]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buf) < n and self._more():
            pass
        out, self.buf = self.buf[:n], self.buf[n:]
        if len(out) < n:
            raise EOFError("archive ends within a record")
        return out


def records(stream) -> Iterator[tuple]:
    """Chunk rows of an archive."""
    z = Inflated(stream)
    while (version := z.line()) is not None:
        if version != b"WARC/1.1":
            raise ValueError(f"not a record: {version[:40]!r}")
        head = {}
        while line := z.line():
            k, _, v = line.decode().partition(": ")
            head[k] = v
        left, digest, chunk, so_far = int(head["Content-Length"]), hashlib.sha1(usedforsecurity=False), 0, 0
        number = lambda k: int(head[k]) if head.get(k) else None  # noqa: E731, B023
        while True:
            data = z.take(min(left, CHUNK))
            digest.update(data)
            left -= len(data)
            so_far += len(data)
            running = sha1_base32(digest.digest())
            full = head["WARC-Payload-Digest"].removeprefix("sha1:")
            if not left and head["WARC-Type"] == "response" and running != full:
                raise ValueError(f"payload of {head['WARC-Record-ID']} does not have its digest")
            yield (head["WARC-Record-ID"], number("X-Page-ID"), head["WARC-Type"], number("X-Refers-To-Page"), chunk, data, so_far, running, not left, int(head["X-Payload-Length"]), full)
            chunk += 1
            if not left:
                break
        if z.take(4) != CRLF * 2:
            raise ValueError("record has no end")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The chunked record table of the archives; ``payloads=False`` leaves ``data`` null."""
    fields = ["record_id", "page_id", "record_type", "refers_to", "chunk_no", "data", "n_bytes", "digest", "last", "payload_bytes", "payload_digest"]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string()]
    schema = pa.schema(list(zip(fields, types, strict=True)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, at = open_at(uri)
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for row in records(stream):
                        rows.append(row if payloads else (*row[:5], None, *row[6:]))
                        held += len(row[5]) + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=schema)

    return archives.select("archive").mapInArrow(read, CHUNK_SCHEMA)


def archived(pages: DataFrame, scratch: Scratch, min_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) as archives; return the written table of their paths."""
    again = decisions(pages, scratch, min_bytes)
    right = again.select(F.col("page_id").alias("again_id"), F.col("key").alias("again_key"), "refers_to")
    pages = pages.select("page_id", "url", "html")
    joined = pages.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, F.col("page_id").eqNullSafe(F.col("again_id")) & (payload_key() == F.col("again_key")), "left").drop("again_id", "again_key")
    root = scratch.root if ":/" in scratch.root else f"file://{scratch.root}"
    return scratch.put(write_archives(joined, f"{root}/archives"), "warc_archives")


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """All pages, written as archives and read back: the last chunk of each record has its totals."""
    scratch = Scratch(spark)
    archives = archived(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch)
    # one archive a task, whatever file lists their paths
    paths = archives.repartition(max(1, archives.count()), "archive")
    chunks = read_archives(paths, payloads=False).where("last")
    return chunks.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), h AS (
  SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS x, min(page_id) OVER (PARTITION BY b) AS first FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(x, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT + 1, 1)), '') AS payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM h
"""
