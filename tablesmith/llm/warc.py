"""WARC archives: a writer and a sequential reader.

Archives travel as rows of (archive, segment, data): each segment holds whole gzip members, one member per
record, and the segments of an archive in order are the bytes of a ``.warc.gz`` file. So archives can lie in
any store that Spark reaches, a segment is the unit of recovery, and no task holds more than a segment and a
record. ``read_files`` takes real ``.warc.gz`` files instead.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ready

SEGMENT_BYTES = 4 << 20
FEED = 1 << 16
#: Payloads below so many bytes are never stored as revisits.
REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
ARCHIVE = "archive int, segment int, records int, data binary"
RECORD = "archive int, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def encode(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member of its own."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        clean = url.replace("\r", "%0D").replace("\n", "%0A")
        lines.insert(3, f"WARC-Target-URI: {clean}")
    if refers_to is not None:
        lines[2:2] = [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The decompressed gzip members of a stream of bytes, one at a time; broken or cut-off members raise."""
    inflate, out = None, bytearray()
    for chunk in chunks:
        for i in range(0, len(chunk), FEED):
            data = chunk[i : i + FEED]
            while data:
                if inflate is None:
                    inflate, out = zlib.decompressobj(31), bytearray()
                out += inflate.decompress(data)
                data = inflate.unused_data
                if inflate.eof:
                    yield bytes(out)
                    inflate = None
    if inflate is not None:
        raise ValueError("the archive ends within a record")


def headers(data: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in data.decode("utf-8").split("\r\n")[1:] if line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _page(uri: str | None) -> int | None:
    tail = (uri or "").rstrip(">").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def records(chunks: Iterator[bytes]) -> Iterator[dict]:
    """Parsed records; framing and both digests are verified, and a mismatch raises ValueError."""
    for data in members(chunks):
        if not data.startswith(b"WARC/"):
            raise ValueError("a record doesn't begin with its version")
        top, gap, rest = data.partition(b"\r\n\r\n")
        head = headers(top)
        size = int(head["content-length"])
        block, tail = rest[:size], rest[size:]
        if not gap or len(block) != size or tail != b"\r\n\r\n":
            raise ValueError("a record's block doesn't have its content length")
        if (said := head.get("warc-block-digest")) and said != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise ValueError("a block digest doesn't match")
        http, _, payload = block.partition(b"\r\n\r\n")
        kind, digest = head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha256:")
        length = int(headers(http).get("content-length", len(payload)))
        if kind == "response" and (length != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError("a payload doesn't match its length or digest")
        yield {
            "record_type": kind, "page_id": _page(head.get("warc-record-id")), "url": head.get("warc-target-uri"), "payload_bytes": length,
            "payload_digest": digest, "refers_to": _page(head.get("warc-refers-to")), "payload": payload if kind == "response" else None,
        }


def plan(pages: DataFrame) -> DataFrame:
    """Pages with digest and refers_to: the smallest page_id of equal payloads, where another page has it.

    Rows that repeat the smallest page_id are all responses, and so are rows without a page_id.
    """
    keyed = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = keyed.where(F.octet_length("payload") >= REVISIT_BYTES)
    first = cut(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first"))
    out = keyed.join(first.hint("merge"), "digest", "left")
    return out.withColumn("refers_to", F.when((F.octet_length("payload") >= REVISIT_BYTES) & (F.col("page_id") > F.col("first")), F.col("first"))).drop("first")


def write(pages: DataFrame) -> DataFrame:
    """Archives, in rows of segments, of all ``pages`` (page_id, url, html); null html is an empty payload.

    One archive per task; an empty table gives no rows; other columns are ignored.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        archive, segment, held, n, size = TaskContext.get().partitionId(), 0, [], 0, 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": pa.array([archive], pa.int32()), "segment": pa.array([segment], pa.int32()), "records": pa.array([n], pa.int32()), "data": pa.array([b"".join(held)], pa.binary())})

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                held.append(encode(*row))
                n, size = n + 1, size + len(held[-1])
                if size >= SEGMENT_BYTES:
                    yield flush()
                    segment, held, n, size = segment + 1, [], 0, 0
        if held:
            yield flush()

    ready(pages.sparkSession)
    ahead = plan(pages).select("page_id", "url", "payload", "digest", "refers_to")
    return ahead.mapInArrow(pack, ARCHIVE)


def _rows(archive: int, chunks: Iterator[bytes], payloads: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("archive", pa.int32()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    held, size = [], 0
    for record in records(chunks):
        if not payloads:
            record["payload"] = None
        held.append(record | {"archive": archive})
        size += record["payload_bytes"] if payloads else 200
        if size > SEGMENT_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of ``archives`` as ``write`` makes them, read one segment after another."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, data in zip(batch.column("archive").to_pylist(), batch.column("data"), strict=True):
                yield from _rows(archive, iter([data.as_py()]), payloads)

    return archives.select("archive", "data").mapInArrow(unpack, RECORD)


def read_files(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of ``.warc.gz`` files at ``path`` (of under 2 GB each, a limit of Spark's binary source)."""
    files = ready(spark).read.format("binaryFile").load(path)
    return read(files.select(F.lit(0).alias("archive"), F.col("content").alias("data")), payloads)


def digest_pages(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` into archives in the shared folder, reads those back and returns a row per record."""
    return read(cut(write(pages)), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
