"""WARC archives: written from pages with revisits for equal payloads, and read back record by record.

An archive is a row (archive, content) of whole gzip members, one per record, rolled at ARCHIVE_BYTES, so that it can be
kept as a table or as files; read() also takes what Spark's binaryFile source returns for real `.warc.gz` files. The
reader walks an archive from front to back: it inflates one member at a time in steps of STEP_BYTES, frames the record by
its Content-Length, checks block and payload digests, and never holds more than one record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehold.llm.storage import written

ARCHIVE_BYTES, STEP_BYTES, LEVEL = 8 << 20, 1 << 16, 6
#: Repeated payloads up to which their first pages are broadcast (some 60 bytes each); beyond, they are joined.
BROADCAST_FIRSTS = 200_000
#: Payloads from this size on become revisits of the first page that has them.
LEAST_REVISIT = 0
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def sha1(data: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sha1((h.as_py() or "").encode()) for h in batch.column(batch.schema.get_field_index("html"))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "digest"])


def _line(name: str, value: object) -> bytes:
    """A header line; control characters of the value are written as spaces."""
    return f"{name}: {''.join(' ' if ord(c) < 32 or ord(c) == 127 else c for c in str(value))}\r\n".encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, not compressed: the whole response, or for a revisit its HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [b"WARC/1.1\r\n", _line("WARC-Type", "response" if refers_to is None else "revisit")]
    head.append(_line("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {url} {digest}')}>"))
    head += [_line("WARC-Date", DATE)]
    if url is not None:
        head.append(_line("WARC-Target-URI", url))
    if page_id is not None:
        head.append(_line("X-Page-ID", page_id))
    head += [_line("WARC-Payload-Digest", f"sha1:{digest}"), _line("WARC-Block-Digest", f"sha1:{sha1(block)}")]
    if refers_to is not None:
        head += [_line("WARC-Profile", PROFILE), _line("X-Refers-To-Page-ID", refers_to)]
    head += [_line("Content-Type", "application/http; msgtype=response"), _line("Content-Length", len(block)), b"\r\n"]
    return b"".join(head) + block + b"\r\n\r\n"


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, count = [], 0, 0
    task = TaskContext.get().partitionId()

    def rolled() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f"pages-{task:06d}-{count:06d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], ["archive", "content"])

    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "html", "digest", "refers_to")]
        for k in range(batch.num_rows):
            page_id, url, html, digest, refers_to = (c[k].as_py() for c in columns)
            squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            member = squeeze.compress(record(page_id, url, (html or "").encode(), digest, refers_to)) + squeeze.flush()
            if held and size + len(member) > ARCHIVE_BYTES:
                yield rolled()
                held, size, count = [], 0, count + 1
            held.append(member)
            size += len(member)
    if held:
        yield rolled()


def write(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Archives (archive, content) of pages (page_id, url, html); a null html is an empty payload.

    Of pages with equal payloads of at least `least` bytes, those with the smallest page_id are responses and all others
    revisits of it. A payload is equal if its SHA-1 and its length are. Pages with a null page_id come after all others,
    and are responses where nothing else has their payload. Every row gives one record; an empty table no archive;
    other columns play no part.
    """
    digested = pages.selectExpr("CAST(page_id AS LONG) AS page_id", "url", "html")
    digested = digested.mapInArrow(_digests, "page_id long, url string, html string, digest string").withColumn("size", F.coalesce(F.octet_length("html"), F.lit(0)))
    groups = digested.select("page_id", "digest", "size").where(F.col("size") >= least).groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # only payloads that several pages have need to know who is first; where they are few, no payload is moved
    firsts = written(groups.where("n > 1").drop("n"), "warc-firsts")
    few = firsts.limit(BROADCAST_FIRSTS + 1).count() <= BROADCAST_FIRSTS
    known = digested.join(F.broadcast(firsts) if few else firsts, ["digest", "size"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return known.withColumn("refers_to", F.when(revisit, F.col("first"))).mapInArrow(_archives, "archive string, content binary")


def members(content) -> Iterator[Iterator[bytes]]:
    """The gzip members of an archive, each as a stream of inflated pieces; the streams must be used up in order."""
    view, at = memoryview(content), 0
    while at < len(view):
        inflate = zlib.decompressobj(31)

        def pieces() -> Iterator[bytes]:
            nonlocal at
            while not inflate.eof:
                if at >= len(view):
                    raise EOFError("the last member is cut off")
                step = view[at : at + STEP_BYTES]
                out = inflate.decompress(step)
                at += len(step) - len(inflate.unused_data)
                if out:
                    yield out

        yield pieces()


def parsed(stream: Iterator[bytes]) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record; the block is framed by Content-Length."""
    held = bytearray()
    while (end := held.find(b"\r\n\r\n")) < 0:
        held += next(stream)
    lines = held[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    del held[: end + 4]
    length = int(headers["content-length"])
    for piece in stream:
        held += piece
    if bytes(held[length:]) != b"\r\n\r\n":
        raise ValueError("the record is not as long as its Content-Length says")
    return headers, bytes(held[:length])


def _digest(data: bytes, said: str) -> bool:
    """Whether data has the digest that a header states; digests of other kinds than SHA-1 are taken as they are."""
    kind, _, value = said.partition(":")
    return kind.lower() != "sha1" or value.upper() == sha1(data)


def checked(headers: dict[str, str], block: bytes) -> tuple[int, str, bytes | None]:
    """Payload size, bare payload digest and payload (None for a revisit) of a record whose stated digests hold.

    The payload of an HTTP message is what follows its header, of any other record its whole block. Digests need not be
    stated; a revisit's size is that of its HTTP header, or 0.
    """
    if not _digest(block, headers.get("warc-block-digest", "")):
        raise ValueError("the block digest does not hold")
    http, _, payload = block.partition(b"\r\n\r\n") if headers.get("content-type", "").startswith("application/http") else (b"", b"", block)
    said = [int(line.split(b":")[1]) for line in http.split(b"\r\n")[1:] if line.lower().startswith(b"content-length:") and line.split(b":")[1].strip().isdigit()]
    stated = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "revisit":
        return said[0] if said else 0, stated.partition(":")[2], None
    if said and b"transfer-encoding:" not in http.lower() and len(payload) != said[0] or not _digest(payload, stated):
        raise ValueError("the payload digest does not hold")
    return len(payload), stated.partition(":")[2] or sha1(payload), payload


SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for member in members(content.as_buffer()):
                headers, block = parsed(member)
                length, digest, payload = checked(headers, block)
                number = lambda name: int(headers[name]) if name in headers else None  # noqa: B023, E731
                rows.append((number("x-page-id"), headers.get("warc-target-uri"), headers.get("warc-type"), number("x-refers-to-page-id"), length, digest, payload))
                size += len(block)
                if size > ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read(archives: DataFrame) -> DataFrame:
    """One row per record of archives (content): page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    payload is null for revisits; their size and digest are those of the full payload. Records of all types are read:
    warcinfo, requests and metadata too, with or without digests, each with its own record_type. A record that is cut
    off, is not as long as it says, or whose stated digests do not hold fails the job with the reason. Repeated records
    stay; an empty table gives an empty result; other columns of archives play no part.
    """
    return archives.select("content").mapInArrow(_records, SCHEMA)
