"""WARC archives: a gzip member for each record, written and read back in order.

Archives are made in tasks and written by Spark's own file writer, so any store it writes to will do
and a task that runs twice leaves one file. It ends each archive with a zero byte, which gzip readers
pass over as padding.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from io import BytesIO
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, shared_path, table, text_or_empty

#: Compressed bytes after which an archive is closed; bounds what a task holds.
ARCHIVE_BYTES = 8_000_000
#: Bytes read from a stream at a time.
CHUNK = 1 << 16
DATE = "2000-01-01T00:00:00Z"


class WarcError(ValueError):
    """A record breaks the format; the message has the byte at which its member starts."""


@dataclass(frozen=True)
class Record:
    start: int  # byte of the archive at which its gzip member starts
    headers: dict[str, str]
    block: bytes


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(headers: dict[str, str], block: bytes) -> bytes:
    """A record as a gzip member of its own."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


def read_archive(stream: BinaryIO, verify: bool = True) -> Iterator[Record]:
    """Records of an archive in order. Memory: one record and one chunk.

    Each gzip member is inflated as it is read; its headers end at an empty line, its block has
    Content-Length bytes, and the member ends after two line ends. A WARC-Block-Digest is checked.
    Anything else is an error, also a stream that ends within a member. Zero bytes between members
    are passed over.
    """
    left, at = b"", 0
    while True:
        left = left or stream.read(CHUNK)
        padding = len(left) - len(left.lstrip(b"\0"))
        left, at = left[padding:], at + padding
        if not left:
            if padding:
                continue
            return
        start, unpacker, out = at, zlib.decompressobj(31), bytearray()
        while not unpacker.eof:
            left = left or stream.read(CHUNK)
            if not left:
                raise WarcError(f"byte {start}: the archive ends within a record")
            try:
                out += unpacker.decompress(left)
            except zlib.error as e:
                raise WarcError(f"byte {start}: {e}") from e
            at += len(left) - len(unpacker.unused_data)
            left = unpacker.unused_data
        yield _record(start, bytes(out), verify)


def _record(start: int, raw: bytes, verify: bool) -> Record:
    head, found, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not version.startswith("WARC/1."):
        raise WarcError(f"byte {start}: no WARC header")
    headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    try:
        length = int(headers["Content-Length"])
    except (KeyError, ValueError) as e:
        raise WarcError(f"byte {start}: no Content-Length") from e
    block, end = rest[:length], rest[length:]
    if len(block) != length or end != b"\r\n\r\n":
        raise WarcError(f"byte {start}: {length} bytes promised, {len(rest) - 4} found")
    said = headers.get("WARC-Block-Digest")
    if verify and said and said != f"sha1:{digest(block)}":
        raise WarcError(f"byte {start}: the block is not what its digest says")
    return Record(start, headers, block)


def _one_line(text: str) -> str:
    """A header's value: line ends and non-ASCII as percent escapes."""
    from urllib.parse import quote

    return quote(text, safe="".join(map(chr, range(33, 127))))


def with_references(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, html, refers_to (null for responses).

    Of pages with equal html of at_least bytes or more, that with the largest page_id is the response
    and the others refer to it. A null html is an empty one. Rows with the response's page_id, and
    those with a null one, are responses.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), text_or_empty("html").alias("html"))
    keys = rows.select("page_id", F.unhex(F.sha2(F.col("html").cast("binary"), 256)).alias("payload"), F.octet_length("html").alias("n")).where(F.col("page_id").isNotNull() & (F.col("n") >= at_least))
    # a page's own row is all that is gathered for it; the largest page_id is a partial aggregate
    largest = keys.groupBy("payload").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").drop("least")
    keys = keys.join(largest, "payload").where("page_id < refers_to").select("page_id", "payload", "refers_to").distinct()
    marked = rows.withColumn("payload", F.unhex(F.sha2(F.col("html").cast("binary"), 256)))
    return marked.join(keys, ["page_id", "payload"], "left").select("page_id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, path: str, at_least: int = 0) -> None:
    """Write a record for each row of pages(page_id, url, html) to archives under path; see with_references()."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, held = [], 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*batch.columns, strict=True):
                payload, key = html.as_py().encode(), page_id.as_py()
                name = "none" if key is None else key
                headers = {"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{name}>", "WARC-Date": DATE, "WARC-Target-URI": _one_line(url.as_py())}
                block = payload
                if refers_to.as_py() is not None:
                    headers |= {"WARC-Type": "revisit", "WARC-Refers-To": f"<urn:page:{refers_to.as_py()}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                    block = b""
                headers |= {"WARC-Payload-Digest": f"sha1:{digest(payload)}", "WARC-Payload-Length": str(len(payload)), "WARC-Block-Digest": f"sha1:{digest(block)}"}
                archive.append(member(headers, block))
                held += len(archive[-1])
                if held >= ARCHIVE_BYTES:
                    yield pa.record_batch([pa.array([b"".join(archive)], pa.binary())], ["payload"])
                    archive, held = [], 0
        if archive:
            yield pa.record_batch([pa.array([b"".join(archive)], pa.binary())], ["payload"])

    made = with_references(pages, at_least).mapInArrow(frugal(write), "payload binary")
    made.select(F.col("payload").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (null for revisits)."""

    def urn(value: str | None) -> int | None:
        got = (value or "").removeprefix("<urn:page:").removesuffix(">")
        return int(got) if got not in ("", "none") else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())]
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for r in read_archive(BytesIO(content.as_py())):
                    h, revisit = r.headers, r.headers["WARC-Type"] == "revisit"
                    said = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and said != digest(r.block):
                        raise WarcError(f"byte {r.start}: the payload is not what its digest says")
                    rows.append((urn(h["WARC-Record-ID"]), int(h["WARC-Payload-Length"]) if revisit else len(r.block), said, h["WARC-Type"], urn(h.get("WARC-Refers-To")), h["WARC-Target-URI"], None if revisit else r.block))
                    held += len(r.block)
                    if held >= 4 * ARCHIVE_BYTES:
                        yield pa.record_batch([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], [k for k, _ in kinds])
                        rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], [k for k, _ in kinds])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(frugal(read), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = r"""
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, html, upper(sha1(html)) as hex, max(page_id) over (partition by html) as last from p),
n as (select *, list_transform(range(0, 40), lambda i: cast(strpos('0123456789ABCDEF', substr(hex, i + 1, 1)) - 1 as integer)) as h from d),
-- 160 bits as 32 letters of 5 bits: bit k is in hex digit k // 4
b as (select *, list_transform(range(0, 32), lambda j: list_sum(list_transform(range(0, 5), lambda k:
  ((h[(j * 5 + k) // 4 + 1] >> (3 - (j * 5 + k) % 4)) & 1) * (1 << (4 - k))))) as v from n)
select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes,
  array_to_string(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(x as integer) + 1, 1)), '') as payload_digest,
  case when page_id < last then 'revisit' else 'response' end as record_type,
  case when page_id < last then last end as refers_to
from b
"""
