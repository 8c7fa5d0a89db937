"""Token files in patched frame-of-reference blocks.

A segment holds the ids of consecutive documents, cut in blocks of 512. A block stores its minimum,
the differences to it in a bit width that a percentile of them fits in, and the others (their low
bits stay in place) in an exception list of positions and high bits. A table of block starts makes
any document readable without its predecessors. All integers are little-endian:

    "PFR1", u32 documents, u32 blocks, u64 ids, u64 bytes of the segment
    i64 doc_id per document, u8 1 if that doc_id is null, u32 ids per document
    u64 start of each block, from the first block
    blocks: u32 minimum, u8 width, u16 exceptions, u16 ids, packed bits,
            u16 position per exception, u32 high bits per exception

Segments are written by Spark's own file writer, so any store it writes to will do and a task that
runs twice leaves its files once. It ends each segment with a zero byte, which readers skip. A file
has FILE_SEGMENTS segments at most, so reading one takes bounded memory.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frugal, materialize, shared_path, shuffle_parts, table, text_or_empty
from .tokens import END_ID, default_path, encoder

BLOCK = 512
#: The share of a block's differences that its bit width must hold.
PERCENTILE = 0.9
#: Ids gathered before a segment is closed; bounds a task's memory whatever a partition holds.
SEGMENT_IDS = 250_000
#: Segments in a file, about 16 MB; a partition of the sorted documents may be several files.
FILE_SEGMENTS = 32
_HEAD, _BLOCK = struct.Struct("<4sIIQQ"), struct.Struct("<IBHH")


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value takes."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """ids (uint32) -> start of each block, and the blocks."""
    n_blocks = -(-len(ids) // BLOCK)
    if not n_blocks:
        return np.zeros(0, "<u8"), b""
    sizes = np.full(n_blocks, BLOCK)
    sizes[-1] = len(ids) - BLOCK * (n_blocks - 1)
    rows = np.full((n_blocks, BLOCK), ids[-1], np.uint32)
    rows.reshape(-1)[: len(ids)] = ids
    lows = rows.min(axis=1)
    rows -= lows[:, None]
    bits = _widths(rows)
    at = int(PERCENTILE * (BLOCK - 1))
    widths = np.partition(bits, at, axis=1)[:, at]
    odd = bits > widths[:, None]
    counts = odd.sum(axis=1)
    lengths = _BLOCK.size + (BLOCK * widths + 7) // 8 + 6 * counts
    starts = np.concatenate([[0], np.cumsum(lengths)])
    out = np.zeros(starts[-1], np.uint8)
    heads = np.zeros(n_blocks, np.dtype([("low", "<u4"), ("width", "u1"), ("odd", "<u2"), ("n", "<u2")]))
    heads["low"], heads["width"], heads["odd"], heads["n"] = lows, widths, counts, sizes
    out[starts[:-1, None] + np.arange(_BLOCK.size)] = heads.view(np.uint8).reshape(n_blocks, -1)
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        for some in np.array_split(own, -(-len(own) // 512)) if width else ():
            flags = (rows[some, :, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
            packed = np.packbits(flags.astype(np.uint8).reshape(len(some), -1), axis=1, bitorder="little")
            out[starts[some, None] + _BLOCK.size + np.arange(packed.shape[1])] = packed
    block, position = np.nonzero(odd)
    if len(block):
        nth = np.arange(len(block)) - (np.cumsum(counts) - counts)[block]
        first = starts[block] + _BLOCK.size + (BLOCK * widths[block] + 7) // 8
        out[(first + 2 * nth)[:, None] + np.arange(2)] = position.astype("<u2").view(np.uint8).reshape(-1, 2)
        high = (rows[block, position] >> widths[block].astype(np.uint32)).astype("<u4")
        out[(first + 2 * counts[block] + 4 * nth)[:, None] + np.arange(4)] = high.view(np.uint8).reshape(-1, 4)
    return starts[:-1].astype("<u8"), out.tobytes()


def unpack_blocks(starts: np.ndarray, blocks: bytes) -> np.ndarray:
    """What pack_blocks() got."""
    raw, starts = np.frombuffer(blocks, np.uint8), starts.astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.uint32)
    heads = raw[starts[:, None] + np.arange(_BLOCK.size)].copy().view(np.dtype([("low", "<u4"), ("width", "u1"), ("odd", "<u2"), ("n", "<u2")]))[:, 0]
    widths, counts = heads["width"].astype(np.int64), heads["odd"].astype(np.int64)
    rows = np.zeros((len(starts), BLOCK), np.uint32)
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        for some in np.array_split(own, -(-len(own) // 512)) if width else ():
            packed = raw[starts[some, None] + _BLOCK.size + np.arange((BLOCK * width + 7) // 8)]
            flags = np.unpackbits(packed, axis=1, count=BLOCK * width, bitorder="little").reshape(len(some), BLOCK, width)
            rows[some] = flags.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))
    block = np.repeat(np.arange(len(starts)), counts)
    if len(block):
        nth = np.arange(len(block)) - np.repeat(np.cumsum(counts) - counts, counts)
        first = starts[block] + _BLOCK.size + (BLOCK * widths[block] + 7) // 8
        position = raw[(first + 2 * nth)[:, None] + np.arange(2)].copy().view("<u2")[:, 0]
        high = raw[(first + 2 * counts[block] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
        rows[block, position] |= high << widths[block].astype(np.uint32)
    rows += heads["low"][:, None]
    return rows.reshape(-1)[: int(heads["n"].astype(np.int64).sum())]


def segment(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """The segment of these documents; ids: of each, as little-endian unsigned 32-bit integers."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    starts, blocks = pack_blocks(flat)
    keys = np.array([k or 0 for k in doc_ids], "<i8").tobytes() + bytes(k is None for k in doc_ids)
    keys += np.array([len(x) // 4 for x in ids], "<u4").tobytes() + starts.tobytes()
    return _HEAD.pack(b"PFR1", len(ids), len(starts), len(flat), _HEAD.size + len(keys) + len(blocks)) + keys + blocks


def read_segments(content: bytes | memoryview) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """doc_ids, ids of each document, and all ids of each segment in a file."""
    at = 0
    while at < len(content):
        magic, docs, blocks, ids, size = _HEAD.unpack_from(content, at)
        if magic != b"PFR1" or at + size > len(content):
            raise ValueError(f"no whole segment at byte {at}")
        p = at + _HEAD.size
        keys = np.frombuffer(content, "<i8", docs, p)
        nulls = np.frombuffer(content, np.uint8, docs, p + 8 * docs)
        counts = np.frombuffer(content, "<u4", docs, p + 9 * docs)
        starts = np.frombuffer(content, "<u8", blocks, p + 13 * docs)
        flat = unpack_blocks(starts, content[p + 13 * docs + 8 * blocks : at + size])
        if len(flat) != ids:
            raise ValueError(f"segment at byte {at}: {len(flat)} ids, {ids} expected")
        yield [None if z else int(k) for k, z in zip(keys, nulls, strict=True)], counts, flat
        at += size + 1


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Write the ids of docs(doc_id, text) to path, files and documents in ascending doc_id order.

    Null texts are empty; a null doc_id sorts first; rows with one doc_id are ordered by text. Every
    document ends with end_id. An empty table gives files without segments.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, doc_ids, ids, held = encoder(tokenizer), [], [], 0
        for batch in batches:
            for doc_id, own in zip(batch.column(0).to_pylist(), of.encode(batch.column(1), end_id), strict=True):
                doc_ids.append(doc_id)
                ids.append(own)
                held += len(own) // 4
                if held >= SEGMENT_IDS:
                    yield pa.record_batch([pa.array([segment(doc_ids, ids)], pa.binary())], ["payload"])
                    doc_ids, ids, held = [], [], 0
        if ids:
            yield pa.record_batch([pa.array([segment(doc_ids, ids)], pa.binary())], ["payload"])

    texts = docs.select("doc_id", text_or_empty().alias("text"))
    parts = shuffle_parts(docs.sparkSession)
    ordered = texts.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    packed = ordered.mapInArrow(frugal(encode), "payload binary")
    packed.select(F.col("payload").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", FILE_SEGMENTS).text(path)


def _read(spark: SparkSession, path: str, out: pa.Field, of: Callable[[list[memoryview]], Sequence]) -> DataFrame:
    """part and file (which file), nth (place of the document in it), doc_id, start (ids before it in the file), n_tokens, and out: of() each document's ids.

    Each file is read by itself and in order, a segment at a time.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, file, content in zip(*batch.columns, strict=True):
                before = nth = 0
                for doc_ids, counts, flat in read_segments(memoryview(content.as_buffer())):
                    ends = np.cumsum(counts, dtype=np.int64)
                    starts, n = ends - counts, len(doc_ids)
                    raw = memoryview(flat.astype("<u4", copy=False)).cast("B")
                    got = of([raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
                    columns = [pa.array([x.as_py()] * n, pa.int32()) for x in (part, file)]
                    columns += [pa.array(np.arange(nth, nth + n)), pa.array(doc_ids, pa.int64()), pa.array(before + starts), pa.array(counts.astype(np.int64)), pa.array(got, out.type)]
                    yield pa.record_batch(columns, ["part", "file", "nth", "doc_id", "start", "n_tokens", out.name])
                    before, nth = before + len(flat), nth + n

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    numbers = [F.regexp_extract("path", r"/part-(\d+)[^/]*-c(\d+)[^/]*$", k).cast("int").alias(x) for k, x in ((1, "part"), (2, "file"))]
    kind = "binary" if out.type == pa.binary() else "long"
    return files.select(*numbers, "content").mapInArrow(frugal(decode), f"part int, file int, nth long, doc_id long, start long, n_tokens long, {out.name} {kind}")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of all files with their ids (binary, u32); see _read()."""
    return _read(spark, path, pa.field("ids", pa.binary()), lambda ids: [bytes(x) for x in ids])


def token_table(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write docs' ids, read the files back, and return doc_id, start, n_tokens, ids_crc32 of each document."""
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write_tokens(docs, path, tokenizer or default_path())
    read = materialize(_read(spark, path, pa.field("ids_crc32", pa.int64()), lambda ids: [zlib.crc32(x) for x in ids]), "token-index")
    files = read.groupBy("part", "file").agg(F.sum("n_tokens").alias("_n"))
    within = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", "file", F.coalesce(F.sum("_n").over(within), F.lit(0)).alias("_within"), "_n")
    # a row for each partition that was written
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("_n").alias("_n")).select("part", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    starts = files.join(parts, "part").select("part", "file", (F.col("_before") + F.col("_within")).alias("_before"))
    return read.join(starts, ["part", "file"]).select("doc_id", (F.col("_before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    return token_table(table(spark, sf_dir, "documents"))
