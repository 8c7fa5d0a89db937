"""Packing of documents into sequences by the sum of squares of open bins.

A piece goes where the squared counts of open bins per residual gap become smallest. That rule looks
only at lengths and at counts of open bins, so it is run over the histogram of lengths, a step for
each run of like choices, but for at least 1/STEPS of a batch; so of large batches some pieces go on to
a gap after the exact rule would leave it. A thrifty plan is kept where it needs fewer sequences. Bins that a step fills alike are an interval of sequence numbers. The plan's
size is bounded by the capacity and the steps, not by the corpus. Pieces then take their places by
their number within their length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, materialize, ranked, table, text_or_empty
from .tokens import END_ID, default_path, encoder

CAPACITY = 1024
#: A batch of like pieces is placed in at most about so many steps.
STEPS = 8
#: Pieces up to a share of the capacity are placed in so many rounds over all their lengths, in a mixed order.
ROUNDS = 16
#: Longer ones go first, longest first. Each share is tried; the plan with the fewest sequences is kept.
SMALL_SHARES = (0.3, 0.4, 0.5)
#: Hash buckets that numbering the pieces of one length is split over.
SALTS = 64


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one if it fits, else pieces of capacity, the first one shorter."""
    first = n % capacity if n > capacity else n
    starts = [0, *range(first, n, capacity)] if first else [*range(0, n, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n], strict=True)]


def batches(histogram: dict[int, int], small: int) -> Iterator[tuple[int, int]]:
    """(length, pieces) in the order of placing."""
    for length in sorted((x for x in histogram if x > small), reverse=True):
        yield length, histogram[length]
    mixed = [(x, zlib.crc32(b"%d" % x)) for x in sorted(histogram) if x <= small]
    for k in range(ROUNDS):
        for length, salt in sorted(mixed, key=lambda x: zlib.crc32(b"%d %d" % (k, x[0]))):
            n, shift = histogram[length], salt % ROUNDS
            share = (n * (k + 1) + shift) // ROUNDS - (n * k + shift) // ROUNDS
            if share:
                yield length, share


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """{length: pieces} -> rows (length, first number, pieces, first sequence, offset), and the number of sequences.

    The pieces of a length numbered from `first number` on go one each to the sequences from `first
    sequence` on, at `offset`. With many more pieces than gaps the plain rule packs tightest; with few, the
    thrifty one does, which takes a new bin only where no open one has room.
    """
    tried = [_plan(histogram, capacity, int(capacity * x)) for x in SMALL_SHARES]
    return min([*tried, _plan(histogram, capacity, 0, thrifty=True)], key=lambda x: x[1])


def _plan(histogram: dict[int, int], capacity: int, small: int, thrifty: bool = False) -> tuple[list[tuple[int, int, int, int, int]], int]:
    bins: dict[int, list[list[int]]] = defaultdict(list)  # by gap: intervals of sequence numbers
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap
    rows, opened = [], 0
    numbers: dict[int, int] = defaultdict(int)
    for length, batch in batches(histogram, small):
        todo, number = batch, numbers[length]
        numbers[length] += batch
        while todo:
            # change of the sum of squares for each gap that a piece may go to; the last is a new bin
            gaps = np.flatnonzero(count[length:]) + length
            after = gaps - length
            change = 1 - 2 * count[gaps] + np.where(after > 0, 2 * count[after] + 1, 0)
            left = capacity - length
            fresh = 2 * count[left] + 1 if left else 0
            at = int(np.argmin(change)) if len(gaps) else -1

            def opens(after: int, length: int = length) -> list[int]:
                """The change for the gap that a piece leaves, which may be a rival once it is open."""
                if after < length:
                    return []
                return [1 - 2 * int(count[after]) + (2 * int(count[after - length]) + 1 if after > length else 0)]

            if at >= 0 and (thrifty or change[at] <= fresh):
                gap = int(gaps[at])
                rival = min([*np.delete(change, at).tolist(), *opens(gap - length), 8 * todo + int(change[at])])
                slack = (rival if thrifty else min(rival, fresh)) - int(change[at])
                # a piece takes 8 of the slack at most: 4 of its own, 2 where a rival's gap grows, 2 where its rest shrinks
                n = min(todo, int(count[gap]), max(slack // 4 + 1, -(-batch // STEPS)))
            else:
                gap = capacity
                slack = min([*change.tolist(), *opens(left), 4 * todo + fresh]) - fresh
                # of like pieces, capacity // length share a bin
                n = -(-todo // (capacity // length)) if thrifty else int(min(todo, max((slack - 1) // 4 + 1, -(-batch // STEPS), 1)))
                bins[gap].append([opened, n])
                opened += n
            if gap < capacity:
                count[gap] -= n
            if gap > length:
                count[gap - length] += n
            todo -= n
            while n:
                first, k = bins[gap][-1]
                k = min(k, n)
                start = first + bins[gap][-1][1] - k
                bins[gap][-1][1] -= k
                if not bins[gap][-1][1]:
                    bins[gap].pop()
                rows.append((length, number, k, start, capacity - gap))
                if gap > length:
                    bins[gap - length].append([start, k])
                number, n = number + k, n - k
    return rows, opened


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32; ids of whole texts, each with end_id."""

    def encode(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(tokenizer)
        for batch in got:
            out = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), of.encode(batch.column(1), end_id), strict=True):
                out += [(doc_id, k, a, n, zlib.crc32(ids[4 * a : 4 * (a + n)])) for k, (a, n) in enumerate(cut(len(ids) // 4, capacity))]
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(frugal(encode), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset; a row for each piece.

    A null or empty text is a document of the end id alone. Rows with one doc_id are documents of
    their own. An empty table gives no rows. Pieces of one length are alike, so which of them goes to
    which place is free; it is settled by hashes of their rows.
    """
    cuts = materialize(pieces(docs, tokenizer or default_path(), capacity), "pieces")
    histogram = {r["length"]: r["count"] for r in cuts.groupBy("length").count().collect()}  # at most capacity rows
    rows, _ = plan(histogram, capacity)
    places = np.array(rows, np.int64).reshape(-1, 5)
    places = places[np.lexsort((places[:, 1], places[:, 0]))]  # bounded by capacity, STEPS and ROUNDS
    lengths = places[:, 0]
    ends = np.searchsorted(lengths, np.arange(capacity + 2))

    def place(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in got:
            length, nth = (b.column(b.schema.get_field_index(x)).to_numpy() for x in ("length", "nth"))
            at = np.empty(len(length), np.int64)
            for x in np.unique(length):
                own, low, high = length == x, ends[x], ends[x + 1]
                at[own] = low - 1 + np.searchsorted(places[low:high, 1], nth[own], side="right")
            found = places[at]
            keep = [b.column(b.schema.get_field_index(x)) for x in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*keep, pa.array(found[:, 3] + nth - found[:, 1]), pa.array(found[:, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    numbered = ranked(cuts, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "nth", SALTS, bounded=True)
    return numbered.mapInArrow(frugal(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op8_sum_of_squares_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
