"""SimHash near-duplicates by vantage-point trees.

Fingerprints of 64 bits link at 4 or fewer differing bits. The bits are cut in 3 blocks: of a linked
pair some block differs in at most 1. In each block a tree of vantage points splits the fingerprints
by their Hamming distance over that block's bits: a fingerprint lives in one leaf, and by the triangle
inequality its partners live in leaves whose distances differ by at most 1 from its own, so it is also
sent as a query to those (the boundary-overlapping shards). A level of the tree sends about a third of the
fingerprints to both sides, so copies grow by a power of about 0.4 of the distinct fingerprints. Within a shard the same tree goes on
in memory down to small leaves, whose pairs are compared over all 64 bits. Shards return spanning
trees of what they link, never all pairs, and whole components come from those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, join_hot, materialize, sized, table, text_or_empty
from .graph import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Bit blocks, and how many bits of some block a linked pair differs in at most.
BLOCKS = [(0, 21), (21, 42), (42, 64)]
BLOCK_RADIUS = RADIUS // len(BLOCKS)
#: Fingerprints sampled for each shard of the tree over all shards. Only its balance depends on them.
SAMPLE = 128
#: Distinct fingerprints that a shard holds about; the depth of the tree over all shards follows.
SHARD_SIZE = 32_768
#: Fingerprints in a leaf of the tree within a shard.
LEAF = 48
#: Compared at a time, and pairs kept before they are reduced to trees.
CELLS, PAIRS = 1 << 20, 1 << 20


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Of a UTF-8 text: bit k is set if it is set in over half of the XXH64 of its word shingles."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, and \x20 \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    of = xxhash.xxh64_intdigest
    hashes = np.array([of(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :] or ends[-1:], strict=False)], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half of hashes."""
    n = len(hashes)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    whole = n // 255 * 255  # sums of 255 bits fit a byte
    counts = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        counts += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp (long, the bits as a signed number). A null text is an empty one, with 0."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), size) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select("doc_id", text_or_empty().cast("binary").alias("text")).mapInArrow(frugal(scan), "doc_id long, fp long")


# --- trees over all shards ---


def block_mask(block: int) -> np.uint64:
    low, high = BLOCKS[block]
    return np.uint64(((1 << high) - 1) ^ ((1 << low) - 1))


def distance(a: np.ndarray, b: np.ndarray | np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((a ^ b) & mask)


def split(values: np.ndarray, mask: np.uint64) -> tuple[np.uint64, int]:
    """Of a few vantage points the one whose median distance cuts values most evenly, and that median."""
    best, found = len(values) + 1, (values[0], 0)
    for v in values[np.linspace(0, len(values) - 1, min(8, len(values))).astype(int)]:
        counts = np.bincount(distance(values, v, mask), minlength=1).cumsum()
        at = int(np.argmin(np.abs(2 * counts - len(values))))
        if (odd := abs(2 * int(counts[at]) - len(values))) < best:
            best, found = odd, (v, at)
    return found


def grow(sample: np.ndarray, mask: np.uint64, depth: int) -> list:
    """A tree as [vantage point, median, near, far]; a leaf is an empty list."""
    if not depth or len(sample) < 2:
        return []
    v, median = split(sample, mask)
    near = distance(sample, v, mask) <= median
    if near.all():
        return []
    return [v, median, grow(sample[near], mask, depth - 1), grow(sample[~near], mask, depth - 1)]


def route(tree: list, values: np.ndarray, mask: np.uint64) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each leaf: its number, the places in values of what is sent there, and which of those live there."""
    stack = [(tree, np.arange(len(values)), np.ones(len(values), bool), 1)]
    while stack:
        node, at, home, number = stack.pop()
        if not len(at):
            continue
        if not node:
            yield number, at, home
            continue
        v, median, near, far = node
        d = distance(values[at], v, mask)
        low, high = d <= median + BLOCK_RADIUS, d > median - BLOCK_RADIUS
        stack.append((near, at[low], home[low] & (d[low] <= median), 2 * number))
        stack.append((far, at[high], home[high] & (d[high] > median), 2 * number + 1))


# --- within a shard ---


def spanning(pairs: np.ndarray) -> np.ndarray:
    """(n, 2) pairs of numbers -> a star for each connected component, as pairs (member, smallest member)."""
    nodes, at = np.unique(pairs, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    far = label != np.arange(len(nodes))
    return np.stack([nodes[far], nodes[label[far]]], axis=1)


class Links:
    """Linked pairs of one shard, reduced to stars whenever there are many."""

    def __init__(self) -> None:
        self.found: list[np.ndarray] = []
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.found.append(np.stack([a, b], axis=1))
            self.held += len(a)
            if self.held > PAIRS:
                self.stars()

    def stars(self) -> np.ndarray:
        kept = spanning(np.concatenate(self.found)) if self.found else np.zeros((0, 2), np.uint64)
        self.found, self.held = [kept], len(kept)
        return kept


def compare(home: np.ndarray, query: np.ndarray, links: Links) -> None:
    """Link all of home to all of query within RADIUS over 64 bits.

    First a few of home are linked to all they reach. Pairs within the largest component so made are
    linked already and are not compared; this keeps a tight group of many fingerprints from being
    compared with itself.
    """
    if len(home) > 4 * LEAF:
        own = Links()
        for v in home[np.linspace(0, len(home) - 1, 16).astype(int)]:
            for side in (home, query):
                near = side[np.bitwise_count(side ^ v) <= RADIUS]
                own.add(np.full(len(near), v), near)
        stars = own.stars()
        links.add(stars[:, 0], stars[:, 1])
        roots, counts = np.unique(stars[:, 1], return_counts=True)
        if len(roots):
            root = roots[np.argmax(counts)]
            giant = np.append(stars[stars[:, 1] == root, 0], root)
            inside, asked = np.isin(home, giant), np.isin(query, giant)
            _compare(home[inside], query[~asked], links)
            home = home[~inside]
    _compare(home, query, links)


def _compare(home: np.ndarray, query: np.ndarray, links: Links) -> None:
    step = max(1, CELLS // max(1, len(query)))
    for k in range(0, len(home), step):
        some = home[k : k + step]
        a, b = np.nonzero(np.bitwise_count(some[:, None] ^ query[None, :]) <= RADIUS)
        links.add(some[a], query[b])


def link_shard(home: np.ndarray, query: np.ndarray, mask: np.uint64) -> np.ndarray:
    """Stars of what links home to query, where linked pairs differ by at most BLOCK_RADIUS under mask or are another block's."""
    links, stack = Links(), [(home, query)]
    while stack:
        h, q = stack.pop()
        if not len(h) or not len(q):
            continue
        if len(h) > LEAF:
            v, median = split(h, mask)
            d, e = distance(h, v, mask), distance(q, v, mask)
            near = d <= median
            if not near.all():
                stack.append((h[near], q[e <= median + BLOCK_RADIUS]))
                stack.append((h[~near], q[e > median - BLOCK_RADIUS]))
                continue
        compare(h, q, links)
    return links.stars()


def linked(fps: DataFrame, n: int) -> DataFrame:
    """fps(fp), distinct, n of them -> a, b (long): edges that connect what RADIUS links."""
    depth = max(0, math.ceil(math.log2(max(1, n) / SHARD_SIZE)))
    wanted = SAMPLE << depth  # in proportion to the shards: about 1 / 256 to 1 / 128 of the fingerprints
    share = min(1.0, wanted / max(1, n))
    sample = fps.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    values = np.sort(sample.toArrow().column("fp").to_numpy()).view(np.uint64) if depth else np.zeros(0, np.uint64)
    masks = [block_mask(k) for k in range(len(BLOCKS))]
    trees = [grow(values, m, depth) for m in masks]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy().view(np.uint64)
            for k, (tree, mask) in enumerate(zip(trees, masks, strict=True)):
                for leaf, at, home in route(tree, own, mask):
                    shard = np.full(len(at), leaf * len(BLOCKS) + k)
                    yield pa.record_batch([pa.array(shard), pa.array(own[at].view(np.int64)), pa.array(home)], ["shard", "fp", "home"])

    def compare_all(shard: pa.Table) -> pa.Table:
        fp, home = shard.column("fp").to_numpy().view(np.uint64), shard.column("home").to_numpy()
        block = int(shard.column("shard")[0].as_py()) % len(BLOCKS)
        stars = link_shard(fp[home], fp, masks[block]).view(np.int64)
        return pa.table({"a": stars[:, 0], "b": stars[:, 1]})

    sent = fps.select("fp").mapInArrow(frugal(send), "shard long, fp long, home boolean")
    return sent.groupBy("shard").applyInArrow(compare_all, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    A row for each row; repeated rows link to each other. Null and empty texts have fingerprint zero
    and link like any other. A null doc_id is never a component's id unless all in it are null.
    """
    rows = materialize(fingerprints(docs, size), "fingerprints")
    total = rows.count()
    groups = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "fp-groups", total)
    distinct = groups.count()
    roots = components(linked(groups, distinct))
    rooted = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "fp-roots", distinct)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    least = materialize(least, "components", distinct)
    named = materialize(join_hot(rooted, least, "root", "members", distinct).select("fp", "n", "component_id"), "fp-components", distinct)
    out = sized(join_hot(rows, named, "fp", "n", total), total)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def firsts(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The rows of docs that are the first of their component, by doc_id; rows with a null one stay.

    Decided by row: where the smallest doc_id is repeated in a component, the smallest fingerprint stays, and
    of equal ones the first by text and the other columns. Only repeated ids are looked up by fingerprint.
    """
    named = near_duplicates(docs, size).where("doc_id is not null").groupBy("doc_id", F.col("fingerprint").alias("_fp")).agg(F.min("component_id").alias("_least"), F.count(F.lit(1)).alias("_n"))
    named = materialize(named, "near-duplicates")
    repeated = materialize(named.groupBy("doc_id").agg(F.sum("_n").alias("_n")).where("_n > 1").select("doc_id"), "repeated-ids")
    single = docs.join(named.where("doc_id <> _least").select("doc_id").unionByName(repeated).distinct(), "doc_id", "left_anti").select(docs.columns)
    if repeated.isEmpty():
        return single
    heads = named.where("doc_id = _least").groupBy("doc_id", "_least").agg(F.min("_fp").alias("_fp")).select("doc_id", "_fp")
    again = docs.join(repeated, "doc_id", "left_semi").select(docs.columns)
    schema = T.StructType([*again.schema.fields, T.StructField("_fp", T.StringType())])
    at = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [f"{fingerprint((x or '').encode(), size):016x}" for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps, pa.string())], [*b.schema.names, "_fp"])

    order = Window.partitionBy("doc_id", "_fp").orderBy("text", *(c for c in docs.columns if c not in ("doc_id", "text")))
    kept = again.mapInArrow(frugal(scan), schema).join(heads, ["doc_id", "_fp"], "left_semi")
    return single.unionByName(kept.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(docs.columns))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
