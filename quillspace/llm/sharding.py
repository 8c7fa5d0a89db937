"""Shards of near equal size by longest-processing-time scheduling.

Groups (rows with equal texts) stay together. Sorted by size, each goes to the least loaded shard.
Groups of one size are alike, so the schedule is made over the histogram of sizes and gives what a heap
over single groups gives. Sizes that differ number at most the root of twice the corpus's bytes. They are
read in order and the plan is written in blocks, so the driver holds one block at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import accumulate, islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, materialize, ranked, shared_path, table, text_or_empty

SHARDS = 16
PLAN = "bytes long, n long, ends array<long>"
#: Sizes whose plan is held at a time.
BLOCK = 50_000
#: Plans of at most so many sizes are broadcast; larger ones are joined.
BROADCAST = 200_000
#: Rows for each hash bucket that numbering a size or a shard is split over, and the least number of those.
SALT_ROWS, SALTS = 500_000, 64


def deal(loads: list[int], n: int, size: int) -> list[int]:
    """How many of n items of one size each shard gets when each goes to the least loaded shard; adds to loads."""
    counts = [0] * len(loads)
    if n > 4 * len(loads):  # raise all to a level first; what the heap would do item by item
        low, high = min(loads), max(loads) + size * n
        while high - low > 1:
            mid = (low + high) // 2
            fits = sum(max(0, (mid - x) // size) for x in loads)
            low, high = (mid, high) if fits <= n else (low, mid)
        counts = [max(0, (low - x) // size) for x in loads]
        while sum(counts) > n:
            counts[max(range(len(loads)), key=lambda i: loads[i] + counts[i] * size)] -= 1
    heap = [(x + k * size, i) for i, (x, k) in enumerate(zip(loads, counts, strict=True))]
    heapq.heapify(heap)
    for _ in range(n - sum(counts)):
        load, i = heap[0]
        counts[i] += 1
        heapq.heapreplace(heap, (load + size, i))
    for i, k in enumerate(counts):
        loads[i] += k * size
    return counts


def schedule(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, int, list[int]]]:
    """(size, groups of it), largest first -> (size, groups, those dealt to the shards up to each one)."""
    loads = [0] * shards
    for size, n in sizes:
        yield size, n, list(accumulate(deal(loads, n, size)))


def written_plan(spark: SparkSession, sizes: DataFrame, shards: int) -> tuple[DataFrame, int]:
    """sizes(bytes, n) -> bytes, n, ends as a written table, and how many rows it has."""
    path, count = shared_path(spark, "shard-plan"), 0
    ordered = ((r["bytes"], r["n"]) for r in sizes.orderBy(F.desc("bytes")).toLocalIterator())
    plan = schedule(ordered, shards)
    while block := list(islice(plan, BLOCK)):
        spark.createDataFrame(block, PLAN).coalesce(1).write.mode("append").parquet(path)
        count += len(block)
    return (spark.read.schema(PLAN).parquet(path) if count else spark.createDataFrame([], PLAN)), count


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard; one row for each row.

    size is the UTF-8 bytes of the text plus 1; a null text is an empty one and in the group of empty
    texts. Rows with one doc_id are rows of their own. An empty table gives no rows. One group larger
    than a shard's even share makes that shard larger: groups are never cut.
    """
    text = text_or_empty()
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("group"))
    rows = materialize(rows, "shard-rows")
    groups = rows.groupBy("group").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
    groups = materialize(groups, "shard-groups")
    totals = groups.agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("groups")).first()
    sizes = materialize(groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")), "shard-sizes")
    ends, count = written_plan(docs.sparkSession, sizes, shards)
    numbered = ranked(groups, ["bytes"], ["group"], "nth", salts(totals["groups"]))
    # shards whose end is at or before nth come before the group's own
    own = F.size(F.filter("ends", lambda e: e <= F.col("nth"))).cast("int").alias("shard")
    if count <= BROADCAST:
        dealt = numbered.join(F.broadcast(ends.drop("n")), "bytes")
    else:
        dealt = join_hot(materialize(numbered, "shard-numbered"), ends, "bytes", "n", totals["groups"])
    placed = materialize(dealt.select("group", "rows", own), "shard-placed")
    joined = join_hot(rows, placed, "group", "rows", totals["rows"] or 0)
    out = ranked(joined, ["shard"], ["doc_id", "group"], "slot", salts(totals["rows"] or 0), bounded=True)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def salts(rows: int) -> int:
    return max(SALTS, -(-rows // SALT_ROWS))


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
