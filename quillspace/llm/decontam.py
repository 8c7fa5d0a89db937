"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Each word n-gram of a test item is a seed of it, however many documents hold it: counts cannot tell a
common phrase from what many edited copies of an item still share. One pass finds seeds in passages.
Where the words around them cannot reach the least score in any order, as around a common phrase, the
item is passed over; else it is aligned with them. Edited and paraphrased copies score by what they
share in order. Documents never move: what is broadcast is a block of items of bounded size, and more
items are taken in more blocks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, table, text_or_empty
from .words import Words, chunks, ngrams

SEED = 4
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least share of an item's own score, and least words in common (or the whole item).
SCORE, WORDS = 0.5, 8
#: Characters of items that are broadcast at a time.
BLOCK_CHARS = 2_000_000


class Items:
    """Test items: their words' hashes, and seeds by hash."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        self.ids = [k for k, _ in rows]
        words = Words([x for _, x in rows])
        hashes = words.hashes()
        ends = np.searchsorted(words.doc, np.arange(len(rows) + 1))
        self.words = [hashes[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.grams: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))  # by size and hash: item, place
        for k, w in enumerate(self.words):
            if len(w):
                n = min(SEED, len(w))
                at, found = ngrams(w, np.zeros(len(w), np.int64), n)
                for p, h in zip(at.tolist(), found.tolist(), strict=True):
                    self.grams[n][h].append((k, p))
        self.grams = {n: dict(x) for n, x in self.grams.items()}


def _hits(texts: list[str], keys: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each n-gram size: the size, documents of words, places of hits, their hashes, all words' hashes."""
    words = Words(texts)
    hashes = words.hashes()
    for n, known in keys.items():
        at, found = ngrams(hashes, words.doc, n)
        if len(known) and len(found):
            table = np.zeros(1 << 16, bool)
            table[(known >> np.uint64(48)).astype(np.int64)] = True
            some = np.flatnonzero(table[(found >> np.uint64(48)).astype(np.int64)])
            some = some[np.isin(found[some], known)]
            yield n, words.doc, at[some], found[some], hashes


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: score, and the first and last place in words (end excluded) that it takes."""

    def run(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
        steps = np.arange(len(b) + 1) * -GAP
        row, best = np.zeros(len(b) + 1, np.int64), (0, 0, 0)
        for i, w in enumerate(a):
            new = np.maximum(0, row + GAP)
            new[1:] = np.maximum(new[1:], row[:-1] + np.where(b == w, MATCH, MISMATCH))
            row = np.maximum.accumulate(new + steps) - steps
            at = int(np.argmax(row))
            if row[at] > best[0]:
                best = (int(row[at]), i + 1, at)
        return best

    score, rows, end = run(item, words)
    if not score:
        return 0, 0, 0
    _, _, back = run(item[:rows][::-1], words[:end][::-1])
    return score, end - back, end


def leaks(texts: list[str], items: Items) -> dict[int, list[tuple[int, float, int, int]]]:
    """For each text with a leak: (place of the item, score, first word, last word excluded), one for each item."""
    found: dict[tuple[int, int], list[int]] = defaultdict(list)
    all_words, docs = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = {n: np.array(sorted(x), np.uint64) for n, x in items.grams.items()}
    for n, docs, at, hashes, all_words in _hits(texts, keys):
        for p, h in zip(at.tolist(), hashes.tolist(), strict=True):
            for item, place in items.grams[n][h]:
                found[int(docs[p]), item].append(p - place)
    out: dict[int, list[tuple[int, float, int, int]]] = defaultdict(list)
    for (doc, item), starts in sorted(found.items()):
        own = items.words[item]
        begin, stop = np.searchsorted(docs, [doc, doc + 1]).tolist()
        best, slack = (0.0, 0, 0), len(own) // 2 + 1
        least = max(SCORE * len(own), min(WORDS, len(own)))
        starts.sort()
        low = 0
        for k in range(1, len(starts) + 1):
            if k < len(starts) and starts[k] - starts[k - 1] <= slack:
                continue
            a, b = max(begin, starts[low] - slack), min(stop, starts[k - 1] + len(own) + slack)
            low = k
            if np.isin(own, all_words[a:b]).sum() < least:
                continue  # a score is at most that of all words in common
            score, first, last = align(own, all_words[a:b])
            same = np.isin(own, all_words[a + first : a + last]).sum()
            if score / (MATCH * len(own)) > best[0] and (same >= WORDS or same == len(own)):
                best = (score / (MATCH * len(own)), a + first - begin, a + last - begin)
        if best[0] >= SCORE:
            out[doc].append((item, *best))
    return out


def blocks(items: DataFrame) -> Iterator[Items]:
    """items(item_id, text) in blocks of at most BLOCK_CHARS characters; null and wordless texts seed nothing."""
    held, chars = [], 0
    for r in items.select("item_id", text_or_empty().alias("text")).orderBy("item_id", "text").toLocalIterator():
        held.append((r["item_id"], r["text"]))
        chars += len(r["text"])
        if chars >= BLOCK_CHARS:
            yield Items(held)
            held, chars = [], 0
    if held:
        yield Items(held)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> doc_id, item_id, score, first_word, last_word: a row for each leak.

    score: the alignment's share of the item's own score. Words are counted from 0 in the whole text,
    words of signs alone left out; last_word is excluded. Documents without a leak have no row; null
    and empty texts have none. A repeated document has its rows once for each repeat. No items give no rows.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType())])
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(items):
        def find(batches: Iterator[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, at, rows = b.column(0).to_pylist(), 0, []
                for part in chunks(b.column(1).to_pylist()):
                    rows += [(ids[at + doc], block.ids[item], score, a, z) for doc, hits in leaks(part, block).items() for item, score, a, z in hits]
                    at += len(part)
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (b.schema.field(0).type, pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "score", "first_word", "last_word"])

        out = out.unionByName(docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(frugal(find), schema))
    return out


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that hold a leak; all columns and other rows stay as they are."""
    names = [f.name for f in docs.schema]
    for block in blocks(items):
        def keep(batches: Iterator[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [x or "" for x in b.column(names.index("text")).to_pylist()]
                clean, at = np.ones(len(texts), bool), 0
                for part in chunks(texts):
                    clean[[at + doc for doc in leaks(part, block)]] = False
                    at += len(part)
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(frugal(keep), docs.schema)
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
