"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are lower-cased and freed of punctuation at their ends. N-grams of one and two words and
skip-grams over one and two words are taken, of the words and (single ones) of their stems, the first
4 and 5 bytes, as inflected forms are many and seldom. A document's features are the distinct hashes of
all of these over its whole text. L1 keeps most weights zero, and the hash space bounds the others, so
the weights are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, table, text_or_empty
from .words import Words, chunks, unique

BITS = 20
#: Labelled rows that the model is fitted on, at most, of each class; taken by a hash of doc_id.
TRAIN_PER_CLASS = 2000
EPOCHS = 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.0
#: Gaps of word pairs: 1 for bigrams, 2 and 3 for skip-grams.
GAPS = (1, 2, 3)
#: A feature must be in so many documents of the sample to get a weight.
LEAST = 3
#: Parts that the training rows are cut in to find the bias: each is scored by a model of the others.
FOLDS = 3
#: The bias makes the share of toxic training rows found, less so many times the share of clean ones flagged, largest.
CLEAN_COST = 3.0
#: One row in so many, by crc32 of the doc_id as text, is held out.
HELD_OUT = 5


def _mix(x: np.ndarray) -> np.ndarray:
    """Hashes to places in the weights."""
    x = x.astype(np.uint32, copy=True)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x >> np.uint32(32 - BITS)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, feature) for each n-gram of whole texts, repeats included."""
    words = Words(texts)
    word, four, five = (words.hashes(most).astype(np.uint32) for most in (1 << 40, 4, 5))
    doc = words.doc
    docs, found = [doc, doc, doc], [word, four, five]
    for g in GAPS:
        same = np.flatnonzero(doc[:-g] == doc[g:]) if len(doc) > g else np.zeros(0, np.int64)
        docs.append(doc[same])
        found.append(word[same] * np.uint32(0x9E3779B1) + word[same + g] * np.uint32(0x85EBCA6B) + np.uint32(g))
    return np.concatenate(docs), _mix(np.concatenate(found))


def distinct(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct features of each text."""
    out = []
    for part in chunks(texts):
        doc, found = features(part)
        keys = unique(doc << BITS | found.astype(np.int64))
        out += np.split(keys & ((1 << BITS) - 1), np.searchsorted(keys, np.arange(1, len(part)) << BITS))
    return out


def train(rows: list[bytes], labels: list[int], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """FTRL-proximal with per-coordinate rates -> weights (float32), bias. No rows: zero weights, bias -inf.

    rows: distinct features of each document as unsigned 32-bit integers.
    """
    size = 1 << BITS
    if not rows:
        return np.zeros(size, np.float32), -np.inf
    seen = np.zeros(size, np.int32)
    for x in rows:
        seen[np.frombuffer(x, "<u4")] += 1
    withs = []
    for k in range(len(rows)):
        at = np.frombuffer(rows[k], "<u4")
        withs.append(np.append(at[seen[at] >= LEAST], np.uint32(size)))
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where((np.abs(zs) <= L1) & (at < size), 0.0, w)

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for k in order.permutation(len(withs)):
            at = withs[k]
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[k]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    return w[:size].astype(np.float32), float(w[size])


def cut_point(rows: list[bytes], labels: list[int]) -> float:
    """What to add to the bias, from training rows alone, each scored by a model that has not seen it; see CLEAN_COST.

    With fewer than FOLDS rows of a class nothing is added.
    """
    truth = np.array(labels)
    if min(np.count_nonzero(truth == y) for y in (0, 1)) < FOLDS:
        return 0.0
    fold, scores = np.zeros(len(truth), int), np.zeros(len(truth))
    for y in (0, 1):
        fold[truth == y] = np.arange(np.count_nonzero(truth == y)) % FOLDS
    for k in range(FOLDS):
        others = np.flatnonzero(fold != k)
        weights, bias = train([rows[i] for i in others], truth[others].tolist())
        for i in np.flatnonzero(fold == k):
            scores[i] = weights[np.frombuffer(rows[i], "<u4")].sum() + bias
    order = np.argsort(-scores, kind="stable")
    toxic = truth[order] == 1
    gain = np.cumsum(toxic) / toxic.sum() - CLEAN_COST * np.cumsum(~toxic) / (~toxic).sum()
    ranked = scores[order]
    gain[:-1][ranked[:-1] == ranked[1:]] = -np.inf  # no cut between equal scores
    best = int(np.argmax(gain))
    after = ranked[best + 1] if best + 1 < len(ranked) else ranked[best] - 1.0
    return -float(ranked[best] + after) / 2


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and bias from docs(doc_id, text) and labels(doc_id, toxic), held-out rows and null labels left out.

    At most TRAIN_PER_CLASS labelled rows of each class are read, so a fixed number reaches the driver.
    Classes are sampled apart, and the bias is moved by cut_point(). A doc_id that is labelled or occurs more
    than once counts once, as toxic if any label says so and with its first text.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picks = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_PER_CLASS) for y in (0, 1)]
    sample = picks[0].unionByName(picks[1])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [x.astype("<u4").tobytes() for x in distinct(b.column(2).to_pylist())]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(got, pa.binary())], ["doc_id", "toxic", "features"])

    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text"))
    found = texts.mapInArrow(frugal(extract), "doc_id long, toxic int, features binary").collect()
    found = sorted((r["doc_id"], r["toxic"], bytes(r["features"])) for r in found)
    truth, rows = [r[1] for r in found], [r[2] for r in found]
    del found
    shift = cut_point(rows, truth)
    weights, bias = train(rows, truth)
    return weights, bias + shift


def _model(docs: DataFrame, weights: np.ndarray, bias: float):
    """Weights as a broadcast that scores texts; its size is bounded by BITS."""
    at = np.flatnonzero(weights)
    model = docs.sparkSession.sparkContext.broadcast((at.astype(np.uint32), weights[at], bias))

    def scorer() -> Callable[[list[str]], np.ndarray]:
        places, values, start = model.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[places] = values

        def scores(texts: list[str]) -> np.ndarray:
            sums = [np.zeros(0)]
            for part in chunks(texts):
                doc, found = features(part)
                heavy = np.flatnonzero(dense[found])
                keys = unique(doc[heavy] << BITS | found[heavy].astype(np.int64))
                sums.append(np.bincount(keys >> BITS, dense[keys & ((1 << BITS) - 1)], len(part)) + start)
            with np.errstate(over="ignore"):
                return 1 / (1 + np.exp(-np.concatenate(sums)))

        return scores

    return scorer


def nontoxic(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """docs without the rows that score 0.5 or more; all columns and other rows stay as they are."""
    names, scorer = [f.name for f in docs.schema], _model(docs, weights, bias)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = scorer()
        for b in batches:
            yield b.filter(pa.array(scores([x or "" for x in b.column(names.index("text")).to_pylist()]) < 0.5))

    return docs.mapInArrow(frugal(keep), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, toxic) -> doc_id, held_out, score, predicted; one row for each row of docs.

    Null and empty texts get the score of the bias alone; without any label all scores are 0. A null
    doc_id is held out.
    """
    weights, bias = fit(docs, labels)
    scorer = _model(docs, weights, bias)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = scorer()
        for b in batches:
            p = scores(b.column(1).to_pylist())
            yield pa.record_batch([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    held_out = (F.coalesce(remainder(F.col("doc_id")), F.lit(0)) == 0).alias("held_out")
    return rows.mapInArrow(frugal(score), "doc_id long, score double, predicted int").select("doc_id", held_out, "score", "predicted")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
