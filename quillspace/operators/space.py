"""Binding of vectors by order, and nearest neighbours in a space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Rows that windows of words are bound for at a time.
ROWS = 128


class Binding:
    """Placeholder and permutations of one dimension and seed."""

    def __init__(self, dim: int, seed: int = 0):
        draw = np.random.default_rng([seed, dim])
        self.dim = dim
        self.phi = (draw.standard_normal(dim) / np.sqrt(dim)).astype(np.float32)
        self.left, self.right = draw.permutation(dim), draw.permutation(dim)
        self.phi_right = np.fft.rfft(self.phi[self.right])

    def bind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Circular convolution of the permuted rows; not commutative."""
        return self._joined(a, np.fft.rfft(b[..., self.right]))

    def _joined(self, a: np.ndarray, b_right: np.ndarray) -> np.ndarray:
        return np.fft.irfft(np.fft.rfft(np.take(a, self.left, axis=-1)) * b_right, n=self.dim)

    def order(self, x: np.ndarray, longest: int, sizes: np.ndarray | None = None) -> np.ndarray:
        """For each word of sentences of these sizes (default: one), stacked in x: all windows of 2 to
        `longest` words with it, it replaced by the placeholder, bound from the left.

        Windows that start at all words at once grow a word at a time; what stands before the placeholder
        is bound once for all windows that share it.
        """
        n = len(x)
        if sizes is not None and n > ROWS:
            ends = np.cumsum(sizes)  # whole sentences, so few that their rows stay in a core's cache
            cuts = np.unique([0, *(np.flatnonzero(np.diff(ends // ROWS, prepend=0)) + 1), len(sizes)])
            if len(cuts) > 2:
                at = np.concatenate([[0], ends])[cuts]
                return np.concatenate([self.order(x[a:b], longest, sizes[i:j]) for a, b, i, j in zip(at, at[1:], cuts, cuts[1:])])
        out = np.zeros((n, self.dim))
        end = np.repeat(np.cumsum(sizes), sizes) if sizes is not None else np.full(n, n)
        right = np.fft.rfft(np.take(x, self.right, axis=1), axis=1) if n else x
        before, starts = x, np.arange(n)
        for j in range(longest):  # place of the placeholder in the window
            room = starts + j < end[starts]
            if j > 1:
                before = self._joined(before[room], right[starts[room] + j - 1])
            elif j == 1:
                before = x[starts[room]]
            starts = starts[room]
            if not len(starts):
                break
            at, chain = starts, np.broadcast_to(self.phi, (len(starts), self.dim))
            if j:
                chain = self._joined(before, self.phi_right)
                out[at + j] += chain
            for k in range(j + 1, longest):
                room = at + k < end[at]
                at = at[room]
                if not len(at):
                    break
                chain = self._joined(chain[room], right[at + k])
                out[at + j] += chain
        return out


#: Numbers in the queries that are broadcast together, and in the scores that a task makes at a time.
QUERIES, SCORES = 4_000_000, 1_000_000


def nearest(vectors: DataFrame, queries: DataFrame, k: int, label: str = "label", vec: str = "vec") -> DataFrame:
    """query, label, score, rank: the k nearest other rows of vectors for each row of queries.

    Queries are broadcast in blocks of QUERIES numbers; every task makes SCORES scores at a time and keeps
    k for each query, so what moves is queries x tasks x k.
    """
    out, block, context = None, [], vectors.sparkSession.sparkContext
    kind = dict(vectors.dtypes)[label]

    def search(names: list, matrix: np.ndarray) -> DataFrame:
        sent = context.broadcast((names, matrix))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix = sent.value
            place = {n: i for i, n in enumerate(names)}
            best, held = np.full((len(names), k), -np.inf), np.empty((len(names), k), object)
            high = max(1, min(len(names), 2048))
            step = max(1, SCORES // high)
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    b = whole.slice(at, step)
                    rows = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                    size = np.linalg.norm(rows, axis=1)
                    unit = (rows / np.where(size > 0, size, 1.0)[:, None]).T
                    labels = np.empty(b.num_rows, object)
                    labels[:] = b.column(0).to_pylist()
                    own = [(place[x], j) for j, x in enumerate(labels) if x in place]
                    for low in range(0, len(names), high):
                        scores = np.round(matrix[low : low + high] @ unit, 9)
                        for i, j in own:
                            if low <= i < low + high:
                                scores[i - low, j] = -np.inf
                        # labels come in order, so an equal score never takes a held one's place
                        q, j = np.nonzero(scores > best[low : low + high, -1:])
                        if not len(q):
                            continue
                        touched, row = np.unique(q, return_inverse=True)
                        all_q = np.concatenate([np.repeat(np.arange(len(touched)), k), row])
                        value = np.concatenate([best[low + touched].ravel(), scores[q, j]])
                        name = np.concatenate([held[low + touched].ravel(), labels[j]])
                        order = np.lexsort((np.arange(len(value)), -value, all_q))
                        starts = np.searchsorted(all_q[order], np.arange(len(touched)))
                        top = order[(starts[:, None] + np.arange(k)).ravel()]
                        best[low + touched], held[low + touched] = value[top].reshape(-1, k), name[top].reshape(-1, k)
            for low in range(0, len(names), high):
                q, j = np.nonzero(np.isfinite(best[low : low + high]))
                yield pa.record_batch([pa.array([names[low + i] for i in q], types[0]), pa.array(held[low + q, j].tolist(), types[0]), pa.array(best[low + q, j])], ["query", "label", "score"])

        return vectors.select(label, F.col(vec).cast("array<double>")).sortWithinPartitions(label).mapInArrow(scan, f"query {kind}, label {kind}, score double")

    types = [to_arrow_type(vectors.schema[label].dataType)]
    for r in queries.select(label, vec).toLocalIterator():
        block.append((r[0], np.array(r[1], np.float64)))
        if len(block) * len(block[0][1]) >= QUERIES:
            some = search(*_unit_block(block))
            out, block = some if out is None else out.unionByName(some), []
    if block:
        some = search(*_unit_block(block))
        out = some if out is None else out.unionByName(some)
    if out is None:
        return vectors.sparkSession.createDataFrame([], f"query {kind}, label {kind}, score double, rank int")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "label")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _unit_block(block: list[tuple]) -> tuple[list, np.ndarray]:
    rows = np.array([v for _, v in block], np.float64)
    size = np.linalg.norm(rows, axis=1)
    return [n for n, _ in block], rows / np.where(size > 0, size, 1.0)[:, None]

