"""Word-vector models by name, and the composition of documents and queries from word vectors.

An environment vector is a pure function of seed and word, so a task makes those it needs and no
dictionary is joined or sent. Memories are sums over sentences: each task adds up what its own sentences
give each word, and only these partial sums are shuffled. Vectors are array<float> columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.shared import spread
from .space import Binding

#: Word vectors of so many bytes at most are broadcast to the counts of terms.
BROADCAST_BYTES = 64_000_000
#: Numbers of partial sums and of environment vectors that a task holds at most.
HELD = 16_000_000
#: What a held vector takes besides its numbers, in numbers.
OVERHEAD = 64
#: Numbers in the sums that a task of a grouped composition holds.
SUMMED = 4_000_000
#: Whole numbers that partial sums are sent as where they hold them.
_WHOLE = (np.int8, np.int16, np.int32)
#: Numbers in the stacked vectors of sentences that are summed at a time.
GROUP = 2_000_000
#: Numbers of vectors that are added up at a time; they stay in a core's cache.
CACHED = 100_000
#: Bytes of folded texts whose terms a task of a build gathers by word at a time.
POSTED = 16_000_000


@dataclass(frozen=True)
class Model:
    """Parameters of a model; environment: gaussian, ternary."""

    name: str
    about: str = field(default="", compare=False)
    dim: int = 1024
    seed: int = 0
    stopwords: str | tuple[str, ...] | None = "english"
    compose_without_stopwords: bool = True
    environment: str = "gaussian"
    nonzeros: int = 30
    context: bool = True
    order: bool = True
    max_ngram: int = 7
    window: int = 2
    fold: bool = False

    def __post_init__(self) -> None:
        if self.environment not in ("gaussian", "ternary"):
            raise ValueError("environment is gaussian or ternary")
        if self.environment == "ternary" and (self.nonzeros % 2 or not 0 < self.nonzeros <= self.dim):
            raise ValueError("nonzeros must be even, over 0 and at most dim")
        if self.fold and self.order:
            raise ValueError("the folding model has no order memory")
        if self.max_ngram < 2:
            raise ValueError("max_ngram must be at least 2")

    @property
    def stop(self) -> frozenset[str]:
        return T.stop_words(self.stopwords)

    @property
    def learns(self) -> bool:
        """Whether words are more than their environments."""
        return self.context or self.order or self.fold

    def config(self) -> dict[str, Any]:
        return {k: v for k, v in asdict(self).items() if k != "about"}


MODELS = {
    m.name: m
    for m in (
        Model("beagle", "Context and n-gram order by bound vectors; the default."),
        Model("beagle-legacy", "Context alone, folded in the order of sentences as the older package did.", stopwords=None, compose_without_stopwords=False, environment="ternary", order=False, fold=True),
        Model("beagle-rp", "Context, and order by rolled vectors.", dim=3000, environment="ternary", nonzeros=60),
        Model("random", "A control without meaning: words are their environment vectors.", context=False, order=False),
    )
}


def make(name: str, **params: Any) -> Model:
    if name.lower() not in MODELS:
        raise ValueError(f"no model {name!r}: {', '.join(MODELS)}")
    known = set(Model.__dataclass_fields__) - {"name", "about"}
    if odd := set(params) - known:
        raise ValueError(f"{name} has no parameter {', '.join(sorted(odd))}; it has {', '.join(sorted(known))}")
    model = replace(MODELS[name.lower()], **params)
    if model.name in ("beagle", "beagle-rp") and not (model.context or model.order):
        raise ValueError("context or order must be on")
    return model


# --- environment ---


def environment(token: str, model: Model) -> np.ndarray:
    """Of a word, float64; from hashes of seed and word alone.

    Ternary: draws 0, 1, … are the first 8 hex digits of md5 of seed#token#draw, modulo dim; the first
    `nonzeros` different places get +1, the second half of them -1.
    """
    if model.environment == "gaussian":
        state = int.from_bytes(hashlib.blake2b(f"{model.seed}#{token}".encode(), digest_size=8).digest(), "little")
        draw = np.random.default_rng(state)
        return (draw.standard_normal(model.dim) / np.sqrt(model.dim)).astype(np.float32).astype(np.float64)
    return environment_rows([token], model)[0]


#: Of MD5: what each step adds and by how much it rotates, the word of the message that it takes, and the first state.
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)
_TURNS = [np.uint32(r[i % 4]) for r in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for i in range(16)]
_TAKEN = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
_STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Messages that are hashed at a time.
HASHED = 16_384


def _md5_heads(blocks: np.ndarray) -> np.ndarray:
    """The first four bytes, as a number, of the MD5 of messages of one padded block each: rows of 64 bytes."""
    words = np.ascontiguousarray(blocks.view("<u4").T)
    a, b, c, d = (np.full(len(blocks), x, np.uint32) for x in _STATE)
    for i in range(64):
        mixed = d ^ (b & (c ^ d)) if i < 16 else c ^ (d & (b ^ c)) if i < 32 else b ^ c ^ d if i < 48 else c ^ (b | ~d)
        mixed += a
        mixed += _SINES[i]
        mixed += words[_TAKEN[i]]
        a, d, c, b = d, c, b, b + ((mixed << _TURNS[i]) | (mixed >> (np.uint32(32) - _TURNS[i])))
    return (a + np.uint32(_STATE[0])).byteswap()


def _drawn(starts: list[bytes], first: int, n: int) -> np.ndarray:
    """For each start, a row of draws first to first + n - 1: the first 8 hex digits of md5 of start and draw.

    Short messages are hashed side by side, as a call for each takes several times as long.
    """
    ends = [b"%d" % draw for draw in range(first, first + n)]
    out, size = np.zeros((len(starts), n), np.uint32), np.fromiter(map(len, starts), np.int64, len(starts))
    for k in np.flatnonzero(size + len(ends[-1]) > 55).tolist():
        out[k] = [int.from_bytes(hashlib.md5(starts[k] + end).digest()[:4]) for end in ends]
    short = np.flatnonzero(size + len(ends[-1]) <= 55)
    step = max(1, HASHED // n)
    for at in range(0, len(short), step):
        some = short[at : at + step]
        begun, row = np.zeros((len(some), 64), np.uint8), np.arange(len(some))
        begun[np.arange(64) < size[some, None]] = np.frombuffer(b"".join([starts[k] for k in some.tolist()]), np.uint8)
        blocks = begun[:, None].repeat(n, axis=1)
        for j, end in enumerate(ends):
            for i, c in enumerate([*end, 0x80]):
                blocks[row, j, size[some] + i] = c
            bits = 8 * (size[some] + len(end))
            blocks[:, j, 56], blocks[:, j, 57] = bits & 255, bits >> 8
        out[some] = _md5_heads(blocks.reshape(-1, 64)).reshape(-1, n)
    return out


def _spots(tokens: list[str], model: Model) -> np.ndarray:
    """Of ternary environments: each token's different places, those of +1 first."""
    starts = [f"{model.seed}#{token}#".encode() for token in tokens]
    spots = _drawn(starts, 0, model.nonzeros).astype(np.int64) % model.dim
    ordered = np.sort(spots, axis=1)
    twice = np.flatnonzero((ordered[:, 1:] == ordered[:, :-1]).any(axis=1))  # a place came twice
    more = np.concatenate([spots[twice], _drawn([starts[k] for k in twice.tolist()], model.nonzeros, model.nonzeros).astype(np.int64) % model.dim], axis=1)
    by_place = np.argsort(more, axis=1, kind="stable")
    again = np.take_along_axis(more, by_place, axis=1)
    new = np.ones(more.shape, bool)
    np.put_along_axis(new, by_place[:, 1:], again[:, 1:] != again[:, :-1], axis=1)
    new &= np.cumsum(new, axis=1) <= model.nonzeros
    full = new.sum(axis=1) == model.nonzeros
    spots[twice[full]] = more[full][new[full]].reshape(-1, model.nonzeros)
    for k, drawn in zip(twice[~full].tolist(), more[~full].tolist(), strict=True):
        places, draw = dict.fromkeys(drawn), 2 * model.nonzeros
        while len(places) < model.nonzeros:
            places[int.from_bytes(hashlib.md5(starts[k] + b"%d" % draw).digest()[:4]) % model.dim] = None
            draw += 1
        spots[k] = list(places)
    return spots


def _signs(model: Model) -> np.ndarray:
    return np.repeat(np.float32([1, -1]), model.nonzeros // 2)


def environment_rows(tokens: list[str], model: Model) -> np.ndarray:
    """environment() of each token, stacked."""
    if model.environment == "gaussian":
        return np.stack([environment(t, model) for t in tokens])
    out = np.zeros((len(tokens), model.dim), np.float32)  # sums of it are whole numbers
    rows = np.repeat(np.arange(len(tokens)), model.nonzeros)
    out[rows, _spots(tokens, model).ravel()] = np.tile(_signs(model), len(tokens))
    return out


class Environment:
    """Vectors of words in one array, made when first asked for; emptied when they are many."""

    def __init__(self, model: Model):
        self.model = model
        self._places: dict[str, int] = {}
        self._held: np.ndarray | None = None

    def rows(self, tokens: list[str]) -> np.ndarray:
        """Vectors of tokens, stacked; those not held are made together."""
        places = list(map(self._places.get, tokens))
        if None in places:
            new = list(dict.fromkeys(t for t, p in zip(tokens, places, strict=True) if p is None))
            if (len(self._places) + len(new)) * (self.model.dim + OVERHEAD) > HELD:
                self._places.clear()
                new = list(dict.fromkeys(tokens))
            made, at = environment_rows(new, self.model), len(self._places)
            if self._held is None or at + len(new) > len(self._held):
                grown = np.empty((max(64, 2 * at, at + len(new)), self.model.dim), made.dtype)
                if at:
                    grown[:at] = self._held[:at]
                self._held = grown
            self._held[at : at + len(new)] = made
            self._places.update(zip(new, range(at, at + len(new)), strict=True))
            places = list(map(self._places.__getitem__, tokens))
        if self._held is None:
            return np.zeros((0, self.model.dim))
        return self._held[np.array(places, np.int64)]


# --- memories ---


def contexts(x: np.ndarray, keep: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each word of sentences of these sizes, stacked in x, the sum of the other kept words' vectors of its sentence."""
    kept = x * keep[:, None].astype(x.dtype)
    return np.repeat(np.add.reduceat(kept, np.cumsum(sizes) - sizes, axis=0), sizes, axis=0) - kept


def rolled_order(ids: np.ndarray, sizes: np.ndarray, env: np.ndarray, window: int) -> np.ndarray:
    """For each row of env, over all places of its word in sentences of these sizes: its neighbours' vectors, rolled by their distance.

    Pairs of words are counted first, and only the places of a vector that are not zero are added.
    """
    n, dim = env.shape
    row, place = np.nonzero(env)
    value, first = env[row, place], np.searchsorted(row, np.arange(n + 1))
    end = np.repeat(np.cumsum(sizes), sizes)
    out = np.zeros(n * dim)
    for k in range(1, window + 1):
        at = np.flatnonzero(np.arange(len(ids)) + k < end)
        for word, near, shift in ((ids[at], ids[at + k], k), (ids[at + k], ids[at], -k)):
            pairs, times = np.unique(word * n + near, return_counts=True)
            word, near = pairs // n, pairs % n
            length = first[near + 1] - first[near]
            spot = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(first[near], length)
            out += np.bincount(np.repeat(word, length) * dim + (place[spot] + shift) % dim, value[spot] * np.repeat(times, length), n * dim)
    return out.reshape(n, dim)


def memories(sentences: list[list[str]], env: Environment, model: Model, binding: Binding | None) -> Iterator[tuple[str, int, np.ndarray]]:
    """(word, kind, sum over the sentences' places of the word); kind is 0 for context, 1 for order."""
    sizes = np.array([len(s) for s in sentences])
    known: dict[str, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for s in sentences for w in s])
    matrix = env.rows(list(known))
    order = np.argsort(ids, kind="stable")
    bounds = np.searchsorted(ids[order], np.arange(len(known)))
    by_word = lambda rows: np.add.reduceat(rows[order], bounds, axis=0)
    if model.context:
        stop = model.stop
        keep = np.array([w not in stop for w in known])
        for w, v in zip(known, by_word(contexts(matrix[ids], keep[ids], sizes)), strict=True):
            yield w, 0, v
    if model.order:
        made = by_word(binding.order(matrix[ids], model.max_ngram, sizes)) if binding else rolled_order(ids, sizes, matrix, model.window)
        for w, v in zip(known, made, strict=True):
            yield w, 1, v


def memory_sums(sentences: DataFrame, model: Model) -> DataFrame:
    """sentences(words) -> token, kind (0 context, 1 order), vec: sums over all sentences of two words or more."""
    return _added_up(_partial_sums(sentences, model), model.dim, False)


def _partial_sums(sentences: DataFrame, model: Model) -> DataFrame:
    """memory_sums(), a row or more for each token and kind: what tasks add up."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        env = Environment(model)
        binding = Binding(model.dim, model.seed) if model.order and model.name == "beagle" else None
        places: dict[tuple[str, int], int] = {}
        most = HELD // 2 // (model.dim + OVERHEAD) + 1
        sums = np.zeros((64, model.dim))
        group, held = [], 0
        step = max(1, GROUP // model.dim)

        def add() -> None:
            nonlocal sums
            for w, kind, v in memories(group, env, model, binding):
                at = places.setdefault((w, kind), len(places))
                if at == len(sums):
                    sums = np.concatenate([sums, np.zeros_like(sums)])
                sums[at] += v

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sums
            names = list(places)
            for k in range(0, len(names), step):
                some = names[k : k + step]
                yield pa.record_batch([pa.array([t for t, _ in some], pa.string()), pa.array([x for _, x in some], pa.int8()), _packed(sums[k : k + len(some)])], ["token", "kind", "vec"])
            places.clear()
            sums = np.zeros((64, model.dim))

        for b in batches:
            for k in range(0, b.num_rows, 1000):
                for words in b.column(0).slice(k, 1000).to_pylist():
                    group.append(words)
                    held += len(words)
                    if held * (model.dim + OVERHEAD) >= GROUP:
                        add()
                        group, held = [], 0
                        if len(places) > most:
                            yield from flush()
        if group:
            add()
        yield from flush()

    found = spread(sentences.where(F.size("words") >= 2).select("words")).mapInArrow(scan, "token string, kind byte, vec binary")
    return found


def _packed(rows: np.ndarray) -> pa.Array:
    """Each row's bytes in the narrowest numbers that hold it exactly; how many bytes there are tells which.

    Sums of ternary vectors are whole and mostly small, and are an eighth of their size then.
    """
    top, whole = np.abs(rows).max(axis=1), (rows == np.rint(rows)).all(axis=1)
    kinds = [next((kind for kind in _WHOLE if w and t <= np.iinfo(kind).max), np.float64) for t, w in zip(top.tolist(), whole.tolist(), strict=True)]
    return pa.array([row.astype(kind).tobytes() for row, kind in zip(rows, kinds, strict=True)], pa.binary())


def _unpacked(column: pa.Array, dim: int) -> np.ndarray:
    out, kinds = np.empty((len(column), dim)), {np.dtype(kind).itemsize: kind for kind in (*_WHOLE, np.float64)}
    for k, raw in enumerate(column.to_pylist()):
        out[k] = np.frombuffer(raw, kinds[len(raw) // dim])
    return out


def _added_up(parts: DataFrame, dim: int, units: bool, number: str = "double") -> DataFrame:
    """parts(token, kind, vec packed) -> token, kind, vec: their sums; units: token, vec, the sum of a word's kinds at unit length.

    Rows come by token, and those of the last one are carried on.
    """

    def rows(tokens: pa.Array, kinds: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        if not units:
            return pa.record_batch([tokens, pa.array(kinds), _vectors(sums)], ["token", "kind", "vec"])
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        first = _runs(tokens.dictionary_encode().indices.to_numpy())
        return pa.record_batch([tokens.take(pa.array(first)), _vectors(np.add.reduceat(sums / np.where(size > 0, size, 1.0), first, axis=0).astype(np.float32 if number == "float" else np.float64))], ["token", "vec"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, kinds, sums = pa.array([], pa.string()), np.zeros(0, np.int8), np.zeros((0, dim))
        step = max(1, GROUP // dim)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                tokens = pa.concat_arrays([tokens, b.column(0)])
                kinds = np.concatenate([kinds, b.column(1).to_numpy()])
                sums = np.concatenate([sums, _unpacked(b.column(2), dim)])
                codes = tokens.dictionary_encode().indices.to_numpy()
                first = _runs(codes.astype(np.int64) * 2 + kinds)
                tokens, kinds, sums = tokens.take(pa.array(first)), kinds[first], np.add.reduceat(sums, first, axis=0)
                last = int(_runs(codes[first])[-1])
                if last:
                    yield rows(tokens.slice(0, last), kinds[:last], sums[:last])
                    tokens, kinds, sums = tokens.slice(last), kinds[last:], sums[last:].copy()
        if len(tokens):
            yield rows(tokens, kinds, sums)

    ordered = parts.repartition("token").sortWithinPartitions("token", "kind")
    return ordered.mapInArrow(scan, f"token string, vec array<{number}>" if units else "token string, kind byte, vec array<double>")


def _folded(sentences: DataFrame, model: Model) -> DataFrame:
    """The folding model: token, vec of words of sentences(doc, sent, words) with two words or more.

    A word's memory starts as its environment; each of its sentences in turn is added, divided by |its
    largest value|, and the memory is divided by |its own|. That cannot be taken apart, but each word's
    fold needs no other's: sentences stream past a word in order and one vector is held.
    """

    def scale(v: np.ndarray) -> np.ndarray:
        top = abs(v.max())
        return v / (top if top else 1.0)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        env, token, memory = Environment(model), None, None
        for b in batches:
            done: list[tuple[str, np.ndarray]] = []
            for word, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if word != token:
                    if token is not None:
                        done.append((token, memory))
                    token, memory = word, env.rows([word])[0]
                x = env.rows(words)
                memory = scale(memory + scale(x.sum(axis=0) - x[words.index(word)]))
            yield pa.record_batch([pa.array([t for t, _ in done], pa.string()), pa.array([v.tolist() for _, v in done], pa.list_(pa.float64()))], ["token", "vec"])
        if token is not None:
            yield pa.record_batch([pa.array([token]), pa.array([memory.tolist()], pa.list_(pa.float64()))], ["token", "vec"])

    each = sentences.where(F.size("words") >= 2).select("doc", "sent", "words", F.posexplode("words").alias("_at", "token"))
    ordered = each.repartition("token").sortWithinPartitions("token", "doc", "sent", "_at")
    return ordered.select("token", "words").mapInArrow(fold, "token string, vec array<double>")


def environments(words: DataFrame, model: Model) -> DataFrame:
    """words(token, ...), distinct -> these columns and vec."""

    def make_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, GROUP // model.dim)
        for b in batches:
            for k in range(0, b.num_rows, step):
                some = b.slice(k, step)
                made = _vectors(environment_rows(some.column("token").to_pylist(), model).astype(np.float64))
                yield pa.record_batch([*some.columns, made], [*some.schema.names, "vec"])

    return words.mapInArrow(make_all, ", ".join(f"`{name}` {kind}" for name, kind in words.dtypes) + ", vec array<double>")


def word_vectors(sentences: DataFrame, vocab: DataFrame, model: Model, number: str = "float") -> DataFrame:
    """sentences(doc, sent, words), vocab(token) -> token, vec (array of `number`): a row for each word of vocab.

    Memories are brought to unit length and added; a word of one-word sentences alone has a zero vector.
    Rows of the folding model start as environments, so such words keep theirs.
    """
    kind = f"array<{number}>"
    if model.fold:
        found = _folded(sentences, model)
        rest = vocab.select("token").join(found.select("token"), "token", "left_anti")
        return found.unionByName(environments(rest.select("token"), model)).select("token", F.col("vec").cast(kind).alias("vec"))
    if not model.learns:
        return environments(vocab.select("token"), model).select("token", F.col("vec").cast(kind).alias("vec"))
    added = _added_up(_partial_sums(sentences, model), model.dim, True, number)  # a zero vector stays zero
    zero = F.array_repeat(F.lit(0.0).cast(number), model.dim)
    return vocab.select("token").join(added, "token", "left").select("token", F.coalesce("vec", zero).alias("vec"))


# --- composition ---


def without_stop_words(counts: DataFrame, model: Model, key: str) -> DataFrame:
    """counts(key, token, tf) without stop words, but with all of a document that has no other word."""
    if not model.compose_without_stopwords or not model.stop:
        return counts
    stop = F.col("token").isin(sorted(model.stop))
    return counts.withColumn("_rest", F.max((~stop).cast("int")).over(Window.partitionBy(key))).where((F.col("_rest") == 0) | ~stop).drop("_rest")


def composed(items: DataFrame, counts: DataFrame, words: DataFrame | None, model: Model, key: str) -> DataFrame:
    """items(key, ...) with vec: the sum of word vectors with multiplicity; zero without a known word.

    words None: every word is known and its vector is its environment, made in the task that adds it up.
    Else vectors of up to BROADCAST_BYTES are broadcast; more are sent to groups of items, once to each
    group that has the word, so what moves grows with the counts and not with counts times words.
    """
    kept = without_stop_words(counts, model, key).select(key, "token", "tf").where(F.col(key).isNotNull())
    if words is None:
        if model.learns:
            raise ValueError(f"words of {model.name} are more than their environments")
        sums = _of_environments(kept, model, key)
    elif 8 * words.count() * model.dim <= BROADCAST_BYTES:
        vectors = words.select("token", array_to_vector(F.col("vec").cast("array<double>")).alias("_v"))
        found = kept.repartition(key).join(F.broadcast(vectors), "token").groupBy(key).agg(Summarizer.sum(F.col("_v"), F.col("tf").cast("double")).alias("_v"))
        sums = found.select(key, vector_to_array("_v").alias("vec"))
    else:
        sums = _in_groups(kept, words, model, key, -(-items.count() * model.dim // SUMMED))
    return _with_sums(items, sums, model, key)


def _with_sums(items: DataFrame, sums: DataFrame, model: Model, key: str) -> DataFrame:
    zero = F.array_repeat(F.lit(0.0), model.dim)
    return items.join(sums.select(key, "vec"), key, "left").withColumn("vec", F.coalesce("vec", zero).cast("array<float>"))


def _row_sums(names: list[str], codes: np.ndarray, owner: np.ndarray, tfs: np.ndarray, n: int, env: Environment) -> np.ndarray:
    """Sums of environments of n rows; owner: each code's row, in order; codes are of the distinct names."""
    model, sums = env.model, np.zeros((n, env.model.dim))
    stop, fine = model.stop if model.compose_without_stopwords else frozenset(), max(1, CACHED // model.dim)
    if stop:
        stops = np.array([t in stop for t in names], bool)[codes]
        rest = np.zeros(n, bool)  # rows with another word
        rest[owner[~stops]] = True
        shown = ~stops | ~rest[owner]
        codes, owner, tfs = codes[shown], owner[shown], tfs[shown]
    if model.environment == "ternary" and names and len(names) * model.nonzeros <= HELD // 4:
        spots, signs, fine = _spots(names, model), _signs(model).astype(np.float64), max(1, CACHED // model.nonzeros)
        for k in range(0, len(codes), fine):  # only places that are not zero are added
            some, of = codes[k : k + fine], owner[k : k + fine]
            low, high = int(of[0]), int(of[-1]) + 1
            flat = ((of - low) * model.dim)[:, None] + spots[some]
            sums[low:high] += np.bincount(flat.ravel(), (tfs[k : k + fine, None] * signs).ravel(), (high - low) * model.dim).reshape(-1, model.dim)
        return sums
    few = len(names) * model.dim <= HELD // 4  # else what is made is held for the next piece
    matrix, step = environment_rows(names, model) if few and names else None, len(codes) if few else max(1, GROUP // model.dim)
    for k in range(0, len(codes), max(1, step)):
        some, of, times = codes[k : k + step], owner[k : k + step], tfs[k : k + step].astype(np.float64)
        if not few:
            used, some = np.unique(some, return_inverse=True)
            matrix = env.rows([names[x] for x in used.tolist()])
        for j in range(0, len(some), fine):
            part = matrix[some[j : j + fine]] * times[j : j + fine, None]
            first = _runs(of[j : j + fine])
            sums[of[j : j + fine][first]] += np.add.reduceat(part, first, axis=0)
    return sums


#: Columns of indexed() besides the document's.
INDEXED = "unit int, len long, tokens array<string>, tfs array<int>, vec array<float>, token string, docs array<long>, counts array<int>, n long, first long, place int"


def indexed(docs: DataFrame, key: str, units: Column, parted: Column, model: Model, mode: str = "unicode") -> DataFrame:
    """All that a build takes from its texts, in one pass: rows of two kinds, each null where the other has values.

    A row for each document of docs(key long, id) (unit null) and, where parted, for each of its units(array<string>):
    key, id, unit, len, and vec of a model whose words are their environments, else tokens and tfs. And a row for each
    word of POSTED bytes or so: token, n, first (document), place (of the word there, in the order of first occurrence) and,
    if more documents have it, docs (ascending) and counts.

    What a task holds is bounded: an Arrow batch of texts, POSTED bytes and one document more with their terms, GROUP numbers of sums, HELD of environments.
    """
    if mode not in T.MODES:
        raise ValueError(f"text mode is one of {T.MODES}")
    kinds = (("unit", pa.int32()), ("len", pa.int64()), ("tokens", pa.list_(pa.string())), ("tfs", pa.list_(pa.int32())), ("vec", pa.list_(pa.float32())), ("token", pa.string()), ("docs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("n", pa.int64()), ("first", pa.int64()), ("place", pa.int32()))
    schema = pa.schema([(key, pa.int64()), ("id", pa.string()), *kinds])

    def filled(columns: dict[str, pa.Array]) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.record_batch([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def lists(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        env, most = Environment(model), max(1, GROUP // model.dim)
        at, names, unit, texts, size = [], [], [], [], 0

        def made() -> Iterator[pa.RecordBatch]:
            """Of the texts that are gathered; a term is its word's number here, and terms are counted by one sort."""
            n, row, coded = len(at), *T.cut(texts)
            codes, tokens = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            if mode == "unicode":
                bare = np.fromiter(map(str.isdecimal, tokens), bool, len(tokens))
                if bare.any():
                    shown = ~bare[codes]
                    row, codes = row[shown], codes[shown]
            by_word = np.sort((codes.astype(np.int64) << 32) | np.arange(len(codes)))  # by word, then place in the text
            place, codes = by_word & 0xFFFFFFFF, by_word >> 32
            head = _runs(codes * n + row[place])
            times = np.diff(np.append(head, len(codes))).astype(np.int32)
            codes, place = codes[head], place[head]
            of = row[place]
            by_text = np.sort((place << 32) | np.arange(len(place))) & 0xFFFFFFFF  # in the order of first occurrence
            owner, cuts = of[by_text], np.searchsorted(of[by_text], np.arange(n + 1))
            place[by_text] = np.arange(len(place)) - cuts[owner]
            keys = np.array(at, np.int64)
            if model.learns:
                own = {"tokens": lists(cuts, coded.dictionary.take(pa.array(codes[by_text]))), "tfs": lists(cuts, pa.array(times[by_text]))}
            else:
                own = {"vec": _vectors(_row_sums(tokens, codes[by_text], owner, times[by_text], n, env).astype(np.float32))}
            yield filled({key: pa.array(keys), "id": pa.array(names, pa.string()), "unit": pa.array(unit, pa.int32()), "len": pa.array(np.bincount(row, minlength=n)), **own})
            whole = np.array([u is None for u in unit])
            if not whole.all():  # each word of a unit is one of its document, but that may come in the next piece
                shown = np.flatnonzero(whole[of])
                codes, of, times, place = codes[shown], of[shown], times[shown], place[shown]
            if (np.diff(keys) < 0).any():
                order = np.lexsort((keys[of], codes))
                codes, of, times, place = codes[order], of[order], times[order], place[order]
            head, doc = _runs(codes), keys[of]
            total, first = np.concatenate([[0], np.cumsum(times, dtype=np.int64)]), np.append(head, len(codes))
            posted = {"token": coded.dictionary.take(pa.array(codes[head])), "n": pa.array(np.diff(total[first])), "first": pa.array(doc[head]), "place": pa.array(place[head].astype(np.int32))}
            held = np.diff(first)  # most words are in one document only, and need no lists
            many = np.repeat(held > 1, held)
            ends_of = np.concatenate([[0], np.cumsum(np.where(held > 1, held, 0))])
            no = pa.array(held == 1)
            posted |= {name: pa.ListArray.from_arrays(pa.array(ends_of, pa.int32()), pa.array(x[many]), mask=no) for name, x in (("docs", doc), ("counts", times))}
            if len(head):
                yield filled(posted)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            yield from made()
            for column in (at, names, unit, texts):
                column.clear()
            size = 0

        for b in batches:
            for k, doc, name, parts in zip(range(b.num_rows), b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                found = [T.spaced(text or "", mode) for text in b.column(2)[k].as_py() or []]
                for n, text in [*(enumerate(found) if parts else ()), (None, b" ".join(found))]:
                    at.append(doc)
                    names.append(name)
                    unit.append(n)
                    texts.append(text)
                    size += len(text)
                    if size >= POSTED or len(at) >= most:
                        yield from flush()
        if at:
            yield from flush()

    read = docs.select(F.col(key).cast("long"), "id", units.alias("_units"), parted.alias("_parted"))
    return read.mapInArrow(scan, f"{key} long, id string, {INDEXED}")


def composed_of_rows(items: DataFrame, rows: DataFrame, model: Model, key: str) -> DataFrame:
    """composed() of a model whose words are their environments, from rows(key, tokens, tfs), one for a key at most.

    A row is summed where it is read; counts are not moved.
    """
    if model.learns:
        raise ValueError(f"words of {model.name} are more than their environments")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        env = Environment(model)
        step = max(1, GROUP // model.dim)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                owner = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy())
                coded = b.column(1).flatten().dictionary_encode()
                sums = _row_sums(coded.dictionary.to_pylist(), coded.indices.to_numpy(), owner, b.column(2).flatten().to_numpy(), b.num_rows, env)
                yield pa.record_batch([b.column(0), _vectors(sums)], [key, "vec"])

    made = rows.select(key, "tokens", "tfs").where(F.col(key).isNotNull())
    return _with_sums(items, made.mapInArrow(scan, f"{key} {dict(rows.dtypes)[key]}, vec array<double>"), model, key)


def _vectors(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _runs(codes: np.ndarray) -> np.ndarray:
    """Where runs of equal codes start."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1]]))


def _of_environments(counts: DataFrame, model: Model, key: str) -> DataFrame:
    """counts(key, token, tf) -> key, vec: sums of environments; rows come by key and one sum is carried on."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        env, owner, carried = Environment(model), None, None
        step = max(1, GROUP // model.dim)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                tokens, keys = b.column(1).dictionary_encode(), b.column(0)
                matrix = env.rows(tokens.dictionary.to_pylist())
                rows = matrix[tokens.indices.to_numpy()] * b.column(2).to_numpy()[:, None].astype(np.float64)
                first = _runs(keys.dictionary_encode().indices.to_numpy())
                sums = np.add.reduceat(rows, first, axis=0)
                keys = keys.take(pa.array(first))
                if owner is not None and owner.equals(keys[0]):
                    sums[0] += carried
                elif owner is not None:
                    yield pa.record_batch([pa.array([owner.as_py()], keys.type), _vectors(carried[None])], [key, "vec"])
                owner, carried = keys[-1], sums[-1].copy()
                if len(keys) > 1:
                    yield pa.record_batch([keys.slice(0, len(keys) - 1), _vectors(sums[:-1])], [key, "vec"])
        if owner is not None:
            yield pa.record_batch([pa.array([owner.as_py()], owner.type), _vectors(carried[None])], [key, "vec"])

    return counts.repartition(key).sortWithinPartitions(key).mapInArrow(scan, f"{key} {dict(counts.dtypes)[key]}, vec array<double>")


def _in_groups(counts: DataFrame, words: DataFrame, model: Model, key: str, groups: int) -> DataFrame:
    """counts(key, token, tf), words(token, vec) -> key, vec for keys with a known word, in so many groups of keys.

    A group's rows come by word, its vector first; a task holds the sums of one group.
    """
    kind = dict(counts.dtypes)[key]
    counts = counts.select(F.pmod(F.xxhash64(key), F.lit(max(1, groups))).alias("_g"), "token", key, F.col("tf").cast("double").alias("tf"))
    wanted = counts.select("_g", "token").distinct().join(words.select("token", F.col("vec").cast("array<float>").alias("vec")), "token")
    given = wanted.select("_g", "token", F.lit(None).cast(kind).alias(key), F.lit(0.0).alias("tf"), "vec")
    rows = given.unionByName(counts.withColumn("vec", F.lit(None).cast("array<float>")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, word, vector = None, None, np.zeros(model.dim)
        places: dict[Any, int] = {}
        sums = np.zeros((0, model.dim))
        step = max(1, GROUP // model.dim)

        def done() -> Iterator[pa.RecordBatch]:
            names = list(places)
            for k in range(0, len(names), step):
                some = names[k : k + step]
                yield pa.record_batch([pa.array(some, types[key]), _vectors(sums[k : k + len(some)])], [key, "vec"])
            places.clear()

        types: dict[str, pa.DataType] = {}
        for whole in batches:
            types = {key: whole.schema.field(key).type}
            cuts = sorted({*range(0, whole.num_rows, step), *_runs(whole.column("_g").to_numpy()).tolist()}) if whole.num_rows else []
            for at, to in zip(cuts, [*cuts[1:], whole.num_rows], strict=True):
                b = whole.slice(at, to - at)
                if b.column("_g")[0].as_py() != group:
                    yield from done()
                    group, word = b.column("_g")[0].as_py(), None
                    sums = np.zeros((64, model.dim))
                tokens = np.array(b.column("token").to_pylist(), object)
                has = b.column("vec").is_valid().to_numpy(zero_copy_only=False)
                own = b.column("vec").drop_null().flatten().to_numpy().reshape(-1, model.dim)
                vectors, names = np.concatenate([vector[None], own]), np.concatenate([np.array([word], object), tokens[has]])
                of = np.cumsum(has)
                hit = ~has & (names[of] == tokens)  # a word without a vector meets another word's
                vector, word = vectors[-1].copy(), names[-1]
                if not hit.any():
                    continue
                found = np.array([places.setdefault(x, len(places)) for x in b.column(key).filter(pa.array(hit)).to_pylist()])
                if len(places) > len(sums):
                    sums = np.concatenate([sums, np.zeros((max(len(sums), len(places) - len(sums)), model.dim))])
                order = np.argsort(found, kind="stable")
                found = found[order]
                part = vectors[of[hit][order]] * b.column("tf").to_numpy()[hit][order][:, None]
                first = _runs(found)
                sums[found[first]] += np.add.reduceat(part, first, axis=0)
        yield from done()

    ordered = rows.repartition("_g").sortWithinPartitions("_g", "token", F.col("vec").isNull())
    return ordered.select("_g", "token", key, "tf", "vec").mapInArrow(scan, f"{key} {kind}, vec array<double>")


def query_terms(tokens: list[str], known: Callable[[str], bool], model: Model) -> list[str]:
    """Distinct known words in the query's order, without stop words unless nothing else is left."""
    words = [t for t in dict.fromkeys(tokens) if known(t)]
    if not model.compose_without_stopwords:
        return words
    return [t for t in words if t not in model.stop] or words
