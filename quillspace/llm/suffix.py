"""Removal of repeated byte strings, by suffix arrays over shards of the corpus.

Every window of `window` bytes has an anchor: the place of its smallest hash of ANCHOR bytes. Equal
windows have equal anchors, so only windows around equal anchor strings need comparing. Windows that
share an anchor make a segment of at most 2 * window - ANCHOR bytes.

1. Segments are dealt by anchor. Where two are equal by two 64-bit hashes (of the anchor string and of
   the segment), all windows of the later one are repeats. Only where different segments share an anchor
   are their bytes needed.
2. Those bytes are fetched, dealt by anchor again, and put in suffix order by induced sorting, a shard
   of whole anchor groups at a time. Neighbours with a common prefix of `window` bytes are equal
   windows; all but the earliest are repeats. An anchor with over GROUP different segments, as at the
   ends of a very common passage, would be one task's work; its windows are dealt one by one instead, by
   128 bits of hash, after those that are equal within a batch are reduced to the earliest.
3. Each document's repeats are cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import numbered
from .common import frugal, materialize, shuffle_parts, table, text_or_empty
from .sais import common_prefixes, suffix_array

WINDOW = 100
#: Bytes whose hash anchors a window; at most the window.
ANCHOR = 40
#: Bytes of documents whose segments are made at a time.
CHUNK = 2_000_000
#: Bytes of anchor groups sorted at a time; at most GROUP segments are in one group.
SHARD = 500_000
#: Different segments of an anchor that are sorted together; those of larger groups are compared window by window.
GROUP = 256
#: Bytes of text for each partition that segments are dealt to, at most.
PART_BYTES = 64_000_000
#: Windows in a span at most, as its length has 16 bits.
RUN = 60_000
_BASE = 0x9E3779B97F4A7C15

#: anchor: hash of the anchor string; body: hash of the segment; no: document; at: the anchor's place;
#: left: bytes before it; more: windows after the segment's first.
SEGMENT = np.dtype([("anchor", "<u8"), ("body", "<u8"), ("no", "<i8"), ("at", "<u4"), ("left", "u1"), ("more", "u1")])
_NARROW = np.dtype([("anchor", "<u8"), ("body", "<u8"), ("nth", "<u4"), ("at", "<u4"), ("left", "u1"), ("more", "u1")])
_POWERS: list[np.ndarray] = []
#: Columns beside those of documents, which may have any names.
NO, SPANS = "_suffix_dedup_no", "_suffix_dedup_spans"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        base = np.full(n, _BASE, np.uint64)
        back = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        base[0] = back[0] = 1
        _POWERS[:] = [np.cumprod(base, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)]
    return _POWERS[0][:n], _POWERS[1][:n]


def forget() -> None:
    _POWERS.clear()


def segments(texts: list[bytes], nos: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> np.ndarray:
    """Of whole documents numbered nos; windows never cross documents. Shorter ones have none."""
    import xxhash

    raw = b"".join(texts)
    n = len(raw)
    if n < window:
        return np.zeros(0, SEGMENT)
    power, back = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64, out=sums[1:])
    grams = (sums[anchor:] - sums[:-anchor]) * back[: n - anchor + 1]
    del sums
    grams = (grams ^ (grams >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(27)
    # hash above, place below: the smallest is the leftmost of the smallest hashes
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    covered, width = 1, window - anchor + 1
    while covered < width:
        step = min(covered, width - covered)
        least = np.minimum(least[:-step], least[step:])
        covered += step
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lengths = np.array([len(x) for x in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    flags = np.zeros(n + 1, np.int32)
    some = lengths >= window
    np.add.at(flags, starts[some], 1)
    np.add.at(flags, starts[some] + lengths[some] - window + 1, -1)
    valid = np.flatnonzero(np.cumsum(flags[: len(at)]) > 0)
    if not len(valid):
        return np.zeros(0, SEGMENT)
    own = at[valid]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (valid[1:] != valid[:-1] + 1)]))
    low, high = valid[new], valid[np.append(new[1:], len(valid)) - 1]
    out = np.zeros(len(low), SEGMENT)
    place = own[new]
    doc = np.searchsorted(starts, place, side="right") - 1
    of = xxhash.xxh3_64_intdigest
    out["anchor"], out["no"], out["at"] = grams[place], nos[doc], place - starts[doc]
    out["body"] = np.fromiter((of(raw[a:b]) for a, b in zip(low.tolist(), (high + window).tolist(), strict=True)), np.uint64, len(low))
    out["left"], out["more"] = place - low, high - low
    return out


def repeats(found: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Segments -> the equal ones but the earliest of each, and the others."""
    order = np.lexsort((found["at"], found["no"], found["body"], found["anchor"]))
    found = found[order]
    same = np.zeros(len(found), bool)
    same[1:] = (found["anchor"][1:] == found["anchor"][:-1]) & (found["body"][1:] == found["body"][:-1])
    return found[same], found[~same]


def _cut_spans(found: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """no and packed start and length (start << 16 | length) of segments."""
    start = found["at"].astype(np.int64) - found["left"]
    return found["no"], start << 16 | (found["more"].astype(np.int64) + window)


def repeated_windows(parts: list[bytes], starts: np.ndarray, nos: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Segments' bytes, where they start in which document -> no and packed spans of windows that also start earlier."""
    text = b"\0".join(parts)
    lengths = np.array([len(x) for x in parts], np.int64)
    begins = np.cumsum(lengths + 1) - lengths - 1
    letters = np.append(np.frombuffer(text, np.uint8).astype(np.int64) + 2, 0)
    letters[begins[1:] - 1] = 1
    sa = suffix_array(letters, 258)[1:]
    # a window must not reach over its segment's end
    room = np.zeros(len(text), bool)
    for a, n in zip(begins.tolist(), lengths.tolist(), strict=True):
        room[a : a + n - window + 1] = True
    full = (common_prefixes(text, sa, window) == window)[sa] & room[sa]
    full[1:] &= room[sa[:-1]]
    group = np.cumsum(~full)
    kept = np.flatnonzero(full | np.append(full[1:], False))
    places, group = sa[kept], group[kept]
    part = np.searchsorted(begins, places, side="right") - 1
    no, at = nos[part], starts[part] + places - begins[part]
    order = np.lexsort((at, no, group))
    no, at, group = no[order], at[order], group[order]
    first = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
    return runs(no[~first], at[~first], window)


def runs(no: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows in documents -> no and packed spans, each of under 2^16 bytes."""
    order = np.lexsort((at, no))
    no, at = no[order], at[order]
    if not len(no):
        return no, at
    new = np.concatenate([[True], (no[1:] != no[:-1]) | (at[1:] != at[:-1] + 1)])
    since = at - at[new][np.cumsum(new) - 1]
    new = np.flatnonzero(new | (since % RUN == 0))
    lasts = np.append(new[1:], len(no)) - 1
    return no[new], at[new] << 16 | (at[lasts] - at[new] + window)


def earliest(high: np.ndarray, low: np.ndarray, no: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows with two hashes each -> an order that puts equal ones together, by document and place; which of it are not the first of theirs."""
    order = np.lexsort((at, no, low, high))
    same = np.zeros(len(order), bool)
    same[1:] = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
    return order, same


def spans_of(packed: np.ndarray) -> list[tuple[int, int]]:
    """Packed spans -> sorted maximal (start, end)."""
    out: list[list[int]] = []
    for x in np.sort(np.asarray(packed, np.int64)).tolist():
        start, end = x >> 16, (x >> 16) + (x & 0xFFFF)
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def _deal(found: np.ndarray, parts: int, spread: bool = False) -> Iterator[tuple[int, bytes]]:
    """Segments by anchor as (part, bytes): numbers of documents once, then records. spread: by document, as it may be any part."""
    part = ((found["no"].view(np.uint64) if spread else found["anchor"]) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(ends)).tolist():
        own = found[order[ends[k] : ends[k + 1]]]
        nos, nth = np.unique(own["no"], return_inverse=True)
        narrow = np.zeros(len(own), _NARROW)
        for name in _NARROW.names:
            narrow[name] = nth if name == "nth" else own[name]
        columns = b"".join(np.ascontiguousarray(narrow[x]).tobytes() for x in _NARROW.names)
        yield k, len(nos).to_bytes(4, "little") + len(own).to_bytes(4, "little") + nos.astype("<i8").tobytes() + columns


def _dealt(raw: bytes) -> np.ndarray:
    n_nos, n = (int.from_bytes(raw[k : k + 4], "little") for k in (0, 4))
    nos, at = np.frombuffer(raw, "<i8", n_nos, 8), 8 + 8 * n_nos
    out = np.zeros(n, SEGMENT)
    for name in _NARROW.names:
        kind = _NARROW[name]
        got = np.frombuffer(raw, kind, n, at)
        at += n * kind.itemsize
        out["no" if name == "nth" else name] = nos[got] if name == "nth" else got
    return out


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with NO, which is doc_id where that is a key; else the place in the order of doc_id (nulls first) and text."""
    ids = docs.select("doc_id")
    odd = ids.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not odd:
        return docs.withColumn(NO, F.col("doc_id").cast("long"))
    return numbered(docs, [F.asc_nulls_first("doc_id"), F.asc_nulls_first("text")], NO)


def removals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(no, text binary), no unique -> no, spans: array<long> of start << 16 | length, in no order, maybe overlapping."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_parts(spark), -(-size // PART_BYTES))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(texts: list[bytes], nos: list[int]) -> pa.RecordBatch:
            same, rest = repeats(segments(texts, np.array(nos, np.int64), window))
            rows = [(k, 0, x) for k, x in _deal(rest, parts)] + [(k, 1, x) for k, x in _deal(same, parts, spread=True)]
            return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int8()), pa.array([r[2] for r in rows], pa.binary())], ["part", "same", "payload"])

        texts, nos, held = [], [], 0
        for b in batches:
            for no, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                texts.append(text.as_py())
                nos.append(no)
                held += len(texts[-1])
                if held >= CHUNK:
                    yield send(texts, nos)
                    texts, nos, held = [], [], 0
        if texts:
            yield send(texts, nos)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone, rest = [], []
        for b in batches:
            for same, payload in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                (gone if same else rest).append(_dealt(payload.as_py()))
        found = np.concatenate([np.zeros(0, SEGMENT), *rest])
        del rest
        order = np.argsort(found["anchor"], kind="stable")
        anchors = found["anchor"][order]
        twice = np.zeros(len(anchors), bool)
        twice[1:] = anchors[1:] == anchors[:-1]
        twice[:-1] |= twice[1:]
        same, first = repeats(found[order[twice]])
        gone.append(same)
        mixed = np.zeros(len(first), bool)
        mixed[1:] = first["anchor"][1:] == first["anchor"][:-1]
        mixed[:-1] |= mixed[1:]
        ask = first[mixed]
        _, group, counts = np.unique(ask["anchor"], return_inverse=True, return_counts=True)
        single = (counts > GROUP)[group]
        for some, kind in [*((x, 0) for x in gone), (ask[~single], 1), (ask[single], 2)]:
            no, packed = _cut_spans(some, window)
            yield pa.record_batch([pa.array(no), pa.array(packed), pa.array(np.ascontiguousarray(some["anchor"]).view(np.int64)), pa.array(np.full(len(no), kind, np.int8))], ["no", "span", "anchor", "ask"])

    sent = docs.select("no", "text").mapInArrow(frugal(scan, forget), "part int, same byte, payload binary")
    matched = materialize(sent.repartitionById(parts, F.col("part")).mapInArrow(frugal(match), "no long, span long, anchor long, ask byte"), "suffix-matches")

    kinds = [("part", pa.int32()), ("anchor", pa.int64()), ("no", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary())]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        of = xxhash.xxh3_128_digest
        for b in batches:
            rows, single, hashes, empty = [], [], [], []
            for no, text, asked in zip(*b.columns, strict=True):
                raw, no = text.as_py(), no.as_py()
                for span, anchor, ask in ((x["span"], x["anchor"], x["ask"]) for x in asked.as_py()):
                    a, n = span >> 16, span & 0xFFFF
                    if ask == 1:
                        rows.append(((anchor & (1 << 64) - 1) % parts, anchor, no, a, raw[a : a + n]))
                    else:
                        single += [(no, p) for p in range(a, a + n - window + 1)]
                        hashes += [of(raw[p : p + window]) for p in range(a, a + n - window + 1)]
            if single:
                places = np.array(single, np.int64)
                high, low = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2).T
                order, same = earliest(high, low, places[:, 0], places[:, 1])
                empty = [(no % parts, None, no, span, None) for no, span in zip(*(x.tolist() for x in runs(*places[order[same]].T, window)), strict=True)]
                first = order[~same]
                part = high[first] % np.uint64(parts)
                for k in np.unique(part).tolist():
                    own = first[part == k]
                    # hashes, documents and places of windows
                    columns = (high[own], low[own], places[own, 0], places[own, 1])
                    rows.append((k, None, None, None, b"".join(np.ascontiguousarray(x).tobytes() for x in columns)))
            columns = list(zip(*(rows + empty), strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], [k for k, _ in kinds])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), schema=pa.schema(kinds))
        known = rows.filter(pa.compute.is_null(rows.column("bytes")))
        yield pa.record_batch([known.column(x).combine_chunks() for x in ("no", "start")], ["no", "span"])
        single = rows.filter(pa.compute.and_(pa.compute.is_null(rows.column("no")), pa.compute.is_valid(rows.column("bytes")))).column("bytes")
        if len(single):
            high, low, no, at = np.concatenate([np.frombuffer(x.as_py(), "<i8").reshape(4, -1) for x in single], axis=1)
            order, same = earliest(high, low, no, at)
            found, packed = runs(no[order[same]], at[order[same]], window)
            yield pa.record_batch([pa.array(found), pa.array(packed)], ["no", "span"])
        rows = rows.filter(pa.compute.is_valid(rows.column("anchor")))
        rows = rows.take(pa.array(np.lexsort((rows.column("start").to_numpy(), rows.column("no").to_numpy(), rows.column("anchor").to_numpy()))))
        anchor, no, start = (rows.column(x).to_numpy() for x in ("anchor", "no", "start"))
        sizes = np.cumsum(pa.compute.binary_length(rows.column("bytes")).to_numpy()) if len(rows) else np.zeros(0, np.int64)
        edges = np.append(np.flatnonzero(np.diff(anchor, prepend=anchor[:1] ^ 1)), len(anchor)) if len(rows) else np.zeros(1, np.int64)
        low = 0
        for k, high in enumerate(edges[1:].tolist(), 1):
            if high == len(anchor) or sizes[edges[k + 1] - 1] - (sizes[low - 1] if low else 0) > SHARD:
                found, packed = repeated_windows([x.as_py() for x in rows.column("bytes")[low:high]], start[low:high], no[low:high], window)
                yield pa.record_batch([pa.array(found), pa.array(packed)], ["no", "span"])
                low = high

    asked = matched.where("ask > 0").groupBy("no").agg(F.collect_list(F.struct("span", "anchor", "ask")).alias("asked"))
    bytes_of = docs.select("no", "text").join(asked, "no").select("no", "text", "asked").mapInArrow(frugal(fetch), "part int, anchor long, no long, start long, bytes binary")
    windows = bytes_of.repartitionById(parts, F.col("part")).mapInArrow(frugal(sort), "no long, span long")
    return matched.where("ask = 0").select("no", "span").unionByName(windows).groupBy("no").agg(F.collect_list("span").alias("spans"))


def marked(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text, ...) with SPANS (see removals(); null: nothing to remove) added.

    A null text is an empty one. Documents are in the order of doc_id, nulls first; rows with equal or
    null doc_id are documents of their own, ordered by text. Windows are equal by their bytes in the suffix
    order, by 128 bits of hash where whole segments are equal or a group is large.
    """
    keyed = _numbered(docs)
    spans = removals(keyed.select(F.col(NO).alias("no"), text_or_empty().cast("binary").alias("text")), window)
    return keyed.join(spans.select(F.col("no").alias(NO), F.col("spans").alias(SPANS)), NO, "left").drop(NO)


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of UTF-8 text drawn in to whole characters, so that what is left is text."""
    out = []
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the repeats cut out of text, at whole characters; null texts stay null, other columns as they are."""
    names = [f.name for f in docs.schema]

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, packed in zip(b.column(names.index("text")).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                if packed:
                    raw = text.encode()
                    text = cut(raw, whole_characters(raw, spans_of(packed))).decode()
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if name == "text" else b.column(k) for k, name in enumerate(names)]
            yield pa.record_batch(columns, names)

    return marked(docs, window).select(*names, SPANS).mapInArrow(frugal(trim), docs.schema)


def suffix_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row for each row; see marked()."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, packed in zip(b.column(1), b.column(2), strict=True):
                raw = text.as_py()
                spans = spans_of(packed.as_py() or [])
                rows.append((len(raw), sum(y - x for x, y in spans), len(spans), hashlib.sha256(cut(raw, spans)).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = marked(docs.select("doc_id", "text"), window)
    return found.select("doc_id", text_or_empty().cast("binary").alias("text"), SPANS).mapInArrow(frugal(measure), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
