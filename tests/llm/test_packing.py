import zlib
from collections import defaultdict

import numpy as np
from quillspace.llm import packing as p
from quillspace.llm.tokens import default_path
from tokenizers import Tokenizer


def test_cut():
    assert p.cut(5, 10) == [(0, 5)] and p.cut(10, 10) == [(0, 10)]
    assert p.cut(25, 10) == [(0, 5), (5, 10), (15, 10)] and p.cut(20, 10) == [(0, 10), (10, 10)]


def test_plan_places_every_piece_once_and_tightly():
    r = np.random.default_rng(0)
    histogram = {int(k): int(n) for k, n in zip(*np.unique(r.integers(1, 1025, 4000), return_counts=True), strict=True)}
    rows, n = p.plan(histogram)
    filled, seen = defaultdict(list), defaultdict(list)
    for length, number, k, first, offset in rows:
        seen[length].append((number, k))
        for i in range(k):
            filled[first + i].append((offset, length))
    for length, parts in seen.items():
        at = 0
        for number, k in sorted(parts):
            assert number == at
            at += k
        assert at == histogram[length]
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(k * v for k, v in histogram.items())
    assert len(filled) == n <= -(-total // 1024) * 1.02
    assert p.plan({}) == ([], 0)


def brute_rule(histogram, capacity, small):
    """Piece by piece: each goes where the squared counts of open bins per gap become smallest, ties to the smallest gap, an open bin first."""
    count, opened = [0] * (capacity + 1), 0
    for length, n in p.batches(histogram, small):
        for _ in range(n):
            best, gap = None, capacity
            for g in range(length, capacity + 1):
                if count[g]:
                    after = g - length
                    change = 1 - 2 * count[g] + (2 * count[after] + 1 if after else 0)
                    if best is None or change < best:
                        best, gap = change, g
            left = capacity - length
            if best is None or best > (2 * count[left] + 1 if left else 0):
                opened, gap = opened + 1, capacity
            else:
                count[gap] -= 1
            if gap > length:
                count[gap - length] += 1
    return opened, count


def test_plan_against_the_rule_piece_by_piece(monkeypatch):
    r = np.random.default_rng(3)
    exact, eighths = [], []
    for seed in range(4):
        capacity = 64
        lengths = r.integers(1, capacity + 1, 500) if seed % 2 else np.minimum(capacity, r.lognormal(2.2, 0.9, 700).astype(int) + 1)
        histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
        want, _ = brute_rule(histogram, capacity, int(capacity * 0.4))
        monkeypatch.setattr(p, "STEPS", 10**9)
        exact.append((p._plan(histogram, capacity, int(capacity * 0.4))[1], want))
        monkeypatch.setattr(p, "STEPS", 8)
        eighths.append((p.plan(histogram, capacity)[1], want))
    assert all(a == b for a, b in exact), exact
    assert all(a <= b + 1 for a, b in eighths), eighths


def test_pieces_match_whole_tokenization(odd, make):
    for docs in (odd, make([])):
        got = p.pack(docs).collect()
        whole = Tokenizer.from_file(default_path())
        want = []
        for r in docs.select("doc_id", "text").collect():
            ids = np.array([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
            want += [(str(r["doc_id"]), k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(p.cut(len(ids)))]
        assert sorted((str(r["doc_id"]), *r[1:5]) for r in got) == sorted(want)
        rooms = defaultdict(list)
        for r in got:
            rooms[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in rooms.values():
            assert [a for a, _ in sorted(parts)] == list(np.cumsum([0, *(n for _, n in sorted(parts))])[:-1])
            assert sum(n for _, n in parts) <= 1024
