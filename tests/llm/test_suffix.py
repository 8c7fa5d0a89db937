import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from quillspace.llm import sais
from quillspace.llm import suffix as s


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=80))
def test_induced_sorting(values):
    text = [*values, 0]
    want = sorted(range(len(text)), key=lambda i: text[i:])
    array = np.array(text, np.int64)
    assert sais.suffix_array(array, 5).tolist() == want
    small, sais.SMALL = sais.SMALL, 0
    try:
        assert sais.suffix_array(array, 5).tolist() == want
    finally:
        sais.SMALL = small


def test_common_prefixes():
    text = b"abcabcabcabcXabcabcabcabcY" * 3
    sa = np.array(sorted(range(len(text)), key=lambda i: text[i:]))
    got = sais.common_prefixes(text, sa, 12)
    for a, b in zip(sa, sa[1:], strict=False):
        n = 0
        while n < 12 and max(a, b) + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        assert got[b] == (12 if n == 12 else 8 if n >= 8 else 0)


def brute(rows, window=100):
    """Row by row; windows are kept as they are."""
    seen, out = set(), []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - window + 1):
            if raw[p : p + window] in seen:
                gone[p : p + window] = b"\1" * window
            seen.add(raw[p : p + window])
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        out.append((str(key), len(raw), sum(gone), bytes(gone).replace(b"\0", b" ").split().__len__(), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted((str(r[0]), *r[1:]) for r in s.suffix_dedup(docs).collect())
    assert got == brute(rows)


def test_against_brute_force(make, monkeypatch):
    r = random.Random(3)
    passages = ["".join(r.choice("abcdé ") for _ in range(r.randint(60, 260))) for _ in range(12)]
    rows = [(i, "".join(r.choice([*passages, "".join(r.choice("abcdef ") for _ in range(r.randint(1, 90)))]) for _ in range(r.randint(0, 9)))) for i in range(80)]
    check(make(rows))
    monkeypatch.setattr(s, "SHARD", 1000)
    monkeypatch.setattr(s, "CHUNK", 3000)
    monkeypatch.setattr(s, "GROUP", 3)
    monkeypatch.setattr(s, "RUN", 50)
    check(make([*rows, (90, None), (91, "ab" * 700), (92, "z" * 1500), (93, "z" * 99), (94, "z" * 100)]))


def test_odd_rows_and_cutting(odd, make):
    check(odd)


def test_common_passage_window_by_window(make, monkeypatch):
    r = random.Random(7)
    common = "".join(r.choices("abcdefgh ", k=230))
    own = lambda n: "".join(r.choices("abcdefgh ", k=n))
    rows = [(i, own(r.randint(0, 80)) + common[r.choice([0, 0, 0, 9]) : r.choice([230, 230, 215])] + own(r.randint(0, 80))) for i in range(150)]
    want = brute(rows)
    for group in (2, 40, 10_000):
        monkeypatch.setattr(s, "GROUP", group)
        assert sorted((str(r[0]), *r[1:]) for r in s.suffix_dedup(make(rows)).collect()) == want


def test_empty_tables_and_characters(make):
    assert s.suffix_dedup(make([])).count() == 0
    base = "é" * 3 + "".join(random.Random(1).choices("abcdefgh ", k=160))
    docs = make([(1, base), (2, "x" + base + "ü"), (3, None), (4, "")])
    out = {r["doc_id"]: r for r in s.without_repeats(docs).collect()}
    assert out[1]["text"] == base and out[2]["text"] == "xü" and out[3]["text"] is None and out[4]["text"] == ""
    assert s.without_repeats(docs).schema.names == docs.schema.names


def test_spans_keep_characters_whole():
    raw = "aéb".encode()
    assert s.whole_characters(raw, [(1, 2)]) == [] and s.whole_characters(raw, [(2, 4)]) == [(3, 4)]
    assert s.cut(raw, s.whole_characters(raw, [(0, 2)])) == "éb".encode()
