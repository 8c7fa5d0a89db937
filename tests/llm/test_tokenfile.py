import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_texts import prose
from quillspace.llm import tokenfile as t
from quillspace.llm import tokens
from quillspace.llm.tokens import default_path, encoder
from tokenizers import Tokenizer


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=1500), st.integers(0, 2**20))
def test_blocks_round_trip(values, low):
    ids = np.array([v >> (v % 29) for v in values] + [low] * (len(values) % 5), np.uint32)
    starts, blocks = t.pack_blocks(ids)
    assert np.array_equal(t.unpack_blocks(starts, blocks), ids)


def test_segments_round_trip_and_errors():
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (0, 5, 3000)]
    raw = t.segment([3, None, -4], ids) + b"\0" + t.segment([], [])
    got = list(t.read_segments(raw))
    assert got[0][0] == [3, None, -4] and got[0][1].tolist() == [0, 5, 3000]
    assert got[0][2].astype("<u4").tobytes() == b"".join(ids) and got[1][0] == []
    with pytest.raises(ValueError):
        list(t.read_segments(raw[:60]))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab,.'1 \n\t\x1c  é日　")) | st.characters(codec="utf-8"), max_size=60))
def test_pieces_encode_like_the_whole(text):
    e, whole = encoder(default_path()), Tokenizer.from_file(default_path())
    texts = [text, "", f"{text}<|endoftext|> {text}", text]
    want = [np.array([*whole.encode(x, add_special_tokens=False).ids, 2], "<u4").tobytes() for x in texts]
    assert list(e.encode(texts, 2)) == want == list(e.encode(texts, 2))


def test_long_texts_with_added_tokens_and_a_small_cache(monkeypatch):
    whole = Tokenizer.from_file(default_path())
    monkeypatch.setattr(tokens, "WHOLE_CHARS", 50)
    monkeypatch.setattr(tokens, "CACHE_BYTES", 2000)
    monkeypatch.setattr(tokens, "SLICE_BYTES", 300)
    e = tokens.Encoder(default_path())
    texts = [prose(1, 300) + " <|endoftext|>. it's\u00a0 \t a\u3000 b  \n\n" + prose(2, 90), prose(3, 200), "", " ", "<|endoftext|>"]
    got = list(e.encode(texts, 2))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [[*whole.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    assert sum(len(x) for x in (e.kept, e.older)) < 20


def test_files_in_document_order(odd, make):
    got = t.token_table(odd).collect()
    whole = Tokenizer.from_file(default_path())
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, (r["text"] or "").encode()))
    want, at = [], 0
    for r in rows:
        ids = np.array([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((str(r["doc_id"]), at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    assert t.token_table(make([])).count() == 0


def test_many_files_for_a_partition(make, monkeypatch):
    monkeypatch.setattr(t, "FILE_SEGMENTS", 2)
    rows = [(k, prose(k, 30) + " <|endoftext|>") for k in range(60)]
    spark = make([]).sparkSession
    path = t.shared_path(spark, "tokens")
    monkeypatch.setattr(t, "SEGMENT_IDS", 200)
    t.write_tokens(make(rows), path, default_path())
    got = t.read_tokens(spark, path).orderBy("part", "file", "nth").collect()
    assert [r["doc_id"] for r in got] == list(range(60)) and max(r["file"] for r in got) > 0
    whole = Tokenizer.from_file(default_path())
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == [*whole.encode(rows[r["doc_id"]][1], add_special_tokens=False).ids, 2] for r in got)
