"""Token ids of whole texts by a byte-level BPE file of the tokenizers library, a batch of texts at a time.

The file's pre-tokenizer never joins a character that is no white space to white space after it, so a
text can be cut before each such white space and each piece encoded by itself. Pieces repeat: those of
a batch are found by one dictionary encoding, each distinct one is encoded once by the library's own
model, and all ids are gathered from those. Texts that hold one of the file's added tokens go to the
library itself, which gives them ids of their own.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
#: Bytes of words and their ids kept by one Python worker, in two halves: a full one is kept, the one before it dropped.
CACHE_BYTES = 60_000_000
#: Bytes of texts whose pieces are held at a time; a longer text is taken by itself.
SLICE_BYTES = 6_000_000
#: Characters that the library encodes at a time.
WHOLE_CHARS = 100_000
_SPACE = np.isin(np.arange(256), [10, 32])
#: After these no cut is made, as they are white space to the pre-tokenizer.
_NO_CUT = np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
_LETTER = np.array([chr(c).isalpha() for c in range(128)] + [False] * 128)
#: After a letter these begin a token of their own; an apostrophe may not.
_SIGN = np.array([33 <= c < 127 and not chr(c).isalnum() and c != 39 for c in range(256)])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _byte_letters() -> dict[int, int]:
    """Byte to the code point that stands for it in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return dict(zip(plain, plain, strict=True)) | {b: 256 + k for k, b in enumerate(rest)}


def cuts(raw: np.ndarray) -> np.ndarray:
    """Where in UTF-8 bytes a piece may begin: at a space or newline after what is surely no white space."""
    at = np.flatnonzero(_SPACE[raw[1:]] & ~_NO_CUT[raw[:-1]]) + 1
    one, two, three = raw[at - 1], raw[np.maximum(at - 2, 0)], raw[np.maximum(at - 3, 0)]
    # white space and the like of two and three bytes, by their first bytes
    other = ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | ((three == 0xE1) & ((two == 0x9A) | (two == 0xA0))) | ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE3) & (two == 0x80)) | ((three == 0xEF) & (two == 0xBB))
    return at[~other]


class Encoder:
    """Texts -> their ids, without an end id, as the library's encode(text, add_special_tokens=False) gives them."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.tokenize = self.whole.model.tokenize
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.letters = _byte_letters()
        self.space = chr(self.letters[32])
        added = self.whole.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        #: Whether a text with an added token may be cut at white space.
        self.plain = not any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in added)
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _model(self, word: str) -> bytes:
        plain = word.isascii() and word.isprintable()
        name = word.replace(" ", self.space) if plain else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(name)]).tobytes()

    def piece(self, text: str) -> bytes:
        got = self.older.get(text)
        if got is None:
            whole = text.isalpha() or text[1:].isalpha() and text[0] == " "
            got = self._model(text) if whole else b"".join([self._model(w) for w in self.split(text)])
        self.kept[text] = got
        self.held += 200 + len(text) + len(got)
        if 2 * self.held > CACHE_BYTES:
            self.older, self.kept, self.held = self.kept, {}, 0
        return got

    def _pieces(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts' bytes on end, and the length of each -> all ids, and how many each text has."""
        ends = np.cumsum(lengths)
        begins = np.zeros(len(raw), bool)
        begins[1:] = _SIGN[raw[1:]] & _LETTER[raw[:-1]]
        begins[cuts(raw)] = True
        begins[(ends - lengths)[lengths > 0]] = True
        starts = np.flatnonzero(begins)
        offsets = np.append(starts, len(raw)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw)).dictionary_encode()
        known = []
        for x in pieces.dictionary.to_pylist():
            got = self.kept.get(x)
            known.append(self.piece(x) if got is None else got)
        table = np.frombuffer(b"".join(known), "<u4")
        sizes = np.array([len(x) // 4 for x in known], np.int32)  # as all positions here, a text having under 2^31 bytes
        index = pieces.indices.to_numpy()
        counts = sizes[index]
        after = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
        places = np.repeat(((np.cumsum(sizes) - sizes)[index] - after[:-1]).astype(np.int32), counts)
        places += np.arange(after[-1], dtype=np.int32)
        of = np.searchsorted(starts, np.concatenate([np.zeros(1, np.int64), ends]))
        return table[places], np.diff(after[of])

    def _library(self, text: str) -> np.ndarray:
        if not self.plain or len(text) <= WHOLE_CHARS:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        raw = np.frombuffer(text.encode(), np.uint8)
        at = cuts(raw)
        wanted = np.searchsorted(at, np.arange(WHOLE_CHARS, len(raw), WHOLE_CHARS))
        edges = np.unique(np.concatenate([[0], at[wanted[wanted < len(at)]], [len(raw)]])).tolist()
        return np.concatenate([np.array(self.whole.encode(raw[a:b].tobytes().decode(), add_special_tokens=False).ids, np.uint32) for a, b in zip(edges, edges[1:], strict=False)])

    def batches(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Consecutive texts (no nulls), about SLICE_BYTES at a time: their ids on end, and how many each has."""
        sizes = pc.binary_length(texts).to_numpy()
        low = 0
        while low < len(texts):
            high = low + max(1, int(np.searchsorted(np.cumsum(sizes[low:]), SLICE_BYTES, side="right")))
            some, lengths = texts[low:high], sizes[low:high].astype(np.int64)
            special = np.zeros(len(some), bool)
            for content in self.added:
                special |= pc.match_substring(some, content).to_numpy(zero_copy_only=False)
            plain = some.filter(pa.array(~special)) if special.any() else some
            raw = np.frombuffer(b"".join([x.as_buffer() for x in plain.cast(pa.binary())]), np.uint8)
            ids, counts = self._pieces(raw, np.where(special, 0, lengths)) if len(raw) else (np.zeros(0, np.uint32), np.zeros(len(some), np.int64))
            if special.any():
                parts = np.split(ids, np.cumsum(counts)[:-1])
                for k in np.flatnonzero(special).tolist():
                    parts[k] = self._library(some[k].as_py())
                ids, counts = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
            yield ids, counts
            low = high

    def encode(self, texts: Sequence[str] | pa.Array, end_id: int) -> Iterator[bytes]:
        """Of each text its ids and end_id as little-endian unsigned 32-bit integers."""
        end = end_id.to_bytes(4, "little")
        for ids, counts in self.batches(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())):
            raw, at = ids.astype("<u4", copy=False).tobytes(), 0
            for n in counts.tolist():
                yield raw[at : at + 4 * n] + end
                at += 4 * n


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker, kept over its tasks; what it keeps is bounded by CACHE_BYTES."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)
