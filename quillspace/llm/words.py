"""Words of many texts at once, as hashes of byte ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Characters of texts handled at a time; a longer text is handled by itself.
CHUNK = 200_000
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LETTER = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; kept by each Python worker."""
    if not _POWERS or len(_POWERS[0]) < n:
        most = max(n, 2 * CHUNK)
        base = np.full(most, _BASE, np.uint64)
        back = np.full(most, pow(_BASE, -1, 1 << 64), np.uint64)
        base[0] = back[0] = 1
        _POWERS[:] = [np.cumprod(base, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)]
    return _POWERS[0][:n], _POWERS[1][:n]


def chunks(texts: list[str]) -> Iterator[list[str]]:
    """Whole texts, about CHUNK characters at a time."""
    part, held = [], 0
    for x in texts:
        part.append(x)
        held += len(x)
        if held >= CHUNK:
            yield part
            part, held = [], 0
    if part:
        yield part


class Words:
    """Words of texts, lower-cased and freed of ASCII signs at their ends; words of signs alone are passed over.

    doc: place of each word's text; first, last: its bytes in the lower-cased texts joined by \\n.
    """

    def __init__(self, texts: list[str]):
        raw = [x.lower().encode() for x in texts]
        self.raw = b"\n".join(raw) + b"\n"
        buf = np.frombuffer(self.raw, np.uint8)
        power, self.back = powers(len(buf))
        space, letter = _SPACE[buf], _LETTER[buf]
        edge = np.diff(space.view(np.int8), prepend=1, append=1)
        starts, ends = np.flatnonzero(edge[:-1] == -1), np.flatnonzero(edge == 1)
        seen = np.concatenate([[0], np.cumsum(letter)])
        some = seen[ends] > seen[starts]
        starts, ends, places = starts[some], ends[some], np.flatnonzero(letter)
        self.first, self.last = places[seen[starts]], places[seen[ends] - 1] + 1
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)])
        self.doc = np.searchsorted(np.cumsum([len(x) + 1 for x in raw]), self.first, side="right")

    def hashes(self, most: int = 1 << 40) -> np.ndarray:
        """Of each word's first bytes, by a difference of prefix sums; 64 bits."""
        h = (self.sums[np.minimum(self.last, self.first + most)] - self.sums[self.first]) * self.back[self.first] + np.uint64(most)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def unique(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by a sort, which is quicker than hashing them."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def ngrams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first words of n-grams within one text, and hashes of the n-grams."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ hashes[k : len(hashes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    at = np.flatnonzero(doc[: len(out)] == doc[n - 1 :])
    return at, out[at]
