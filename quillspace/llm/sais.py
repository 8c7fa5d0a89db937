"""Suffix arrays by induced sorting, and permuted common prefixes."""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are induced bucket by bucket, whole runs of a bucket at a time.
SMALL = 1024


def _types(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than their successor. s ends with its unique smallest letter."""
    n = len(s)
    step = np.sign(np.diff(s))
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    settles = np.minimum.accumulate(at[::-1])[::-1]  # the next place where neighbours differ
    rises = np.append(step > 0, True)
    return np.append(rises[settles], True)


def _ranks(letters: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Place of each within its run of equal letters; letters are sorted."""
    return np.arange(len(letters)) - (np.cumsum(counts) - counts)[letters]


def _induce_buckets(s: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    counts = np.bincount(s, minlength=sigma)
    ends = np.cumsum(counts)
    heads = ends - counts
    sa = np.full(len(s), -1, np.int64)
    by = lms[np.argsort(s[lms], kind="stable")]
    bounds = np.searchsorted(s[by], np.arange(sigma + 1))
    tails = heads.copy()

    def push(batch: np.ndarray, kind: bool, sign: int, at: np.ndarray) -> None:
        p = batch[batch > 0] - 1
        p = p[small[p] == kind]
        if len(p):
            letters = s[p]
            order = np.argsort(letters, kind="stable")
            p, letters = p[order], letters[order]
            n = np.bincount(letters, minlength=sigma)
            rank = _ranks(letters, n)
            sa[at[letters] + rank if sign > 0 else at[letters] - 1 - rank] = p
            at += sign * n

    for c in range(sigma):
        done = heads[c]
        while done < tails[c]:
            batch, done = sa[done : tails[c]].copy(), tails[c]
            push(batch, False, 1, tails)
        push(by[bounds[c] : bounds[c + 1]], False, 1, tails)
    fronts = ends.copy()
    for c in range(sigma - 1, -1, -1):
        done = ends[c]
        while fronts[c] < done:
            batch, done = sa[fronts[c] : done][::-1].copy(), fronts[c]
            push(batch, True, -1, fronts)
        push(sa[heads[c] : tails[c]][::-1].copy(), True, -1, fronts)
    sa[0] = len(s) - 1
    return sa


def _induce_one_by_one(s: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    counts = np.bincount(s, minlength=sigma)
    ends = np.cumsum(counts)
    heads = (ends - counts).tolist()
    text, kinds, sa, last = s.tolist(), small.tolist(), [-1] * len(s), ends.tolist()
    for p in reversed(lms.tolist()):
        c = text[p]
        last[c] -= 1
        sa[last[c]] = p
    for k in range(len(sa)):
        p = sa[k] - 1
        if p >= 0 and not kinds[p]:
            c = text[p]
            sa[heads[c]] = p
            heads[c] += 1
    last = ends.tolist()
    for k in range(len(sa) - 1, -1, -1):
        p = sa[k] - 1
        if p >= 0 and kinds[p]:
            c = text[p]
            last[c] -= 1
            sa[last[c]] = p
    sa[0] = len(text) - 1
    return np.array(sa, np.int64)


def suffix_array(s: np.ndarray, sigma: int) -> np.ndarray:
    """Of s (int64, letters 0 to sigma - 1) that ends with its only 0."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    induce = _induce_buckets if sigma <= SMALL else _induce_one_by_one
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    rough = induce(s, small, lms, sigma)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]  # sorted by their leftmost-smaller substrings
    length = np.zeros(n, np.int64)
    length[lms] = np.diff(np.append(lms, n - 1)) + 1
    a, b = ordered[:-1], ordered[1:]
    same = (length[a] == length[b]) & (length[a] > 1)
    at = np.flatnonzero(same)
    for k in range(int(length.max()) if len(at) else 0):
        at = at[length[a[at]] > k]
        if not len(at):
            break
        equal = s[a[at] + k] == s[b[at] + k]
        same[at[~equal]] = False
        at = at[equal]
    names = np.concatenate([[0], np.cumsum(~same)])
    name = np.zeros(n, np.int64)
    name[ordered] = names
    reduced, letters = name[lms], int(names[-1]) + 1
    order = suffix_array(reduced, letters) if letters < len(lms) else np.argsort(reduced, kind="stable")
    return induce(s, small, lms[order], sigma)


def common_prefixes(text: bytes, sa: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes: for each place of text, of its suffix with the one before it in sa, in
    whole words of 8 bytes and at most `most` bytes. sa: places in text, in suffix order.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = text + b"\0" * 8
    out = np.zeros(n, np.int64)
    at = np.flatnonzero(before >= 0)
    for k in range(0, most, 8):
        width = min(8, most - k)
        last = n - k - width
        at = at[(at <= last) & (before[at] <= last)]
        if not len(at):
            break
        words = np.ndarray((n,), "<u8", padded, strides=(1,))
        x = words[at + k] ^ words[before[at] + k]
        if width < 8:
            x &= np.uint64((1 << 8 * width) - 1)
        at = at[x == 0]
        out[at] = k + width
    return out
