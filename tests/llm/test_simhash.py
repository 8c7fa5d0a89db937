import random
import re

import numpy as np
import xxhash
from quillspace.llm import simhash as s


def brute_fp(text):
    text = "".join(x.lower() if x.isascii() else x for x in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints(odd):
    got = sorted((str(r[0]), r[1] & (1 << 64) - 1) for r in s.fingerprints(odd).collect())
    assert got == sorted((str(r["doc_id"]), brute_fp(r["text"])) for r in odd.collect())


def clusters(seed, n):
    r, out = random.Random(seed), []
    while len(out) < n:
        center = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 2, 8, 60])):
            if r.random() < 0.3:
                center ^= 1 << r.randrange(64)
            fp = center
            for _ in range(r.choice([0, 1, 2, 3, 4])):
                fp ^= 1 << r.randrange(64)
            out.append(fp)
    return sorted(set(out[:n]))


def stars(pairs):
    return sorted(map(tuple, s.spanning(pairs).tolist())) if len(pairs) else []


def test_shards_lose_no_link():
    for seed in range(4):
        fps = np.array(clusters(seed, 700), np.uint64)
        roots = brute_components([int(x) for x in fps])
        want = sorted((int(fps[i]), int(fps[r])) for i, r in enumerate(roots) if i != r)
        found = []
        for block in range(3):
            mask = s.block_mask(block)
            tree = s.grow(fps[::3], mask, 3)
            homes = np.zeros(len(fps), int)
            for _, at, home in s.route(tree, fps, mask):
                homes[at[home]] += 1
                found.append(s.link_shard(fps[at][home], fps[at], mask))
            assert (homes == 1).all()
        assert stars(np.concatenate(found)) == want


def test_shards_stay_even_as_they_grow():
    r = np.random.default_rng(0)
    fps = np.unique(r.integers(0, 2**64, 200_000, np.uint64))
    mask = s.block_mask(1)
    for depth in (3, 6):
        tree = s.grow(np.sort(r.choice(fps, s.SAMPLE << depth, replace=False)), mask, depth)
        sizes = [int(home.sum()) for _, _, home in s.route(tree, fps, mask)]
        assert len(sizes) == 1 << depth and sum(sizes) == len(fps)
        assert max(sizes) <= 4 * len(fps) / len(sizes)


def test_components_of_documents(spark, odd, make, monkeypatch):
    monkeypatch.setattr(s, "SHARD_SIZE", 64)
    texts = [f"{' '.join(f'w{(i * 7 + k) % 50}' for k in range(40))} tail{i % 5}" for i in range(120)]
    for docs in (odd, make([*enumerate(texts), (3, None), (200, texts[0])])):
        rows = docs.select("doc_id", "text").collect()
        fps = [brute_fp(r["text"]) for r in rows]
        roots = brute_components(fps)
        least = {}
        for r, root in zip(rows, roots, strict=True):
            if r["doc_id"] is not None:
                least[root] = min(least.get(root, r["doc_id"]), r["doc_id"])
        want = sorted((str(r["doc_id"]), f"{fp:016x}", least.get(root)) for r, fp, root in zip(rows, fps, roots, strict=True))
        assert sorted((str(x[0]), x[1], x[2]) for x in s.near_duplicates(docs).collect()) == want
    assert s.near_duplicates(make([])).count() == 0


def test_hub_and_chain(spark):
    from quillspace.llm.graph import components

    edges = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5), (None, 3), (7, 0)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(300)}, **{i: 1000 for i in range(1000, 1201)}}
