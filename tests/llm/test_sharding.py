import heapq
import random
import zlib

from quillspace.llm import sharding as s


def heap_lpt(sizes, shards):
    loads = [(0, i) for i in range(shards)]
    for x in sorted(sizes, reverse=True):
        load, i = heapq.heappop(loads)
        heapq.heappush(loads, (load + x, i))
    return sorted(x for x, _ in loads)


def test_schedule_gives_what_a_heap_gives():
    r = random.Random(0)
    for _ in range(30):
        sizes = [r.choice([1, 2, 3, 5, 8, 50, 51, 400, 9000, 9001, 123_456]) + r.randint(0, 1) * r.randint(0, 300_000) for _ in range(r.randint(1, 800))]
        counts = {x: sizes.count(x) for x in set(sizes)}
        loads = [0] * 7
        for size, n, ends in s.schedule(sorted(counts.items(), reverse=True), 7):
            assert ends[-1] == counts[size] == n
            for i, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
                loads[i] += size * (b - a)
        assert sorted(loads) == heap_lpt(sizes, 7)


def test_large_groups_by_their_true_sizes(make, monkeypatch):
    r = random.Random(1)
    rows = [(i, f"{i} " + "y" * r.choice([10, 8_200, 20_000 + i, 20_000, 40_000])) for i in range(200)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]
    groups = {}
    for _, t in rows:
        groups[t] = groups.get(t, 0) + len(t) + 1
    want = heap_lpt(groups.values(), 16)
    for block, broadcast in ((1000, 1000), (7, 0)):
        monkeypatch.setattr(s, "BLOCK", block)
        monkeypatch.setattr(s, "BROADCAST", broadcast)
        loads = [0] * 16
        for row in s.shard(make(rows)).collect():
            loads[row["shard"]] += row["size"]
        assert sorted(loads) == want


def test_shards_are_whole_and_even(odd, make):
    rows = [(i, f"text {i % 700} " + "x" * (i % 97)) for i in range(1500)]
    docs = make(rows)
    got = s.shard(docs).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1500))
    texts = dict(rows)
    home, loads, slots = {}, {}, {}
    for r in got:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "bytes")
        assert home.setdefault(raw, r["shard"]) == r["shard"]
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(loads) == set(range(16)) and max(loads.values()) - min(loads.values()) <= 120
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    odd_rows = s.shard(odd).collect()
    assert len(odd_rows) == odd.count() and s.shard(make([])).count() == 0
