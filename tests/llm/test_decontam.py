import numpy as np
from quillspace.llm import decontam as d

from llm_texts import prose


def brute_align(a, b):
    best, h = 0, np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best


def test_alignment_scores():
    r = np.random.default_rng(0)
    for _ in range(100):
        a, b = r.integers(0, 4, r.integers(1, 12)), r.integers(0, 4, r.integers(1, 20))
        score, first, last = d.align(a, b)
        assert score == brute_align(a, b)
        if score:
            assert brute_align(a, b[first:last]) == score


def unlike(seed, n):
    return " ".join(f"{w}{seed}" if i % 2 else w for i, w in enumerate(prose(seed, n).split()))


def test_finds_copies_and_leaves_the_rest(spark, make, odd):
    items = {k: unlike(1000 + k, 30) for k in range(8)}
    words = items[3].split()
    edited = [w if i % 7 else "changed" for i, w in enumerate(words)]
    rows = [(i, unlike(i, 200)) for i in range(60)]
    rows += [(100, f"{unlike(77, 50)} {items[0]} {unlike(78, 50)}"), (101, " ".join(edited)), (102, items[5].upper().replace(" ", ", ")), (103, None), (104, "")]
    rows += [(200 + i, f"{unlike(300 + i, 20)} {items[6]}") for i in range(150)]  # a leak into most documents
    table = spark.createDataFrame([(k, v, 1) for k, v in items.items()] + [(90, None, 1), (91, "...", 1), (92, "solo", 1)], "item_id long, text string, score int")
    got = {(r["doc_id"], r["item_id"]): r for r in d.contaminated(make(rows), table).collect()}
    assert set(got) == {(100, 0), (101, 3), (102, 5), *((200 + i, 6) for i in range(150))}
    assert got[100, 0]["score"] == 1 and (got[100, 0]["first_word"], got[100, 0]["last_word"]) == (50, 80)
    kept = d.decontaminated(make(rows), table)
    assert {r["doc_id"] for r in kept.collect()} == {*range(60), 103, 104} and kept.schema == make(rows).schema
    assert d.contaminated(odd, table).count() == 0 and d.contaminated(make([]), table).count() == 0
    assert d.contaminated(odd, table.limit(0)).count() == 0 and d.decontaminated(odd, table.limit(0)).count() == odd.count()


def test_finds_an_edited_item_however_often_it_leaks(spark, make):
    items = {0: unlike(1000, 30), 1: unlike(1001, 60)}
    edited = {k: " ".join(w if i % n else "changed" for i, w in enumerate(items[k].split())) for k, n in ((0, 7), (1, 10))}
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for copies in (5, 50, 1000):
        for exact in (0, 1):
            rows = [(10 * i + k, f"{unlike(i, 10)} {edited[k]}") for i in range(1, copies + 1) for k in items]
            rows += [(5, items[0]), (6, items[1])] if exact else []
            rows += [(-i, unlike(5000 + i, 100)) for i in range(1, 21)]
            got = {r["doc_id"] for r in d.contaminated(make(rows), table).collect()}
            assert got == {i for i, _ in rows if i > 0}


def test_a_common_phrase_is_no_leak(spark, make):
    own = lambda seed, n: " ".join(f"{w}{seed}" for w in prose(seed, n).split())
    phrase = prose(1, 6)
    table = spark.createDataFrame([(k, f"{own(1000 + k, 30)} {phrase}") for k in range(5)], "item_id long, text string")
    rows = [(i, f"{own(i, 40)} {phrase} {own(300 + i, 40)}") for i in range(200)]
    assert d.contaminated(make(rows), table).count() == 0
