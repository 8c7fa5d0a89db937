import zlib

import numpy as np
from pyspark.sql import functions as F
from quillspace.llm import toxicity as t

from llm_texts import prose


def test_learns_and_holds_out(spark, make, odd):
    rows = [(i, prose(i, 60) + (f" nasty{i % 3} " + prose(i + 9, 20) if i % 5 == 0 else "")) for i in range(600)]
    docs = make(rows)
    labels = spark.createDataFrame([(i, int(i % 5 == 0), 0) for i in range(600)] + [(9999, 1, 0), (4, None, 0)], "doc_id long, toxic int, quality int")
    got = {r["doc_id"]: r for r in t.toxicity(docs, labels).collect()}
    assert len(got) == 600
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    out = [i for i, r in got.items() if r["held_out"]]
    assert np.mean([got[i]["predicted"] == (i % 5 == 0) for i in out]) > 0.97
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in t.toxicity(docs, flipped).collect()}
    assert again == {i: r["score"] for i, r in got.items()}
    clean = t.nontoxic(docs, *t.fit(docs, labels))
    assert clean.schema == docs.schema and {r["doc_id"] for r in clean.collect()} == {i for i, r in got.items() if not r["predicted"]}
    assert t.toxicity(odd, labels).count() == odd.count() and t.toxicity(make([]), labels).count() == 0
    assert {r["score"] for r in t.toxicity(odd, labels.limit(0)).collect()} == {0.0}


def brute_ftrl(rows, labels):
    """FTRL-proximal, one coordinate at a time."""
    seen = {}
    for x in rows:
        for f in x:
            seen[f] = seen.get(f, 0) + 1
    z, n = {}, {}

    def weight(f):
        zf = z.get(f, 0.0)
        if f != "bias" and abs(zf) <= t.L1:
            return 0.0
        return -(zf - np.sign(zf) * t.L1) / ((t.BETA + np.sqrt(n.get(f, 0.0))) / t.ALPHA + t.L2)

    order = np.random.default_rng(0)
    for _ in range(t.EPOCHS):
        for k in order.permutation(len(rows)):
            have = [*(f for f in rows[k] if seen[f] >= t.LEAST), "bias"]
            ws = [weight(f) for f in have]
            g = 1 / (1 + np.exp(-sum(ws))) - labels[k]
            for f, w in zip(have, ws, strict=True):
                sigma = (np.sqrt(n.get(f, 0.0) + g * g) - np.sqrt(n.get(f, 0.0))) / t.ALPHA
                z[f] = z.get(f, 0.0) + g - sigma * w
                n[f] = n.get(f, 0.0) + g * g
    return {f: weight(f) for f in z}


def test_training_against_one_coordinate_at_a_time():
    r = np.random.default_rng(1)
    labels = [int(x) for x in r.integers(0, 2, 120)]
    rows = [sorted({*r.integers(0, 60, 12).tolist(), *([1000 + int(r.integers(0, 3))] if y else [])}) for y in labels]
    weights, bias = t.train([np.array(x, "<u4").tobytes() for x in rows], labels)
    want = brute_ftrl(rows, labels)
    assert np.isclose(bias, want.pop("bias"))
    got = {int(f): float(weights[f]) for f in np.flatnonzero(weights)}
    assert got.keys() == {f for f, w in want.items() if w} and all(np.isclose(got[f], want[f], rtol=1e-5) for f in got)


def test_bias_is_found_on_rows_not_trained_on():
    toxic, clean = ([np.array([f, 9], "<u4").tobytes() for f in fs] for fs in ([1] * 9 + [3], [2] * 40))
    shift = t.cut_point(toxic + clean, [1] * 10 + [0] * 40)
    weights, bias = t.train(toxic + clean, [1] * 10 + [0] * 40)
    assert weights[1] + weights[9] + bias + shift > 0 > weights[2] + weights[9] + bias + shift
    assert t.cut_point(toxic[:2] + clean, [1] * 2 + [0] * 40) == 0.0


def test_repeated_rows_count_once(spark, make):
    rows = [(i, prose(i, 30) + (" nasty" if i % 2 else "")) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    weights, bias = t.fit(make(rows), labels)
    again, same = t.fit(make(rows * 3), labels.union(labels))
    assert np.array_equal(weights, again) and bias == same


def test_word_hashes_are_of_the_words_alone():
    a = t.features(["Foo, bar", "x"])
    b = t.features(["bar", "", "(foo) BAR!"])
    assert set(a[1][a[0] == 0]) == set(b[1][b[0] == 2]) and not (b[0] == 1).any()
