"""The pipeline's stages against brute force, each on its own input."""

import random
from collections import defaultdict

import corpus_pipeline as c
import numpy as np
import pytest
from quillspace.llm import toxicity
from test_simhash import brute_components, brute_fp

from llm_texts import prose


def unlike(seed, n):
    return " ".join(f"{w}{seed}" if i % 2 else w for i, w in enumerate(prose(seed, n).split()))


ITEM = unlike(5000, 30)
SHARED = unlike(6000, 40)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r, out = random.Random(2), str(tmp_path_factory.mktemp("sf"))
    rows = [(i, unlike(i, 120)) for i in range(60)]
    rows += [(100 + i, unlike(100 + i, 60) + f" nasty{i % 2} words{i % 3} here " + prose(i, 5)) for i in range(40)]
    copy = rows[7][1]
    rows += [(200, copy), (201, copy), (202, copy.replace(copy.split()[60], "other", 1))]
    rows += [(210 + i, f"{unlike(210 + i, 50)} {SHARED} {unlike(310 + i, 50)}") for i in range(5)]
    rows += [(220, f"{unlike(220, 40)} {ITEM} {unlike(221, 40)}"), (230, None), (231, ""), (None, unlike(240, 50))]
    r.shuffle(rows)
    docs = spark.createDataFrame([(k, t, "en", "s", None if t is None else len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 140)) for i in [*range(60), *range(100, 140)]], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, unlike(7000, 30)), (3, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def keys(rows):
    return {r["doc_id"] for r in rows}


def test_stages(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    docs, stages = read("documents"), dict(c.STAGES)
    assert list(stages) == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "sum_of_squares_packing"]
    before = docs.collect()

    scores = {(r["doc_id"]): r["score"] for r in toxicity.toxicity(docs, read("labels")).collect()}
    clean = stages["toxicity"](spark, docs, sf_dir)
    after = clean.collect()
    assert clean.schema.names == docs.schema.names
    assert keys(after) == {k for k in keys(before) if scores[k] < 0.5}
    assert not keys(after) & set(range(100, 140))
    assert set(range(60)) <= keys(after)

    single = stages["simhash_near_dedup"](spark, clean, sf_dir)
    roots = brute_components([brute_fp(r["text"]) for r in after])
    groups = defaultdict(list)
    for r, root in zip(after, roots, strict=True):
        groups[root].append(r["doc_id"])
    want = {min((k for k in g if k is not None), default=None) for g in groups.values()} | {None}
    rows = single.collect()
    assert keys(rows) == want
    assert 7 in want and not {200, 201} & want
    assert single.schema.names == docs.schema.names

    cut = stages["suffix_array_dedup"](spark, single, sf_dir)
    seen, texts = set(), {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        raw = (r["text"] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        texts[r["doc_id"]] = None if r["text"] is None else bytes(x for x, g in zip(raw, gone, strict=True) if not g).decode()
    kept = cut.collect()
    assert {r["doc_id"]: r["text"] for r in kept} == texts
    assert sum(SHARED in (t or "") for t in texts.values()) == 1
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in kept)

    fair = stages["benchmark_decontamination"](spark, cut, sf_dir)
    assert keys(fair.collect()) == keys(kept) - {220}
    assert fair.schema.names == docs.schema.names

    packed = stages["sum_of_squares_packing"](spark, fair, sf_dir).collect()
    assert keys(packed) == keys(kept) - {220}
    rooms = defaultdict(list)
    for r in packed:
        rooms[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in rooms.values():
        assert [a for a, _ in sorted(parts)] == list(np.cumsum([0, *(n for _, n in sorted(parts))])[:-1])
        assert sum(n for _, n in parts) <= 1024

    whole = c.run(spark, sf_dir).collect()
    digest = lambda rows: sorted((str(r["doc_id"]), r["piece"], r["length"], r["ids_crc32"]) for r in rows)
    assert digest(whole) == digest(packed)
    assert all(0 <= r["ids_crc32"] <= 0xFFFFFFFF for r in whole)


def test_near_duplicates_go_by_row(spark, make):
    one, two, three, four = (unlike(k, 80) for k in (8001, 8002, 8003, 8004))
    docs = make([(1, one), (2, one), (2, two), (3, three), (3, three), (3, three), (4, three), (5, four), (None, four)])
    kept = c.drop_near_duplicates(spark, docs, "")
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted([("1", one), ("2", two), ("3", three), ("5", four), ("None", four)])
    assert kept.schema.names == docs.schema.names
