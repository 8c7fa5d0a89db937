"""What a build takes from its texts in one pass."""

import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillspace.functions import text as T
from quillspace.library import Library
from quillspace.operators import models as M
from quillspace.plans import library_queries as Q
from quillspace.sources import mapping as D
from quillspace.sources.store import LibraryError

TEXTS = [["The dog's café. It ran! " * 9, "ÉCOLE the. " * 5], [], None, ["", None, "one 22"], ["a. b. c. a the"], ["the the"]]


def test_one_pass_counts_composes_and_gathers_by_word(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"d{k}", t, k in (0, 3)) for k, t in enumerate(TEXTS)], "doc long, id string, units array<string>, parted boolean").coalesce(1)
    words = {d: Counter(w for t in units or [] for w in T.tokens_of(t or "")) for d, units in enumerate(TEXTS)}
    for model in (M.make("random", dim=16, environment="ternary", nonzeros=4, stopwords=("the", "a")), M.make("beagle", dim=16)):
        for posted, group, held in ((1, 32, 16), (T.PIECE, M.GROUP, M.HELD)):
            for name, value in (("POSTED", posted), ("GROUP", group), ("HELD", held)):
                monkeypatch.setattr(M, name, value)
            made = M.indexed(docs, "doc", F.col("units"), F.col("parted"), model)
            assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
            rows = made.collect()
            own = {(r["doc"], r["unit"]): r for r in rows if r["token"] is None}
            assert len(rows) > len(own) and set(own) == {(d, None) for d in range(6)} | {(0, 0), (0, 1), (3, 0), (3, 1), (3, 2)}
            assert {d: own[d, None]["len"] for d in range(6)} == {d: w.total() for d, w in words.items()}
            assert own[3, 2]["id"] == "d3" and own[3, 2]["len"] == 1
            if model.learns:
                assert all(dict(zip(own[d, None]["tokens"], own[d, None]["tfs"], strict=True)) == w for d, w in words.items())
            else:
                for d, w in words.items():
                    told = {t: n for t, n in w.items() if t not in model.stop} or w
                    np.testing.assert_array_equal(own[d, None]["vec"], sum((n * M.environment(t, model) for t, n in told.items()), np.zeros(16)))
                np.testing.assert_array_equal(np.add(own[0, 0]["vec"], own[0, 1]["vec"]), own[0, None]["vec"])
            got, first = {}, {}
            for r in rows:
                if r["token"] is not None:
                    pairs = dict(zip(r["docs"], r["counts"], strict=True)) if r["docs"] else {r["first"]: r["n"]}
                    assert min(pairs) == r["first"] and sum(pairs.values()) == r["n"]
                    assert not got.keys() & {(d, r["token"]) for d in pairs}
                    got |= {(d, r["token"]): n for d, n in pairs.items()}
                    assert list(words[r["first"]])[r["place"]] == r["token"]
            assert got == {(d, t): n for d, w in words.items() for t, n in w.items()}


def test_draws_side_by_side_are_those_one_by_one():
    starts = [b"0#" + b"x" * k + "é".encode() * (k % 3) + b"#" for k in range(90)]
    for first, n in ((0, 4), (95, 20)):
        want = [[int(hashlib.md5(s + b"%d" % draw).hexdigest()[:8], 16) for draw in range(first, first + n)] for s in starts]
        assert M._drawn(starts, first, n).tolist() == want
    crowded = M.make("random", dim=6, environment="ternary", nonzeros=6)  # places come twice, and again among later draws
    for token, row in zip(words := [f"w{k}" for k in range(300)], M.environment_rows(words, crowded), strict=True):
        places, draw = {}, 0
        while len(places) < 6:
            places[int(hashlib.md5(f"0#{token}#{draw}".encode()).hexdigest()[:8], 16) % 6] = None
            draw += 1
        assert [row[p] for p in places] == [1, 1, 1, -1, -1, -1]


def test_a_build_reads_its_counts_once(spark, tmp_path, monkeypatch):
    """Documents are composed where they are counted; rows of counts are not written and read again for it."""
    for name in ("composed", "composed_of_rows"):
        monkeypatch.setattr(M, name, None)
    lib = Library.create(spark, str(tmp_path / "one"), embedder="random", embedder_params={"dim": 16})
    lib.add_records(spark.createDataFrame([("a", "dog cat dog"), ("b", "cat"), ("c", None)], "id string, text string"), D.FieldMapping.from_options(["text"], [], "id"))
    lib.build()
    assert {(r["token"], r["n"]) for r in lib._table("vocab").collect()} == {("dog", 2), ("cat", 2)}
    got = {r["label"]: np.array(r["vec"]) for r in lib.space("document").collect()}
    np.testing.assert_allclose(got["a"], 2 * M.environment("dog", lib.model) + M.environment("cat", lib.model), atol=1e-6)
    assert not got["c"].any()


def test_texts_are_cut_as_their_tokens_are(monkeypatch):
    odd = ["", " ", "a", "it's 'quoted' a''b x_'y o’c'd '", "1 22 x2 ²", "É’e ﬁ ½ ß\u200bz 日本 Ⅷ", "a\tb\x1cc", "'", "9"]
    for mode in T.MODES:
        row, words = T.cut([T.spaced(x, mode) for x in odd])
        got = [[w for r, w in zip(row.tolist(), words.to_pylist(), strict=True) if r == k and not (mode == "unicode" and w.isdecimal())] for k in range(len(odd))]
        assert got == [T.tokens_of(x, mode) for x in odd]
        assert [list(T.terms_of(x, mode)) for x in odd] == [list(dict.fromkeys(x)) for x in got]
    assert T.fold("it's 'q' a''b x_'y o’c'd") == "its 'q' a''b x_y ocd"


def test_a_word_is_gathered_once_for_many_documents(spark):
    """Posted lists are of millions of bytes of text, so their number grows little with the documents."""
    docs = spark.createDataFrame([(k, str(k), [" ".join(f"w{j}" for j in range(500))], False) for k in range(2000)], "doc long, id string, units array<string>, parted boolean").coalesce(1)
    made = M.indexed(docs, "doc", F.col("units"), F.col("parted"), M.make("random", dim=8, environment="ternary", nonzeros=2))
    lists = made.where("token is not null").select("token", F.size("docs").alias("n"), "first").collect()
    assert len(lists) == 500 and all((r["n"], r["first"]) == (2000, 0) for r in lists)


def test_a_build_of_parts_makes_no_more_and_keeps_what_there_is(spark, tmp_path):
    lib = Library.create(spark, str(tmp_path / "parts"), embedder="random", embedder_params={"dim": 16})
    rows = spark.createDataFrame([("a", "dog cat dog", "x"), ("b", "cat", "y"), ("c", None, "x")], "id string, text string, terms string")
    lib.add_records(rows, D.FieldMapping.from_options(["text"], ["terms"], "id"))
    first = lib.build(parts=["vocab"])
    assert set(lib.folder.names(first["path"])) == {"lengths", "vocab"} and not first["spaces"]
    second = lib.build(parts=["document", "vocab"])
    assert set(lib.folder.names(second["path"])) == {"space=document"}
    assert lib._table("vocab").count() == 2 and lib.space("document").count() == 3
    assert second["mean_length"] == first["mean_length"] == 4 / 3
    third = lib.build(parts=["terms"])  # a table and a factor of one name
    assert set(lib.folder.names(third["path"])) == {"terms", "space=terms"}
    assert {r["label"] for r in lib.space("terms").collect()} == {"x", "y"} and lib._table("terms").count() == 3
    try:
        lib.build(parts=["nothing"])
        raise AssertionError
    except LibraryError as e:
        assert "nothing" in str(e)
    lib.add_records(spark.createDataFrame([("d", "cow", "z")], "id string, text string, terms string"), D.FieldMapping.from_options(["text"], ["terms"], "id"), "more")
    assert set(lib.folder.names(lib.build(parts=["vocab"])["path"])) == {"lengths", "vocab"} and lib._table("vocab").count() == 3
    whole = lib.build()
    assert set(whole["spaces"]) == {"document", "word", "terms"} and {"terms", "vocab", "lengths", "space=word"} <= set(lib.folder.names(whole["path"]))


def test_ids_reach_terms_without_moving_them(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"d{k}") for k in (1, 2, 99, 100, 101, 250, 1000)], "row long, id string")
    rows = spark.createDataFrame([(k, w) for k in (1, 99, 100, 101, 1000, 5) for w in "ab"], "doc long, token string")
    want = {(k, w, f"d{k}") for k in (1, 99, 100, 101, 1000) for w in "ab"}
    made = Q._with_ids(rows, docs)
    assert {(r["doc"], r["token"], r["id"]) for r in made.collect()} == want and made.count() == 10
    assert "SortMergeJoin" not in made._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(Q, "ID_BYTES", 10)
    assert {(r["doc"], r["token"], r["id"]) for r in Q._with_ids(rows, docs).collect()} == want


def test_the_query_of_a_factor_space_builds_what_it_reads(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(Q, "_BUILT", {})
    assert Q.library_factor_space(spark, sf_dir).count()
    (lib,) = Q._BUILT.values()
    assert set(lib.info["tables"]) == {"lengths", "space=document", "space=lang"}
