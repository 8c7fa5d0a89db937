import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspace.__main__ import main
from quillspace.library import Library
from quillspace.operators import models as M
from quillspace.operators import simulate as E
from quillspace.sources import mapping as D
from quillspace.sources import readers as R
from quillspace.sources.export import export
from quillspace.sources.store import LibraryError
from quillspace.streaming import ingest

RECORDS = [
    ("a", "Dogs and cats", "The dog chased the cat. A cat bit the dog, and the dog ran home.", "Ann; Bob", "1990"),
    ("b", "Pets at home", "Cats sleep at home. Dogs sleep at home too; a dog likes its home.", "Ann", "1995"),
    ("c", "Stock markets", "Stocks fell and bonds rose. Markets rise when stocks rise.", "Cid", "2001"),
    ("d", "Bond traders", "Traders sold bonds. Markets fell and traders bought stocks.", "Cid; Bob", "2005"),
    ("e", "The of", "the of and", "Dee", "2006"),
    ("f", "", "", "Dee", "2007"),
]


def records(spark, rows=RECORDS):
    return spark.createDataFrame(rows, "id string, title string, abstract string, author string, year string")


@pytest.fixture(scope="module")
def lib(spark, tmp_path_factory):
    made = Library.create(spark, str(tmp_path_factory.mktemp("lib") / "one"), embedder="beagle-rp", embedder_params={"dim": 64, "nonzeros": 8})
    made.add_records(records(spark), source="table")
    blocks = spark.createDataFrame([("paper", p, k, " ".join(["market" if p == 2 else "dog", "words"] * 15) + f" end{p}{k}.", 0.2, 0.5) for p in (1, 2) for k in (0, 1)], "doc_id string, page int, block int, text string, top double, bottom double")
    made.add_documents(R.read_blocks(blocks, 40), "paper.blocks", "blocks")
    made.build()
    return made


def vectors(lib, space):
    return {r["label"]: np.array(r["vec"], np.float64) for r in lib.space(space).collect()}


def cosine(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / n) if n else 0.0


def test_spaces(lib):
    assert lib.info["spaces"]["document"] == 7
    assert set(lib.info["spaces"]) == {"document", "word", "chunk", "author", "year"}
    docs, authors = vectors(lib, "document"), vectors(lib, "author")
    np.testing.assert_allclose(authors["Ann"], docs["a"] + docs["b"], atol=1e-4)
    assert not docs["f"].any()
    assert docs["e"].any()  # stop words alone are kept
    chunks = vectors(lib, "chunk")
    np.testing.assert_allclose(sum(chunks.values()), docs["paper"], atol=1e-4)
    first = lib.spark.read.parquet(lib.folder.at(f"{lib.info['path']}/vocab")).orderBy("row").limit(3).collect()
    assert [r["token"] for r in first] == ["dogs", "and", "cats"]


@pytest.mark.parametrize("mode", ["compound", "and", "or"])
def test_semantic_search_against_numpy(lib, mode):
    words, docs = vectors(lib, "word"), vectors(lib, "document")
    found = lib.search("The dog's home unheard", mode, k=None)
    assert found.unknown == ["dogs"] or found.unknown == ["unheard"] or set(found.unknown) <= {"dogs", "unheard"}
    terms = found.terms
    assert "the" not in terms
    each = {t: {k: cosine(words[t], v) for k, v in docs.items()} for t in terms}
    if mode == "compound":
        want = {k: cosine(sum(words[t] for t in terms), v) for k, v in docs.items()}
    elif len(terms) == 1:
        want = each[terms[0]]
    elif mode == "and":
        want = {k: float(np.prod([each[t][k] for t in terms])) for k in docs}
    else:
        want = {k: max(each[t][k] / (abs(max(each[t].values())) or 1) for t in terms) for k in docs}
    rows = found.rows()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["score"] == pytest.approx(want[r["label"]], abs=1e-9)
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)


def test_related_documents_are_nearer(lib):
    scores = {r["label"]: r["score"] for r in lib.search("bonds", k=None).rows()}
    assert min(scores["c"], scores["d"]) > max(scores["a"], scores["b"])


def test_lexical_finds_matches_only_and_keeps_stop_words(lib):
    rows = lib.search("the", method="lexical", k=None).rows()
    assert {r["label"] for r in rows} == {"a", "e"}
    assert not lib.search("zebra", method="lexical").rows()
    assert lib.search("zebra").unknown == ["zebra"]


def test_hybrid_without_weight_is_semantic(lib):
    a = [r["label"] for r in lib.search("dog home", k=None).rows()]
    b = lib.search("dog home", method="hybrid", lexical_weight=0.0, k=None).rows()
    assert [r["label"] for r in b] == a
    assert {"semantic", "lexical"} <= set(b[0])


def test_filters_come_after_ranking(lib):
    where = F.element_at("factors", "year")[0] >= "2000"
    every = {r["label"]: r["score"] for r in lib.search("dog markets", method="hybrid", k=None).rows()}
    some = lib.search("dog markets", method="hybrid", where=where, k=None).rows()
    assert {r["label"] for r in some} == {"c", "d", "e", "f"}
    assert all(every[r["label"]] == r["score"] for r in some)
    with pytest.raises(LibraryError):
        lib.search("dog", space="author", where=where)


def test_similar(lib):
    rows = lib.similar("a", k=2).orderBy("rank").collect()
    assert rows[0]["label"] == "a"
    assert rows[0]["score"] == pytest.approx(1)
    assert {r["label"] for r in lib.similar("Cid", "author", "author", 1).collect()} == {"Cid"}
    words = [r["label"] for r in lib.similar("dog", "word", k=None).collect()]
    assert "the" not in words
    assert "the" in [r["label"] for r in lib.similar("dog", "word", k=None, include_stopwords=True).collect()]
    chunk = lib.search("market", space="chunk", k=1).rows()[0]
    assert chunk["chunk"]["page"] == 2
    with pytest.raises(KeyError):
        lib.similar("nobody", "author")


def test_lookups(lib):
    assert lib.document("a")["factors"]["author"] == ["Ann", "Bob"]
    assert lib.chunk("paper#1")[1]["page"] == 1
    for bad in ("paper#9", "a#1", "x"):
        with pytest.raises(KeyError):
            lib.chunk(bad)


@pytest.mark.parametrize("bad", [{"mode": "xor"}, {"method": "magic"}, {"method": "lexical", "space": "word"}, {"lexical_weight": 2.0}])
def test_wrong_searches(lib, bad):
    with pytest.raises(ValueError):
        lib.search("dog", **bad)
    with pytest.raises(LibraryError):
        lib.search("dog", space="nowhere")


def test_project(lib):
    rows = lib.project(["a", "b", "c", "d"], clusters=2).collect()
    assert len(rows) == 4
    assert rows[0]["cluster"] == 0


def test_export(lib, tmp_path):
    out = str(tmp_path / "out")
    manifest = export(lib, out, min_count=2)
    sizes = {s["name"]: s["n"] for s in manifest["spaces"]}
    assert sizes["document"] == 7
    assert sizes["word"] < lib.info["vocab_size"]
    place = {s["name"]: s["path"] for s in manifest["spaces"]}
    docs = vectors(lib, "document")
    for r in lib.spark.read.parquet(f"{out}/{place['document']}").collect():
        v = np.array(r["q"], np.float64) * r["scale"]
        assert cosine(v, docs[r["label"]]) > 0.999 or not docs[r["label"]].any()
    listed = {r["title"]: r for r in lib.spark.read.json(f"{out}/documents").collect()}
    authors = {r["row"]: r["label"] for r in lib.space("author").collect()}
    assert [authors[k] for k in listed["Dogs and cats"]["factor:author"]] == ["Ann", "Bob"]
    assert listed["Dogs and cats"]["year"] == "1990"
    assert lib.spark.read.json(f"{out}/passages").count() == lib.info["spaces"]["chunk"]
    export(lib, out, "float32")
    (tmp_path / "full").mkdir()
    (tmp_path / "full" / "x").write_text("x")
    with pytest.raises(LibraryError):
        export(lib, str(tmp_path / "full"))


def test_adding_replacing_and_staleness(spark, tmp_path):
    lib = Library.create(spark, str(tmp_path / "l"), embedder="random", embedder_params={"dim": 16})
    with pytest.raises(LibraryError):
        lib.build()
    with pytest.raises(LibraryError):
        Library.create(spark, str(tmp_path / "l"))
    with pytest.raises(LibraryError):
        Library(spark, str(tmp_path / "none"))
    path = tmp_path / "x.jsonl"
    path.write_text('{"id": "1", "text": "one dog"}\n{"id": "2", "text": "two cats"}\n')
    assert lib.add_path(str(path)) == 2
    assert lib.add_path(str(path)) is None
    assert not lib.is_built
    lib.build()
    assert not lib.is_stale
    path.write_text('{"id": "1", "text": "a cow"}\n{"id": "3", "text": "two cats"}\n')
    assert lib.add_path(str(path)) == 2
    assert lib.is_stale  # as many documents as before
    assert {r["id"] for r in lib.store.documents().collect()} == {"1", "3"}
    with pytest.raises(LibraryError):
        lib.add_records(records(spark, [("3", "t", "x", "y", "z")]))
    with pytest.raises(LibraryError):
        lib.add_records(records(spark, [("9", "t", "x", "y", "z"), ("9", "t", "x", "y", "z")]))
    assert lib.store.count() == 2
    lib.build()
    assert lib.search("cow", k=1).rows()[0]["label"] == "1"


def test_same_build_twice(spark, lib):
    before = vectors(lib, "word")
    lib.build()
    after = vectors(lib, "word")
    for w in before:
        np.testing.assert_allclose(before[w], after[w], atol=1e-6)


def test_evaluate(lib):
    plan = E.Plan(["beagle-rp", "bm25", "wordmatch", "hybrid"], [50, 100], 4, [1, 2, 3], reference="beagle-rp", params={"beagle-rp": {"dim": 64, "nonzeros": 8}}, min_tokens=5)
    results = lib.evaluate(plan)
    full = {(r["method"]): r["median_rank"] for r in results.rank_summary().where("simulation = 1 and percent = 100").collect()}
    assert full["beagle-rp"] == 1
    assert full["bm25"] == 1
    assert results.ranks.count() == 2 * 2 * 4 * 4
    assert results.agreement.count() == 2 * 4 * 6
    assert all(-1 <= r["rho"] <= 1 for r in results.agreement.collect())
    outside = lib.evaluate(E.Plan(["beagle-rp"], [100], 3, [2], reference="beagle-rp", params={"beagle-rp": {"dim": 64, "nonzeros": 8}}, min_tokens=5, associates="outside-document"))
    assert outside.ranks.count() == 3
    for bad in ({"methods": []}, {"methods": ["bm25", "bm25"]}, {"associates": "x"}, {"n_targets": 0}):
        with pytest.raises(ValueError):
            E.Plan(**bad)


def test_commands(spark, tmp_path, capsys):
    root, path, odd = str(tmp_path / "c"), tmp_path / "a.csv", tmp_path / "odd.json"
    path.write_text("id,title,author,year\n1,Dogs bark at cats,Ann,1990\n2,Markets fall on bonds,Bob,2000\n")
    odd.write_text(json.dumps([{"nothing": 1}]))
    run = lambda *a: main([str(x) for x in a], spark)
    assert run("init", root, "--embedder", "random") == 0
    assert run("init", root) == 2
    assert run("add", root, odd, path) == 2
    assert run("build", root, "--dim", 32, "--param", "seed=3") == 0
    capsys.readouterr()
    assert run("search", root, "dogs", "--json", "--years", "1985-1995") == 0
    found = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert [h["label"] for h in found["hits"]] == ["1"]
    assert run("search", root, "zzz") == 1
    assert run("similar", root, "Ann", "--space", "author", "--target", "document", "-k", 1) == 0
    assert "Dogs" in capsys.readouterr().out
    assert run("similar", root, "nobody") == 2
    assert run("info", root) == 0
    assert run("embedders") == 0
    assert run("export", root, tmp_path / "x") == 0
    assert run("evaluate", root, "--methods", "random,bm25", "--percent", 100, "-n", 2, "--simulations", 1, "--min-tokens", 2, "--reference", "random", "--dim", 32, "--out", tmp_path / "r.json") == 0
    assert len(json.loads((tmp_path / "r.json").read_text())["ranks"]) == 4


def test_a_watched_folder(spark, tmp_path):
    lib = Library.create(spark, str(tmp_path / "w"), embedder="random", embedder_params={"dim": 16})
    (tmp_path / "in").mkdir()
    stream = lambda: spark.readStream.schema("id string, text string").json(str(tmp_path / "in"))
    for k in (1, 2):
        (tmp_path / "in" / f"{k}.jsonl").write_text(json.dumps({"id": str(k), "text": f"dog number{k}"}) + "\n")
        ingest.watch(lib, stream(), str(tmp_path / "check"), once=True).awaitTermination()
        assert lib.store.count() == k
    query = ingest.term_counts(stream()).writeStream.format("memory").queryName("seen_terms").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["token"]: r["n"] for r in spark.table("seen_terms").collect()} == {"dog": 2, "number1": 1, "number2": 1}
    timed = spark.readStream.schema("ts timestamp, text string").json(str(tmp_path / "in"))
    assert ingest.windowed_term_counts(timed, "ts").isStreaming


def test_a_control_is_built_without_sentences(spark, tmp_path):
    """Its spaces are sums of environments, and its tables those of the sentences' tokens."""
    made = Library.create(spark, str(tmp_path / "control"), embedder="random", embedder_params={"dim": 16, "environment": "ternary", "nonzeros": 4})
    made.add_records(records(spark), source="table")
    blocks = spark.createDataFrame([("paper", p, 0, " ".join(["market" if p == 2 else "dog", "words"] * 30) + f" end{p}.", 0.2, 0.5) for p in (1, 2)], "doc_id string, page int, block int, text string, top double, bottom double")
    made.add_documents(R.read_blocks(blocks, 40), "paper.blocks", "blocks")
    info = made.build()
    assert "sentences" not in made.folder.names(info["path"])
    tokens = made.sentences().select("doc", "unit", "sent", F.posexplode("words").alias("pos", "token"))
    order = [r["token"] for r in tokens.orderBy("doc", "unit", "sent", "pos").collect()]
    vocab = {r["token"]: (r["row"], r["n"]) for r in made._table("vocab").collect()}
    assert vocab == {t: (k + 1, order.count(t)) for k, t in enumerate(dict.fromkeys(order))}
    want = {(r["doc"], r["token"]): r["n"] for r in tokens.groupBy("doc", "token").agg(F.count("*").alias("n")).collect()}
    assert {(r["doc"], r["token"]): r["tf"] for r in made._table("terms").collect()} == want
    assert {r["doc"]: r["len"] for r in made._table("lengths").collect()} == {d: sum(n for (e, _), n in want.items() if e == d) for d in range(1, 8)}
    words, docs, chunks = vectors(made, "word"), vectors(made, "document"), vectors(made, "chunk")
    assert np.array_equal(words["dog"], M.environment("dog", made.model))
    np.testing.assert_array_equal(sum(chunks.values()), docs["paper"])
    assert docs["e"].any() and not docs["f"].any()
