import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspace.functions import vector as V
from quillspace.operators import models as M
from quillspace.operators import space as X

SENTENCES = [["the", "dog", "bit", "the", "mailman"], ["a", "dog", "ran"], ["stocks", "fell"], ["alone"], ["the", "mailman", "ran"]]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = spark.createDataFrame([(k // 2, k % 2, w) for k, w in enumerate(SENTENCES)], "doc long, sent long, words array<string>")
    return rows, rows.select(F.explode("words").alias("token")).distinct()


def learned(corpus, model):
    return {r["token"]: np.array(r["vec"]) for r in M.word_vectors(*corpus, model).collect()}


def unit(v):
    n = np.linalg.norm(v)
    return v / n if n else v


def test_environments_are_functions_of_seed_and_word():
    model = M.make("random", dim=64, environment="ternary", nonzeros=6)
    v = M.environment("dog", model)
    assert (v == 1).sum() == (v == -1).sum() == 3
    assert np.array_equal(v, M.environment("dog", model))
    assert not np.array_equal(v, M.environment("cat", model))
    gaussian = M.environment("dog", M.make("random", dim=4096))
    assert abs(np.linalg.norm(gaussian) - 1) < 0.1


@pytest.mark.parametrize("name", ["beagle", "beagle-rp"])
def test_memories_against_loops(corpus, name):
    dim = 32
    model = M.make(name, dim=dim, stopwords=("the", "a"), nonzeros=4, **({"max_ngram": 3} if name == "beagle" else {}))
    context, order = {}, {}
    binding = X.Binding(dim, 0)
    for s in SENTENCES:
        if len(s) < 2:
            continue
        for i, w in enumerate(s):
            context.setdefault(w, np.zeros(dim))
            order.setdefault(w, np.zeros(dim))
            for j, o in enumerate(s):
                if i != j and o not in ("the", "a"):
                    context[w] += M.environment(o, model)
                if name == "beagle-rp" and 0 < abs(j - i) <= 2:
                    order[w] += np.roll(M.environment(o, model), j - i)
            if name == "beagle":
                for a in range(len(s)):
                    for b in range(a + 2, min(len(s), a + 3) + 1):
                        if a <= i < b:
                            parts = [binding.phi if k == i else M.environment(s[k], model) for k in range(a, b)]
                            chain = parts[0]
                            for p in parts[1:]:
                                chain = binding.bind(chain, p)
                            order[w] += chain
    got = learned(corpus, model)
    assert set(got) == {w for s in SENTENCES for w in s}
    assert not got["alone"].any()
    for w in context:
        np.testing.assert_allclose(got[w], unit(context[w]) + unit(order[w]), atol=1e-5)


def test_dog_has_seven_order_terms():
    binding = X.Binding(16, 0)
    x = np.random.default_rng(0).standard_normal((5, 16))
    count = 0

    class Counting(X.Binding):
        def _joined(self, a, b):
            return super()._joined(a, b)

    for a in range(5):
        for b in range(a + 2, 6):
            count += a <= 1 < b
    assert count == 7
    assert Counting(16, 0).order(x, 5).shape == binding.order(x, 5).shape


def test_binding_does_not_commute():
    b = X.Binding(64, 1)
    x, y = np.random.default_rng(1).standard_normal((2, 64))
    assert np.abs(b.bind(x, y) - b.bind(y, x)).max() > 0.1


def test_fold_against_a_loop(corpus):
    model = M.make("beagle-legacy", dim=32, nonzeros=4)
    scale = lambda v: v / (abs(v.max()) or 1)
    memory = {w: M.environment(w, model) for s in SENTENCES for w in s}
    for s in SENTENCES:
        if len(s) > 1:
            total = sum(M.environment(w, model) for w in s)
            for w in s:
                memory[w] = scale(memory[w] + scale(total - M.environment(w, model)))
    got = learned(corpus, model)
    for w, v in memory.items():
        np.testing.assert_allclose(got[w], v, atol=1e-5)


def test_any_partitioning_gives_the_same_sums(corpus):
    model = M.make("beagle-rp", dim=48, nonzeros=6)
    a = learned(corpus, model)
    b = learned((corpus[0].repartition(7, "words"), corpus[1]), model)
    for w in a:
        np.testing.assert_allclose(a[w], b[w], atol=1e-6)


def test_composition_drops_stop_words_unless_nothing_else(spark, corpus):
    model = M.make("random", dim=16, stopwords=("the", "a"))
    words = M.word_vectors(*corpus, model)
    counts = spark.createDataFrame([(1, "the", 3), (1, "dog", 2), (2, "the", 1), (3, "unknown", 1)], "doc long, token string, tf long")
    docs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "doc long")
    got = {r["doc"]: np.array(r["vec"]) for r in M.composed(docs, counts, words, model, "doc").collect()}
    np.testing.assert_allclose(got[1], 2 * M.environment("dog", model), atol=1e-6)
    np.testing.assert_allclose(got[2], M.environment("the", model), atol=1e-6)
    assert not got[3].any()
    assert not got[4].any()
    assert M.query_terms(["the", "dog", "dog", "x"], {"the", "dog"}.__contains__, model) == ["dog"]
    assert M.query_terms(["the"], {"the"}.__contains__, model) == ["the"]


def test_models_by_name():
    assert set(M.MODELS) == {"beagle", "beagle-legacy", "beagle-rp", "random"}
    model = M.make("beagle", dim=8)
    assert M.Model(**model.config()) == model
    for name, params in [("nothing", {}), ("beagle", {"odd": 1}), ("beagle", {"max_ngram": 1}), ("beagle-rp", {"nonzeros": 3}), ("beagle", {"context": False, "order": False}), ("beagle-legacy", {"order": True})]:
        with pytest.raises(ValueError):
            M.make(name, **params)


def test_composition_of_many_words_moves_each_vector_once_to_a_group(spark, corpus, monkeypatch):
    """Above the broadcast limit, and of environments alone; both against plain sums, on any batches."""
    rng = np.random.default_rng(0)
    rows = [(d, f"w{w}", int(t)) for d in range(300) for w, t in zip(rng.choice(900, 7, replace=False), rng.integers(1, 9, 7), strict=True)]
    counts = spark.createDataFrame(rows, "doc long, token string, tf long").repartition(5)
    docs = spark.createDataFrame([(d,) for d in range(302)], "doc long")
    model = M.make("random", dim=16, environment="ternary", nonzeros=4)
    known = spark.createDataFrame([(f"w{w}",) for w in range(0, 900, 2)], "token string")
    monkeypatch.setattr(M, "GROUP", 16 * 13)
    monkeypatch.setattr(M, "SUMMED", 16 * 40)

    def sums(words):
        return {r["doc"]: np.array(r["vec"]) for r in M.composed(docs, counts, words, model, "doc").collect()}

    every, some = sums(None), {}
    for limit in (0, M.BROADCAST_BYTES):
        monkeypatch.setattr(M, "BROADCAST_BYTES", limit)
        some[limit] = sums(M.environments(known, model))
    for d in range(302):
        want = lambda step: sum((t * M.environment(w, model) for e, w, t in rows if e == d and int(w[1:]) % step == 0), np.zeros(16))
        np.testing.assert_array_equal(every[d], want(1))
        for got in some.values():
            np.testing.assert_allclose(got[d], want(2), atol=1e-9)
    plans = []
    for limit in (0, 16 * 8 * 30):  # the plan does not grow with the words
        monkeypatch.setattr(M, "BROADCAST_BYTES", limit)
        plans.append(M.composed(docs, counts, M.environments(known, model), model, "doc")._jdf.queryExecution().analyzed().toString())
    assert plans[0].count("MapInArrow") == plans[1].count("MapInArrow") < 5
    with pytest.raises(ValueError):
        M.composed(docs, counts, None, M.make("beagle", dim=16), "doc")


def test_nearest_in_small_pieces_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = rng.integers(-2, 3, (120, 4)).astype(float)  # many ties
    space = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(rows)], "label long, vec array<double>").repartition(3)
    monkeypatch.setattr(X, "SCORES", 50)
    monkeypatch.setattr(X, "QUERIES", 4 * 17)
    asked = space.where("label % 3 = 0 or label > 110")
    got = {(r["query"], r["rank"]): (r["label"], r["score"]) for r in X.nearest(space, asked, 4).collect()}
    unit_rows = np.array([unit(r) for r in rows])
    scores = np.round(unit_rows @ unit_rows.T, 9)
    for q in range(120):
        if q % 3 and q <= 110:
            continue
        best = sorted((-scores[q, j], j) for j in range(120) if j != q)[:4]
        assert [got[q, n + 1] for n in range(4)] == [(j, pytest.approx(-s)) for s, j in best]


def test_partial_sums_hold_little(spark, corpus, monkeypatch):
    """A task gives its sums away when they are many, and they are added up again."""
    model = M.make("beagle-rp", dim=48, nonzeros=6)
    whole = learned(corpus, model)
    monkeypatch.setattr(M, "HELD", 500)
    monkeypatch.setattr(M, "GROUP", 300)
    parts = M._partial_sums(corpus[0].coalesce(1), model)
    assert parts.count() > M.memory_sums(corpus[0], model).count()
    for w, v in learned(corpus, model).items():
        np.testing.assert_allclose(whole[w], v, atol=1e-6)


def test_order_of_blocks_is_that_of_sentences(monkeypatch):
    binding, rng = X.Binding(16, 0), np.random.default_rng(1)
    for sizes in ([3, 2, 9, 2, 2, 5, 4], [30, 2], [2] * 20, [11]):
        x = rng.standard_normal((sum(sizes), 16))
        ends = np.cumsum(sizes)
        want = np.concatenate([binding.order(x[b - n : b], 4) for n, b in zip(sizes, ends, strict=True)])
        for rows in (1, 5, 8):
            monkeypatch.setattr(X, "ROWS", rows)
            np.testing.assert_allclose(binding.order(x, 4, np.array(sizes)), want, atol=1e-12)


def test_environments_made_together_are_those_made_alone():
    for model in (M.make("random", dim=24, environment="ternary", nonzeros=4), M.make("beagle", dim=8)):
        words = [f"w{k}" for k in range(50)]
        np.testing.assert_array_equal(M.environment_rows(words, model), np.stack([M.environment(w, model) for w in words]))
        np.testing.assert_array_equal(M.Environment(model).rows(words), M.environment_rows(words, model))


def test_rows_of_terms_compose_as_counts_do_and_are_not_moved(spark, monkeypatch):
    monkeypatch.setattr(M, "GROUP", 16 * 3)
    rows = [(1, ["the", "dog"], [3, 2]), (2, ["the", "a"], [1, 4]), (3, [], []), (None, ["x"], [1]), (5, [f"w{k % 9}" for k in range(9)], list(range(1, 10)))]
    docs = spark.createDataFrame([(k,) for k in range(1, 6)], "doc long")
    terms = spark.createDataFrame(rows, "doc long, tokens array<string>, tfs array<bigint>").coalesce(1)
    counts = terms.select("doc", F.posexplode(F.arrays_zip("tokens", "tfs")).alias("_p", "_t")).select("doc", F.col("_t.tokens").alias("token"), F.col("_t.tfs").alias("tf"))
    for model in (M.make("random", dim=16, stopwords=("the", "a")), M.make("random", dim=16, environment="ternary", nonzeros=4, compose_without_stopwords=False)):
        want = {r["doc"]: np.array(r["vec"]) for r in M.composed(docs, counts, None, model, "doc").collect()}
        got = {r["doc"]: np.array(r["vec"]) for r in M.composed_of_rows(docs, terms, model, "doc").collect()}
        assert set(got) == set(want) == {1, 2, 3, 4, 5}
        for d in got:
            np.testing.assert_allclose(got[d], want[d], atol=1e-6)
        assert got[2].any()
    with pytest.raises(ValueError):
        M.composed_of_rows(docs, terms, M.make("beagle", dim=16), "doc")


def test_environments_are_kept_in_few_rows(monkeypatch):
    """Emptied when they are many; the columns that come with words stay."""
    model = M.make("random", dim=24, environment="ternary", nonzeros=4)
    monkeypatch.setattr(M, "HELD", (24 + M.OVERHEAD) * 10)
    env, rng = M.Environment(model), np.random.default_rng(0)
    for _ in range(40):
        words = [f"w{k}" for k in rng.integers(0, 30, 7)]
        np.testing.assert_array_equal(env.rows(words), np.stack([M.environment(w, model) for w in words]))
        assert len(env._places) <= 10
    assert env.rows([]).shape == (0, 24)


def test_environments_keep_other_columns(spark):
    model = M.make("random", dim=24, environment="ternary", nonzeros=4)
    words = spark.createDataFrame([(7, "dog"), (8, "cat")], "row long, token string")
    for r in M.environments(words, model).collect():
        assert r["row"] == {"dog": 7, "cat": 8}[r["token"]]
        np.testing.assert_array_equal(r["vec"], M.environment(r["token"], model))


def test_what_an_element_is_divided_by_is_made_once():
    """Within a function over elements it would be made for each of them: quadratic in the dimensions."""
    for made, inner, outer in ((V.quantize(F.col("v")), "rint", "array_max"), (V.unit(F.col("v")), "/", "aggregate")):
        shown = str(made).replace("`", "").lower()
        assert outer in shown
        assert outer not in shown.split(inner, 1)[1].split("127" if inner == "rint" else ")", 1)[0]


def test_quantizing_keeps_its_values(spark):
    rows = [[0.0, 0.0], [1.5, -3.0], [], [0.5, 127.0, -0.5, 1.5], None]
    got = spark.createDataFrame(list(enumerate(rows)), "k int, v array<float>").select("k", V.quantize(F.col("v")).alias("z"), V.unit(F.col("v")).alias("u")).orderBy("k").collect()
    assert [r["z"]["q"] for r in got] == [[0, 0], [64, -127], [], [0, 127, 0, 2], None]
    assert [r["z"]["scale"] for r in got] == pytest.approx([1 / 127, 3 / 127, 1 / 127, 1.0, 1 / 127])
    assert got[0]["u"] == [0.0, 0.0]
    np.testing.assert_allclose(got[1]["u"], unit(np.array([1.5, -3.0])))


def test_partial_sums_are_sent_in_numbers_that_hold_them():
    rows = np.array([[0, -127, 3], [128, 0, 0], [-32768, 1, 2], [2.0**31 - 1, 0, 0], [2.0**31, 0, 0], [0.5, 1, -1e-9]])
    sent = M._packed(rows)
    assert [len(x) for x in sent.to_pylist()] == [3, 6, 12, 12, 24, 24]
    np.testing.assert_array_equal(M._unpacked(sent, 3), rows)
    np.testing.assert_array_equal(M._unpacked(sent.slice(2, 2), 3), rows[2:4])
