"""Three simulations of retrieval: finding a document by its words, by their associates, and how alike methods rank.

Queries are words of sampled documents. Each method scores every document for every query; scores are
reduced to ranks of targets and to correlations where they are made.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import kept, numbered_within, spread
from . import evaluate as E
from . import lexical as L
from . import models as M
from .space import nearest

LEXICAL = ("wordmatch", "bm25", "hybrid")
ASSOCIATES = ("nearest", "outside-document")
#: Associates of a word that are looked at for one outside the document.
CANDIDATES = 50
#: Targets at most, and queries that are scored together; their vectors are broadcast.
MOST_TARGETS = 20_000


@dataclass(frozen=True)
class Plan:
    methods: Sequence[str] = ("beagle", "beagle-rp", "random", "wordmatch", "bm25", "hybrid")
    percents: Sequence[int] = (5, 10, 25, 50, 100)
    n_targets: int = 200
    simulations: Sequence[int] = (1, 2, 3)
    seed: int = 0
    reference: str = "beagle"
    params: dict[str, dict[str, Any]] = field(default_factory=dict)
    min_tokens: int = 10
    lexical_weight: float = 0.5
    associates: str = "nearest"

    def __post_init__(self) -> None:
        if not self.methods:
            raise ValueError("no methods")
        if len(set(self.methods)) != len(self.methods):
            raise ValueError("methods must differ")
        if self.associates not in ASSOCIATES:
            raise ValueError(f"associates is one of {ASSOCIATES}")
        if not 0 < self.n_targets <= MOST_TARGETS:
            raise ValueError(f"n_targets is from 1 to {MOST_TARGETS}")
        for m in {*self.methods, self.reference} - {*LEXICAL}:
            M.make(m, **self.params.get(m, {}))


@dataclass
class Results:
    """ranks: simulation, percent, target, method, rank; agreement: percent, target, method_a, method_b, rho."""

    ranks: DataFrame
    agreement: DataFrame
    n_documents: int
    n_targets: int

    def rank_summary(self) -> DataFrame:
        return E.rank_summary(self.ranks, ["simulation", "percent", "method"])

    def agreement_summary(self) -> DataFrame:
        return E.agreement_summary(self.agreement, ["percent", "method_a", "method_b"])

    def to_dict(self) -> dict[str, Any]:
        rows = lambda df, *by: [r.asDict() for r in df.orderBy(*by).collect()]  # noqa: E731  a row for each target, percent and method
        return {"documents": self.n_documents, "targets": self.n_targets, "ranks": rows(self.ranks, "simulation", "percent", "target", "method"), "agreement": rows(self.agreement, "percent", "target", "method_a", "method_b")}


def vector_scores(space: DataFrame, queries: DataFrame, dim: int) -> DataFrame:
    """space(doc, vec), queries(target, vec; at most MOST_TARGETS) -> target, doc, score: cosines of all pairs; 0 for zero vectors."""
    rows = queries.orderBy("target").collect()  # bounded by MOST_TARGETS
    if not rows:
        return space.sparkSession.createDataFrame([], "target long, doc long, score double")
    names, matrix = np.array([r["target"] for r in rows], np.int64), np.array([r["vec"] for r in rows], np.float64).reshape(len(rows), dim)
    size = np.linalg.norm(matrix, axis=1)
    unit = space.sparkSession.sparkContext.broadcast((names, matrix / np.where(size > 0, size, 1.0)[:, None]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = unit.value
        for b in batches:
            docs = b.column(0).to_numpy()
            step = max(1, 1_000_000 // len(names))
            for k in range(0, len(docs), step):
                some = b.column(1).slice(k, step)
                v = some.flatten().to_numpy().reshape(len(some), -1)
                norms = np.linalg.norm(v, axis=1)
                # rounded, as sums in another order may differ in their last bits and ties count
                scores = np.round(q @ (v / np.where(norms > 0, norms, 1.0)[:, None]).T, 12)
                yield pa.record_batch([pa.array(np.repeat(names, len(v))), pa.array(np.tile(docs[k : k + step], len(names))), pa.array(scores.ravel())], ["target", "doc", "score"])

    return space.select("doc", F.col("vec").cast("array<double>")).mapInArrow(scan, "target long, doc long, score double")


def fused_scores(semantic: DataFrame, lexical: DataFrame, weight: float) -> DataFrame:
    """target, doc, score by reciprocal ranks within each target; lexical: matching documents only. Ties go by document."""
    a = numbered_within(semantic, ["target"], [F.desc("score"), F.asc("doc")], "_a").select("target", "doc", "_a")
    b = numbered_within(lexical, ["target"], [F.desc("score"), F.asc("doc")], "_b").select("target", "doc", "_b")
    score = (1 - weight) / (60 + F.col("_a")) + F.coalesce(weight / (60 + F.col("_b")), F.lit(0.0))
    return a.join(b, ["target", "doc"], "left").select("target", "doc", score.alias("score"))


def simulate(sentences: DataFrame, docs: DataFrame, plan: Plan | None = None, ready: dict[str, DataFrame] | None = None) -> Results:
    """sentences(doc, sent, words), docs(doc) -> ranks and agreement. ready: word vectors (token, vec) of methods, in place of new ones.

    Targets are the plan's number of documents of min_tokens tokens or more with the smallest hash of seed
    and number; they are the same for all percentages and methods.
    """
    plan = plan or Plan()
    spark = sentences.sparkSession
    sentences = kept(spread(sentences.select("doc", "sent", "words")), "sentences")
    tokens = sentences.select("doc", "sent", F.posexplode("words").alias("pos", "token"))
    counts = kept(L.term_counts(tokens, "doc"), "terms")
    sizes = counts.groupBy("doc").agg(F.sum("tf").alias("_n"))
    order = F.md5(F.concat_ws("#", F.lit(plan.seed), F.col("doc").cast("string")))
    targets = kept(sizes.where(F.col("_n") >= plan.min_tokens).orderBy(order, "doc").limit(plan.n_targets).select("doc"), "targets")
    n_targets = targets.count()
    if not n_targets:
        raise ValueError(f"no document has {plan.min_tokens} tokens")
    own = kept(tokens.join(F.broadcast(targets), "doc"), "target-tokens")
    docs = kept(docs.select("doc"), "docs")
    vocab = counts.select("token").distinct()

    semantic = [m for m in plan.methods if m not in LEXICAL]
    needs_reference = 2 in plan.simulations or "hybrid" in plan.methods
    words, spaces, made = {}, {}, {}
    for name in dict.fromkeys([*semantic, *([plan.reference] if needs_reference else [])]):
        model = M.make(name, **plan.params.get(name, {}))
        given = (ready or {}).get(name)
        words[name] = given if given is not None else kept(M.word_vectors(sentences, vocab, model), f"words-{name}")
        spaces[name] = kept(M.composed(docs, counts, words[name] if model.learns else None, model, "doc").select("doc", "vec"), f"docs-{name}")
        made[name] = model

    def scores(queries: DataFrame, asked: DataFrame) -> DataFrame:
        """queries(target, token), repeats count for vectors alone; asked(target): all of them -> target, doc, score, method."""
        terms = queries.select(F.col("target").alias("query_id"), "token")
        counted = queries.groupBy("target", "token").agg(F.count(F.lit(1)).alias("tf"))
        every = docs.crossJoin(F.broadcast(asked.select("target")))  # the stated queries against all documents
        parts: dict[str, DataFrame] = {}
        for name in spaces:
            if name in semantic or "hybrid" in plan.methods:
                vectors = M.composed(asked.select("target"), counted, words[name] if made[name].learns else None, made[name], "target")
                parts[name] = kept(vector_scores(spaces[name], vectors.select("target", "vec"), made[name].dim), f"scores-{name}")
        if {"bm25", "hybrid"} & set(plan.methods):
            found = L.bm25(docs, counts, terms, "doc").select(F.col("query_id").alias("target"), "doc", F.round("score", 9).alias("score"))
            parts["bm25"] = kept(found, "scores-bm25")
        if "hybrid" in plan.methods:
            parts["hybrid"] = fused_scores(parts[plan.reference], parts["bm25"], plan.lexical_weight)
        if "wordmatch" in plan.methods:
            parts["wordmatch"] = L.word_match(counts, terms, sorted(M.MODELS["beagle"].stop), "doc").select(F.col("query_id").alias("target"), "doc", F.col("score").cast("double").alias("score"))
        for name in {"bm25", "wordmatch"} & set(plan.methods):  # these score what matches
            parts[name] = every.join(parts[name], ["target", "doc"], "left").select("target", "doc", F.coalesce("score", F.lit(0.0)).alias("score"))
        return reduce(DataFrame.unionByName, [parts[m].select("target", "doc", "score", F.lit(m).alias("method")) for m in plan.methods])

    near = None
    if 2 in plan.simulations:
        stop = sorted(made[plan.reference].stop)
        shown = words[plan.reference].select(F.col("token").alias("label"), "vec")
        asked_words = shown.where(F.exists("vec", lambda x: x != 0)).join(own.select(F.col("token").alias("label")).distinct(), "label")
        near = kept(nearest(shown.where(~F.col("label").isin(stop)) if stop else shown, asked_words, 1 if plan.associates == "nearest" else CANDIDATES), "associates")
    cases: list[tuple[int, int, DataFrame]] = []
    for percent in plan.percents:
        sample = kept(E.sampled_tokens(own, percent, plan.seed, "doc").select("doc", "sent", "pos", "token"), f"queries-{percent}")
        if {1, 3} & set(plan.simulations):
            cases.append((1, percent, sample))
        if near is not None:
            cases.append((2, percent, kept(E.associates(sample, near, own.select("doc", "token").distinct() if plan.associates != "nearest" else None, "doc"), f"associates-{percent}")))
    names = [r[0] for r in targets.orderBy("doc").collect()]  # bounded by MOST_TARGETS
    methods = spark.createDataFrame([(m,) for m in plan.methods], "method string")
    ranks, agreement = [], []
    step = max(1, MOST_TARGETS // n_targets)  # cases whose queries are scored together
    for first in range(0, len(cases), step):
        some = cases[first : first + step]
        rows = [(i * n_targets + k, doc, simulation, percent) for i, (simulation, percent, _) in enumerate(some) for k, doc in enumerate(names)]
        asked = kept(spark.createDataFrame(rows, "target long, doc long, simulation int, percent int"), "asked")
        queries = [found.join(F.broadcast(asked.where((F.col("simulation") == simulation) & (F.col("percent") == percent))), "doc").select("target", "token") for simulation, percent, found in some]
        all_scores = kept(scores(kept(reduce(DataFrame.unionByName, queries), "asked-words"), asked), "scores")
        wanted = asked.where(F.col("simulation").isin(list(plan.simulations)))
        found = E.target_ranks(all_scores, wanted.select("target", "doc").crossJoin(F.broadcast(methods)), ["target", "method"], "doc")
        ranks.append(found.join(F.broadcast(wanted), "target").select("simulation", "percent", F.col("doc").alias("target"), "method", "rank"))
        alike = asked.where("simulation = 1")
        if 3 in plan.simulations and len(plan.methods) > 1 and any(c[0] == 1 for c in some):
            rho = E.spearman(all_scores.join(F.broadcast(alike.select("target")), "target", "left_semi"), ["target"], "doc")
            agreement.append(rho.join(F.broadcast(alike), "target").select("percent", F.col("doc").alias("target"), "method_a", "method_b", "rho"))
    none = spark.createDataFrame([], "simulation int, percent int, target long, method string, rank double")
    nothing = spark.createDataFrame([], "percent int, target long, method_a string, method_b string, rho double")
    return Results(kept(reduce(DataFrame.unionByName, ranks, none), "ranks"), kept(reduce(DataFrame.unionByName, agreement, nothing), "agreement"), docs.count(), n_targets)
