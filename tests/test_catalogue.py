"""Every query of the catalogue, against the same query in SQL where there is one."""

import math

import duckdb
import pytest

from quillspace.operators import models, simulate
from quillspace.plans.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    a, b = table(got.columns, [tuple(r) for r in got.collect()]), table(columns, want.fetchall())
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    assert a[1] == b[1]
    assert a[1] or name == "duplicate_ids"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_corpus_queries_take_the_whole_corpus(spark, sf_dir, monkeypatch):
    """Their inputs; the operators are tested by themselves."""
    docs = {r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    taken = {}

    class Stopped(Exception):
        pass

    def order(sentences, model):
        taken["order"] = sentences, model
        raise Stopped

    def simulated(sentences, docs, plan=None, ready=None):
        taken["simulations"] = docs, plan
        raise Stopped

    monkeypatch.setattr(models, "memory_sums", order)
    monkeypatch.setattr(simulate, "simulate", simulated)
    for name in ("beagle_order", "simulations"):
        with pytest.raises(Stopped):
            QUERIES[name](spark, sf_dir)
    sentences, model = taken["order"]
    with_words = {r[0] for r in sentences.select("doc_id").distinct().collect()}
    assert (model.dim, model.max_ngram) == (1024, 7) and with_words <= docs and len(with_words) > 0.9 * len(docs)
    given, plan = taken["simulations"]
    assert {r[0] for r in given.collect()} == docs and plan == simulate.Plan()
