"""Queries by name over the test tables, each with the same query in SQL where SQL has one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..functions.shared import kept, numbered
from ..operators import evaluate as E
from ..operators import lexical as L
from ..operators import models as N
from ..operators import passages as P
from ..operators import project as M
from ..operators import search as S
from ..operators import simulate as R
from ..operators import space as X
from ..sources import mapping as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIM, NONZERO, WINDOW = 24, 4, 2
QUERY = "the and of der la que thing"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- pieces of SQL ---

def _fold(x: str) -> str:
    return f"translate(replace(lower(coalesce({x}, '')), 'ß', 'ss'), '{T.ACCENTED}', '{T.PLAIN}')"


def _words(x: str) -> str:
    return f"regexp_extract_all({x}, '{T.WORD}')"


def _tokens(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return rf"""
pieces as (select {key}, unnest(p) as piece, generate_subscripts(p, 1) as sent from (select {key}, regexp_split_to_array({_fold(text)}, '[.!?\n]+') as p from {table})),
tok as (select {key}, sent, unnest(w) as token, generate_subscripts(w, 1) as pos from (select {key}, sent, {_words("piece")} as w from pieces)),
tf as (select {key}, token, count(*) as tf from tok group by {key}, token)"""


_BM25 = """
sizes as (select d.doc_id, coalesce(sum(tf), 0) as len from (select distinct doc_id from documents) d left join tf using (doc_id) group by d.doc_id),
totals as (select cast(count(*) as double) as n, avg(len) as mean from sizes),
weights as (select token, ln(cast(1 as double) + (n - cast(count(*) as double) + cast(0.5 as double)) / (cast(count(*) as double) + cast(0.5 as double))) as idf from tf, totals group by token, n),
scored as (select query_id, tf.doc_id, sum(idf * tf * cast(2.2 as double) / (tf + cast(1.2 as double) * (cast(0.25 as double) + cast(0.75 as double) * len / case when mean > 0 then mean else 1 end))) as score
  from tf join terms using (token) join weights using (token) join sizes using (doc_id), totals group by query_id, tf.doc_id)"""
_ENV = f"""
drawn as (select token, r, cast('0x' || substr(md5('0#' || token || '#' || cast(r as varchar)), 1, 8) as bigint) % {DIM} as dim
  from (select distinct token from tok), (select unnest(range(0, 64)) as r)),
placed as (select token, dim, row_number() over (partition by token order by min(r)) as p from drawn group by token, dim),
env as (select token, cast(dim as integer) as dim, case when p <= {NONZERO // 2} then 1 else -1 end as x from placed where p <= {NONZERO})"""
_DOCS = """
doc as (select doc_id, dim, cast(sum(tf * x) as bigint) as x from tf join env using (token) group by doc_id, dim having sum(tf * x) <> 0)"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def _toks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.token_rows(_docs(spark, sf_dir))


#: The models of a library at a small size; documents are composed of all their words.
RANDOM = N.make("random", dim=DIM, environment="ternary", nonzeros=NONZERO, compose_without_stopwords=False)
ROLLED = N.make("beagle-rp", dim=DIM, nonzeros=NONZERO, window=WINDOW)


def _sents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sentence_rows(_docs(spark, sf_dir))


def _env(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token, vec of all words of the corpus."""
    sents = _sents(spark, sf_dir)
    return N.word_vectors(sents, sents.select(F.explode("words").alias("token")).distinct(), RANDOM)


def _dims(df: DataFrame, key: str) -> DataFrame:
    """key, dim, x: what is not zero in vectors of whole numbers."""
    return df.select(key, F.posexplode("vec").alias("dim", "x")).select(key, "dim", F.rint("x").cast("long").alias("x")).where("x <> 0")


def _doc_space(spark: SparkSession, sf_dir: str, counts: DataFrame | None = None) -> DataFrame:
    """doc_id, vec as a library composes them; a zero vector for documents without a word."""
    docs = _docs(spark, sf_dir)
    return N.composed(docs.select("doc_id"), L.term_counts(_toks(spark, sf_dir)) if counts is None else counts, None, RANDOM, "doc_id")


def _words_of(spark: SparkSession, text: str = QUERY) -> DataFrame:
    return spark.createDataFrame([(0, w) for w in text.split()], "query_id long, token string")


_TERMS = "terms as (select distinct cast(0 as bigint) as query_id, unnest(string_split('" + QUERY + "', ' ')) as token)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.token_rows(read(spark, sf_dir, "benchmark"), "item_id").select(F.col("item_id").alias("query_id"), "token")


_ITEM_TERMS = f"terms as (select distinct item_id as query_id, unnest({_words(_fold('text'))}) as token from benchmark)"

# --- counts ---


@query(f"with {_tokens()} select token, count(*) as n from tok group by token")
def vocab_counts(spark, sf_dir):
    return L.vocabulary(_toks(spark, sf_dir)).select("token", "n")


@query(f"""with {_tokens()}, v as (select token, min((doc_id, sent, pos)) as f from (select token, struct_pack(doc_id := doc_id, sent := sent, pos := pos) as x, doc_id, sent, pos from tok) group by token)
select token, cast(row_number() over (order by f) as bigint) as place from v""")
def first_occurrence_vocab(spark, sf_dir):
    return numbered(L.vocabulary(_toks(spark, sf_dir)), [F.asc("first")], "place").select("token", "place")


@query(f"with {_tokens()} select doc_id, token, tf from tf")
def doc_term_counts(spark, sf_dir):
    return L.term_counts(_toks(spark, sf_dir))


@query(f"with {_tokens()} select d.doc_id, cast(coalesce(sum(tf), 0) as bigint) as len from (select distinct doc_id from documents) d left join tf using (doc_id) group by d.doc_id")
def doc_lengths(spark, sf_dir):
    return L.lengths(_docs(spark, sf_dir), L.term_counts(_toks(spark, sf_dir)))


@query(f"""with {_tokens()}, n as (select cast(count(distinct doc_id) as double) as n from documents)
select token, count(*) as df, round(ln(cast(1 as double) + (n - cast(count(*) as double) + cast(0.5 as double)) / (cast(count(*) as double) + cast(0.5 as double))), 6) as idf from tf, n group by token, n""")
def idf(spark, sf_dir):
    totals = _docs(spark, sf_dir).agg(F.countDistinct("doc_id").cast("double").alias("_n"))
    return L.idf(L.term_counts(_toks(spark, sf_dir)), totals).select("token", "df", F.round("idf", 6).alias("idf"))


# --- keyword search ---


def _bm25(spark, sf_dir, terms):
    return L.bm25(_docs(spark, sf_dir), L.term_counts(_toks(spark, sf_dir)), terms)


@query(f"""with {_tokens()}, {_TERMS}, {_BM25}
select row_number() over (order by round(score, 6) desc, doc_id) as rank, doc_id, lang, source, round(score, 6) as score
from scored join documents using (doc_id) order by round(score, 6) desc, doc_id limit 10""")
def bm25_topk(spark, sf_dir):
    scored = _bm25(spark, sf_dir, _words_of(spark)).select("doc_id", F.round("score", 6).alias("score"))
    best = F.broadcast(S.top(scored, 10, row="doc_id"))
    return _docs(spark, sf_dir).join(best, "doc_id").select(F.col("rank").cast("long").alias("rank"), "doc_id", "lang", "source", "score")


@query(f"with {_tokens()}, {_ITEM_TERMS}, {_BM25} select query_id, doc_id, round(score, 5) as score from scored")
def bm25_by_benchmark_item(spark, sf_dir):
    return _bm25(spark, sf_dir, _items(spark, sf_dir)).select("query_id", "doc_id", F.round("score", 5).alias("score"))


_STOP = ", ".join(f"'{w}'" for w in sorted(T.ENGLISH))


@query(f"""with {_tokens()}, {_ITEM_TERMS}, k as (select *, token in ({_STOP}) as s, bool_and(token in ({_STOP})) over (partition by query_id) as only_stop from terms)
select query_id, doc_id, count(*) as score from tf join k using (token) where not s or only_stop group by query_id, doc_id""")
def word_match(spark, sf_dir):
    return L.word_match(L.term_counts(_toks(spark, sf_dir)), _items(spark, sf_dir), T.ENGLISH)


@query(f"with {_tokens()}, {_ITEM_TERMS} select query_id, token, token in (select token from tf) as known from terms")
def known_terms(spark, sf_dir):
    return L.known(_items(spark, sf_dir), L.vocabulary(_toks(spark, sf_dir)))


# --- older cleaning, sentences ---

_LEGACY = rf"regexp_replace(translate(replace(replace(replace(replace(lower(coalesce(text, '')), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '{T.ACCENTED}', '{T.PLAIN}'), '[!-/:-@\[-`{{-~0-9\n]', ' ', 'g')"


@query(rf"select token, count(*) as n from (select unnest(list_filter(regexp_split_to_array({_LEGACY}, '[ \t\n\r\f\v]+'), lambda x: x <> '')) as token from documents) group by token")
def legacy_token_counts(spark, sf_dir):
    words = T.legacy_tokens(T.portable_legacy_clean(F.col("text")))
    return _docs(spark, sf_dir).select(F.explode(words).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("""select conv_id, turn, cast(case when coalesce(text, '') = '' then 0 else len(string_split(text, '.')) - case when text like '%.' then 1 else 0 end end as bigint) as n from conversations""")
def legacy_sentence_counts(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(T.legacy_sentences(F.col("text"))).cast("long").alias("n"))


# --- vectors of `embeddings` ---


def _space(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), "label", F.col("embedding").alias("vec"))


_DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: cast({0}[i] as double) * cast({1}[i] as double)))"
_COS = f"case when {_DOT.format('a', 'a')} > 0 and {_DOT.format('b', 'b')} > 0 then {_DOT.format('a', 'b')} / (sqrt({_DOT.format('a', 'a')}) * sqrt({_DOT.format('b', 'b')})) else 0 end"


_Q = _COS.replace("a[i]", "e.embedding[i]").replace("len(a)", "len(e.embedding)").replace("b[i]", "q.embedding[i]").replace("len(b)", "len(q.embedding)")


@query(f"select vec_id as row, round(sqrt({_DOT.format('embedding', 'embedding')}), 6) as norm from embeddings")
def embedding_norms(spark, sf_dir):
    return _space(spark, sf_dir).select("row", F.round(V.norm(F.col("vec")), 6).alias("norm"))


def _first(space: DataFrame, at: int) -> list[float]:
    return space.where(F.col("row") == at).first()["vec"]


@query(f"""select row_number() over (order by score desc, row) as rank, row, score from (
select e.vec_id as row, round({_Q}, 6) as score from embeddings e, embeddings q where q.vec_id = 0) order by score desc, row limit 10""")
def cosine_similar_topk(spark, sf_dir):
    space = _space(spark, sf_dir)
    scored = S.scores(space, _first(space, 0)).select("row", F.round("score", 6).alias("score"))
    return S.top(scored, 10).select(F.col("rank").cast("long").alias("rank"), "row", "score")


@query("select vec_id as row, cast(0 as double) as score from embeddings")
def cosine_zero_guard(spark, sf_dir):
    return S.scores(_space(spark, sf_dir), [0.0] * 64).select("row", "score")


@query(f"""with q as (select list_transform(range(1, 65), lambda i: cast(a.embedding[i] as double) + cast(b.embedding[i] as double)) as embedding from embeddings a, embeddings b where a.vec_id = 1 and b.vec_id = 2)
select e.vec_id as row, round({_Q}, 6) as score from embeddings e, q""")
def query_compound(spark, sf_dir):
    space = _space(spark, sf_dir)
    total = [x + y for x, y in zip(_first(space, 1), _first(space, 2), strict=True)]
    return S.scores(space, total).select("row", F.round("score", 6).alias("score"))


def _terms(space: DataFrame) -> DataFrame:
    return S.term_scores(space, space.where("row in (1, 2, 3)").select(F.col("row").alias("term"), "vec"))


@query(f"select row, round(product(score), 6) + 0 as score from (select e.vec_id as row, {_Q} as score from embeddings e, embeddings q where q.vec_id in (1, 2, 3)) group by row")
def query_and(spark, sf_dir):
    return S.combined(_terms(_space(spark, sf_dir)), "and").select("row", (F.round("score", 6) + 0.0).alias("score"))  # no -0


@query(f"""with s as (select q.vec_id as term, e.vec_id as row, {_Q} as score from embeddings e, embeddings q where q.vec_id in (1, 2, 3)),
m as (select *, max(score) over (partition by term) as best from s)
select row, round(max(score / case when best = 0 then 1 else abs(best) end), 6) as score from m group by row""")
def query_or(spark, sf_dir):
    return S.combined(_terms(_space(spark, sf_dir)), "or").select("row", F.round("score", 6).alias("score"))


_LABELS = "l as (select label, i, {0}(cast(x as double)) as x from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings) group by label, i)"


def _coords(df, vec="vec"):
    return df.select("label", F.posexplode(vec).alias("i", "x")).select("label", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 5).alias("x"))


@query(f"with {_LABELS.format('sum')} select label, cast(i as bigint) as i, round(x, 5) as x from l")
def label_space_sum(spark, sf_dir):
    return _coords(V.summed(_space(spark, sf_dir), ["label"], "vec"))


@query(f"with {_LABELS.format('avg')} select label, cast(i as bigint) as i, round(x, 5) as x from l")
def label_space_mean(spark, sf_dir):
    return _coords(V.summed(_space(spark, sf_dir), ["label"], "vec", "mean"))


@query(f"""with {_LABELS.format('sum')}, e as (select vec_id, generate_subscripts(embedding, 1) as i, cast(unnest(embedding) as double) as y from embeddings where vec_id = 5)
select label, round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 6) as score from l join e using (i) group by label""")
def cross_space_similar(spark, sf_dir):
    space = _space(spark, sf_dir)
    return S.scores(V.summed(space, ["label"], "vec"), _first(space, 5)).select("label", F.round("score", 6).alias("score"))


@query("""with m as (select vec_id as row, embedding, list_max(list_transform(embedding, lambda x: abs(cast(x as double)))) as top from embeddings),
s as (select row, generate_subscripts(embedding, 1) as i, cast(unnest(embedding) as double) as x, case when top > 0 then top else 1 end as top from m)
select row, cast(i as bigint) as i, cast(round_even(x / top * 127, 0) as integer) as q, round(top / 127, 9) as scale from s""")
def int8_quantize(spark, sf_dir):
    made = _space(spark, sf_dir).select("row", V.quantize(F.col("vec")).alias("z"))
    return made.select("row", F.round("z.scale", 9).alias("scale"), F.posexplode("z.q").alias("i", "q")).select("row", (F.col("i") + 1).cast("long").alias("i"), F.col("q").cast("int").alias("q"), "scale")


@query(f"""with s as (select q.vec_id as query, e.vec_id as row, round({_Q}, 6) as score from embeddings e, embeddings q where e.vec_id <> q.vec_id and q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query order by score desc, row) as rank from s) select query, row, rank, score from r where rank <= 3""")
def associates_knn(spark, sf_dir):
    space = _space(spark, sf_dir)
    found = X.nearest(space, space.where("row % 20 = 0"), 6, "row")  # a few more, as rounding may change places
    best = Window.partitionBy("query").orderBy(F.desc(F.round("score", 6)), "label")
    return found.withColumn("rank", F.row_number().over(best)).where("rank <= 3").select("query", F.col("label").alias("row"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


# --- corpus-made vectors ---


@query(f"with {_tokens()}, {_ENV} select token, dim, x from env")
def ternary_env(spark, sf_dir):
    return _dims(_env(spark, sf_dir), "token").withColumn("x", F.col("x").cast("int"))


@query(f"with {_tokens()}, {_ENV}, {_DOCS} select doc_id, dim, x from doc")
def doc_vectors_random(spark, sf_dir):
    return _dims(_doc_space(spark, sf_dir), "doc_id")


_ELIGIBLE = "el as (select * from (select *, count(*) over (partition by doc_id, sent) as size from tok) where size >= 2)"


@query(f"""with {_tokens()}, {_ENV}, {_ELIGIBLE}, kept as (select * from el where token not in ({_STOP})),
s as (select doc_id, sent, dim, sum(x) as x from kept join env using (token) group by doc_id, sent, dim),
parts as (select token, dim, x from el join s using (doc_id, sent) union all select token, dim, -x from kept join env using (token))
select token, dim, cast(sum(x) as bigint) as x from parts group by token, dim having sum(x) <> 0""")
def context_vectors(spark, sf_dir):
    return _dims(N.memory_sums(_sents(spark, sf_dir), replace(ROLLED, order=False)), "token")


@query(f"""with {_tokens()}, {_ENV}, near as (select a.token, b.token as near, b.pos - a.pos as k, count(*) as n
  from tok a join tok b on a.doc_id = b.doc_id and a.sent = b.sent and abs(b.pos - a.pos) between 1 and {WINDOW} group by a.token, b.token, b.pos - a.pos)
select n.token, cast((e.dim + n.k + {DIM}) % {DIM} as integer) as dim, cast(sum(n.n * e.x) as bigint) as x from near n join env e on e.token = n.near group by 1, 2 having sum(n.n * e.x) <> 0""")
def rp_order_vectors(spark, sf_dir):
    return _dims(N.memory_sums(_sents(spark, sf_dir), replace(ROLLED, context=False)), "token")


_QUERY_VECTOR = f"q as (select dim, cast(sum(x) as double) as q from env where token in (select token from terms) group by dim), qn as (select sqrt(sum(q * q)) as qn from q)"
_SEMANTIC = """
sem as (select doc_id, round(coalesce(sum(x * q), 0) / (sqrt(sum(x * cast(x as double))) * any_value(qn)), 9) as semantic from doc left join q using (dim), qn group by doc_id)"""


def _counts(spark, sf_dir):
    """Counts of terms, for queries that read them more than once."""
    return kept(L.term_counts(_toks(spark, sf_dir)), "terms")


def _semantic(spark, sf_dir, counts=None):
    """Cosine of every document with a vector to the sum of the query's words."""
    counts = _counts(spark, sf_dir) if counts is None else counts
    seen = counts.where(F.col("token").isin(QUERY.split())).select("token").distinct()
    query = [sum(x) for x in zip(*(r["vec"] for r in N.environments(seen, RANDOM).collect()), strict=True)]  # a row for each word of the query
    space = _doc_space(spark, sf_dir, counts).where(F.exists("vec", lambda x: x != 0))
    return S.scores(space, query).select("doc_id", F.round("score", 9).alias("score"))


@query(f"with {_tokens()}, {_TERMS}, {_ENV}, {_DOCS}, {_QUERY_VECTOR}, {_SEMANTIC} select doc_id, round(semantic, 6) as score from sem")
def semantic_search_docs(spark, sf_dir):
    return _semantic(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score"))


def _factor(name: str):
    sql = f"with {_tokens()}, {_ENV}, {_DOCS} select {name} as level, dim, cast(sum(x) as bigint) as x from doc join documents using (doc_id) group by {name}, dim having sum(x) <> 0"

    def run(spark, sf_dir):
        levels = _docs(spark, sf_dir).select("doc_id", F.col(name).alias("level"))
        vectors = V.summed(_doc_space(spark, sf_dir).join(levels.distinct(), "doc_id"), ["level"], "vec")
        return _dims(vectors, "level")

    run.__name__ = f"factor_space_{name}"
    query(sql)(run)


for _name in ("lang", "source"):
    _factor(_name)


@query(f"""with {_tokens()}, {_TERMS}, {_ENV}, {_DOCS}, {_QUERY_VECTOR}, {_SEMANTIC}, {_BM25},
a as (select doc_id, row_number() over (order by semantic desc, doc_id) as a from sem),
b as (select doc_id, row_number() over (order by round(score, 9) desc, doc_id) as b from scored where score > 0)
select doc_id, round(cast(0.5 as double) / (60 + a) + coalesce(cast(0.5 as double) / (60 + b), 0), 9) as score from a left join b using (doc_id)""")
def hybrid_rrf(spark, sf_dir):
    counts = _counts(spark, sf_dir)
    lexical = L.bm25(_docs(spark, sf_dir), counts, _words_of(spark)).select("doc_id", F.round("score", 9).alias("score"))
    # a range sort reads its input twice
    return S.fused(kept(_semantic(spark, sf_dir, counts), "semantic"), kept(lexical, "lexical"), 0.5, "doc_id").select("doc_id", F.round("score", 9).alias("score"))


@query(f"""with {_tokens()}, {_TERMS}, {_BM25} select doc_id, round(score, 6) as score from scored where doc_id in (select doc_id from labels where quality = 1)""")
def masked_search_label(spark, sf_dir):
    good = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return _bm25(spark, sf_dir, _words_of(spark)).join(good, "doc_id", "left_semi").select("doc_id", F.round("score", 6).alias("score"))


@query("select o_orderkey, year(o_orderdate) as year from orders where year(o_orderdate) between 1993 and 1995")
def masked_search_year(spark, sf_dir):
    raw = F.col("o_orderdate").cast("string")
    return read(spark, sf_dir, "orders").where(T.year_filter(raw, "1993-1995")).select("o_orderkey", F.year("o_orderdate").cast("long").alias("year"))


# --- evaluation ---

def _toy(spark, sf_dir, mod: int, method: str) -> DataFrame:
    """Scores with many ties for 7 queries over all documents."""
    score = ((F.length("text") + F.col("doc_id") * F.col("q")) % mod).cast("double")
    return _docs(spark, sf_dir).crossJoin(F.broadcast(spark.range(7).withColumnRenamed("id", "q"))).select("q", F.col("doc_id").alias("item"), F.lit(method).alias("method"), score.alias("score"))


def _toys(spark, sf_dir):
    return _toy(spark, sf_dir, 11, "a").unionByName(_toy(spark, sf_dir, 5, "b"))


_TOYS = """s as (select q, doc_id as item, m.method, cast((length(text) + doc_id * q) % m.n as double) as score
from documents, (select unnest(range(0, 7)) as q) k, (values ('a', 11), ('b', 5)) m(method, n))"""
_RANKS = "r as (select *, rank() over (partition by q, method order by score desc) + (count(*) over (partition by q, method, score) - 1) / cast(2 as double) as rank from s)"


@query(f"with {_TOYS}, {_RANKS} select q, method, rank from r where item = q")
def target_ranks_ties(spark, sf_dir):
    scored = _toys(spark, sf_dir)
    targets = spark.range(7).select(F.col("id").alias("q"), F.col("id").alias("item"))
    both = targets.crossJoin(spark.createDataFrame([("a",), ("b",)], "method string"))  # 7 queries, 2 methods
    return E.target_ranks(scored, both, ["q", "method"])


@query(f"with {_TOYS}, {_RANKS} select a.q, 'a' as method_a, 'b' as method_b, round(corr(a.rank, b.rank), 6) as rho from r a join r b on a.q = b.q and a.item = b.item where a.method = 'a' and b.method = 'b' group by a.q")
def spearman_methods(spark, sf_dir):
    return E.spearman(_toys(spark, sf_dir), ["q"]).withColumn("rho", F.round("rho", 6))


@query(f"""with {_TOYS}, {_RANKS} select method, count(*) as n, round(median(rank), 6) as median_rank, round(avg(1 / rank), 6) as mrr, round(avg(cast(rank <= 1 as integer)), 6) as top1, round(avg(cast(rank <= 10 as integer)), 6) as top10 from r where item = q group by method""")
def rank_summary(spark, sf_dir):
    made = E.rank_summary(target_ranks_ties(spark, sf_dir), ["method"])
    return made.select("method", "n", *[F.round(c, 6).alias(c) for c in ("median_rank", "mrr", "top1", "top10")])


@query(f"""with {_TOYS}, {_RANKS}, c as (select a.q, corr(a.rank, b.rank) as rho from r a join r b on a.q = b.q and a.item = b.item where a.method = 'a' and b.method = 'b' group by a.q)
select 'a' as method_a, 'b' as method_b, round(avg(rho), 6) as mean_rho, round(coalesce(stddev_samp(rho), 0), 6) as sd_rho from c""")
def agreement_summary(spark, sf_dir):
    made = E.agreement_summary(E.spearman(_toys(spark, sf_dir), ["q"]), ["method_a", "method_b"])
    return made.select("method_a", "method_b", F.round("mean_rho", 6).alias("mean_rho"), F.round("sd_rho", 6).alias("sd_rho"))


@query(f"""with {_tokens()}, n as (select *, row_number() over (partition by doc_id order by md5('0#25#' || doc_id || '#' || sent || '#' || pos), sent, pos) as place, count(*) over (partition by doc_id) as size from tok)
select doc_id, sent, pos, token from n where place <= greatest(1, round_even(size * 25 / cast(100 as double), 0))""")
def target_recovery_sample(spark, sf_dir):
    return E.sampled_tokens(_toks(spark, sf_dir), 25).select("doc_id", F.col("sent").cast("long").alias("sent"), F.col("pos").cast("long").alias("pos"), "token")


# --- tables ---


@query("select d.source, count(*) as n, count(l.doc_id) as labelled from documents d left join labels l using (doc_id) group by d.source")
def sources_left_join(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("_l"))
    return _docs(spark, sf_dir).join(labels, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("_l").alias("labelled"))


@query("select doc_id, count(*) as n from documents group by doc_id having count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("select lang as level, count(*) as n from documents group by lang")
def factor_levels(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy(F.col("lang").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("select text, count(*) as n, min(doc_id) as first, string_agg(distinct source, ';' order by source) as sources from documents group by text")
def merge_identical_text(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.array_join(F.array_sort(F.collect_set("source")), ";").alias("sources"))


@query("""select label, row from (select source as label, min(doc_id) as row from documents group by source) where instr(lower(label), 'c1') > 0
order by case when instr(lower(label), 'c1') = 1 then 0 else 1 end, row limit 12""")
def picker_lookup(spark, sf_dir):
    labels = _docs(spark, sf_dir).groupBy(F.col("source").alias("label")).agg(F.min("doc_id").alias("row"))
    return S.pick(labels, "C1")


# --- documents from records, and what an export holds ---


def _mapped(spark, sf_dir):
    mapping = D.FieldMapping.from_options(["text"], ["lang", "parts=source:_"], "doc_id")
    return D.documents(read(spark, sf_dir, "documents"), mapping)


@query("""with l as (select cast(doc_id as varchar) as id, unnest([lang]) as level, 'lang' as factor from documents
  union all select cast(doc_id as varchar), unnest(string_split(source, '_')), 'parts' from documents)
select id, factor, trim(level) as level, count(*) as n from l where trim(level) <> '' group by all""")
def record_factors(spark, sf_dir):
    levels = _mapped(spark, sf_dir).select("id", F.explode("factors").alias("factor", "_l"))
    return levels.select("id", "factor", F.explode("_l").alias("level")).groupBy("id", "factor", "level").agg(F.count(F.lit(1)).alias("n"))


@query(r"""select cast(doc_id as varchar) as id, case when trim(text) <> '' then substr(text, 1, 120) else cast(doc_id as varchar) end as title,
  case when trim(text) <> '' then 1 else 0 end as n_units, json_extract_string(json_object('n', n_chars), '$.n') as n_chars from documents""")
def record_titles(spark, sf_dir):
    docs = D.embedded(_mapped(spark, sf_dir))
    return docs.select("id", D.title().alias("title"), F.size("units").alias("n_units"), F.get_json_object("meta", "$.n_chars").alias("n_chars"))


@query("select vec_id as row, cast((i + 2) % 64 + 1 as bigint) as i, x from (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding) as x from embeddings)")
def vector_roll(spark, sf_dir):
    rolled = _space(spark, sf_dir).select("row", F.posexplode(V.roll(F.col("vec"), 3)).alias("i", "x"))
    return rolled.select("row", (F.col("i") + 1).cast("long").alias("i"), "x")


@query("select vec_id as row, case when list_max(embedding) = 0 then 1 else round(abs(cast(list_max(embedding) as double)), 6) end as top from embeddings")
def vector_abs_max(spark, sf_dir):
    return _space(spark, sf_dir).select("row", F.round(V.abs_max(F.col("vec")).cast("double"), 6).alias("top"))


@query("""with m as (select vec_id as row, embedding, list_max(list_transform(embedding, lambda x: abs(cast(x as double)))) as top from embeddings),
q as (select row, list_transform(embedding, lambda x: round_even(cast(x as double) / top * 127, 0) * (top / 127)) as back, list_transform(embedding, lambda x: cast(x as double)) as v from m)
select row, round(list_cosine_similarity(back, v), 6) as score from q""")
def int8_cosine(spark, sf_dir):
    space = _space(spark, sf_dir)
    return space.select("row", F.round(V.cosine(V.dequantize(V.quantize(F.col("vec"))), F.col("vec").cast("array<double>")), 6).alias("score"))


@query(f"""with {_tokens()}, {_ENV}, {_ELIGIBLE}, kept as (select * from el where token not in ({_STOP})),
s as (select doc_id, sent, dim, sum(x) as x from kept join env using (token) group by doc_id, sent, dim),
parts as (select token, dim, x from el join s using (doc_id, sent) union all select token, dim, -x from kept join env using (token)),
context as (select token, dim, cast(sum(x) as double) as x from parts group by token, dim having sum(x) <> 0),
near as (select a.token, b.token as near, b.pos - a.pos as k, count(*) as n
  from tok a join tok b on a.doc_id = b.doc_id and a.sent = b.sent and abs(b.pos - a.pos) between 1 and {WINDOW} group by a.token, b.token, b.pos - a.pos),
orders as (select n.token, cast((e.dim + n.k + {DIM}) % {DIM} as integer) as dim, cast(sum(n.n * e.x) as double) as x from near n join env e on e.token = n.near group by 1, 2 having sum(n.n * e.x) <> 0),
units as (select token, dim, x / sqrt(sum(x * x) over (partition by token)) as x from context union all select token, dim, x / sqrt(sum(x * x) over (partition by token)) from orders)
select token, dim, round(sum(x), 6) + 0 as x from units group by token, dim having round(sum(x), 6) <> 0""")
def rp_composite_vectors(spark, sf_dir):
    sents = _sents(spark, sf_dir)
    made = N.word_vectors(sents, sents.select(F.explode("words").alias("token")).distinct(), ROLLED, "double")
    return made.select("token", F.posexplode("vec").alias("dim", "x")).select("token", "dim", (F.round("x", 6) + 0.0).alias("x")).where("x <> 0")


@query(f"""with {_tokens()}, {_TERMS}, {_ENV}, {_DOCS}, {_QUERY_VECTOR}, {_SEMANTIC},
r as (select doc_id, round(semantic, 6) as score, row_number() over (order by round(semantic, 6) desc, doc_id) as rank from sem where doc_id in (select doc_id from documents where lang = 'en'))
select rank, doc_id, score from r where rank <= 10""")
def masked_semantic_topk(spark, sf_dir):
    scored = _semantic(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score")).join(_docs(spark, sf_dir), "doc_id")
    return S.top(scored, 10, F.col("lang") == "en", "doc_id").select(F.col("rank").cast("long").alias("rank"), "doc_id", "score")


@query()
def paragraph_merge(spark, sf_dir):
    """Turns as blocks of pages, one page for each turn; their sentences as blocks."""
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), F.posexplode(T.sentences(F.coalesce("text", F.lit("")))).alias("block", "text"))
    blocks = turns.withColumn("top", F.lit(0.3)).withColumn("bottom", F.lit(0.6))
    return P.paragraphs(P.without_margins(blocks))


@query()
def simulations(spark, sf_dir):
    """The three simulations over all documents, with the plan's own methods, query sizes and targets."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    sentences = T.sentence_rows(docs, "doc", F.array(F.coalesce("text", F.lit("")))).select("doc", "sent", "words")
    return R.simulate(sentences, docs.select("doc"), R.Plan()).rank_summary()


@query()
def chunk_pack(spark, sf_dir):
    """Conversations as documents, turns as paragraphs."""
    turns = read(spark, sf_dir, "conversations")
    paras = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("para"), F.coalesce("text", F.lit("")).alias("text"), F.lit(1).alias("page"), F.lit(1).alias("page_end"))
    return P.passages(paras, 120)


@query()
def beagle_order(spark, sf_dir):
    """Over all documents, at the model's own size and longest n-gram."""
    made = N.memory_sums(_sents(spark, sf_dir), N.make("beagle", context=False))
    return made.select("token", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@query()
def mds_map(spark, sf_dir):
    items = V.summed(_space(spark, sf_dir), ["label"], "vec")
    return M.project(items.select(F.col("label").alias("row"), F.col("label").cast("string").alias("label"), "vec"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_topk(spark, sf_dir)
