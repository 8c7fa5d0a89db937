"""Counts of terms, and keyword scores."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

K1, B = 1.2, 0.75


def token_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", portable: bool = True) -> DataFrame:
    """A row for each token: key, sent, pos (from 1), token. portable: Latin folding with built-ins alone."""
    if portable:
        pieces = docs.select(key, F.posexplode(T.portable_sentences(F.col(text))).alias("sent", "_piece"))
        words = F.regexp_extract_all("_piece", F.lit(T.WORD), F.lit(0))
    else:
        pieces = docs.select(key, F.posexplode(T.sentences(F.coalesce(F.col(text), F.lit("")))).alias("sent", "_piece"))
        words = T.tokens(F.col("_piece"))
    found = pieces.select(key, (F.col("sent") + 1).alias("sent"), F.posexplode(words).alias("pos", "token"))
    return found.withColumn("pos", F.col("pos") + 1)


def sentence_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each sentence with a token: key, sent (from 1), words; Latin folding with built-ins alone."""
    pieces = docs.select(key, F.posexplode(T.portable_sentences(F.col(text))).alias("sent", "_piece"))
    cut = pieces.select(key, (F.col("sent") + 1).alias("sent"), F.regexp_extract_all("_piece", F.lit(T.WORD), F.lit(0)).alias("words"))
    return cut.where(F.size("words") > 0)


def vocabulary(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """token, n, first: occurrences and the first place struct(key, sent, pos)."""
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(key, "sent", "pos")).alias("first"))


def term_counts(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    return tokens.groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"))


def lengths(docs: DataFrame, counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Token totals of all documents, 0 for those without tokens."""
    sums = counts.groupBy(key).agg(F.sum("tf").alias("len"))
    return docs.select(key).distinct().join(sums, key, "left").select(key, F.coalesce("len", F.lit(0)).cast("long").alias("len"))


def idf(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """token, df, idf = ln(1 + (N - df + .5) / (df + .5)); totals: one row with N as _n, documents without tokens too."""
    df = counts.groupBy("token").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(totals.select("_n")))
    return df.select("token", "df", F.log1p((F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def bm25(docs: DataFrame, counts: DataFrame, queries: DataFrame, key: str = "doc_id", query: str = "query_id", stored: tuple[DataFrame, int, float] | None = None) -> DataFrame:
    """Scores over 0 of queries(query, token), each token once: query, key, score.

    Only postings of query tokens are joined; idf and the average length are over all documents.
    stored: lengths(key, len), the number of documents and their mean length, if a build has them.
    """
    sizes = stored[0] if stored else lengths(docs, counts, key)
    if stored:
        totals = counts.sparkSession.range(1).select(F.lit(float(stored[1])).alias("_n"), F.lit(float(stored[2])).alias("_mean"))
    else:
        totals = sizes.agg(F.count(F.lit(1)).cast("double").alias("_n"), F.avg("len").alias("_mean"))
    terms = queries.select(query, "token").distinct()
    wanted = terms.select("token").distinct()
    postings = counts.join(wanted, "token", "left_semi")
    weights = idf(postings, totals)
    mean = F.when(F.col("_mean") > 0, F.col("_mean")).otherwise(1.0)
    ready = postings.join(weights, "token").join(sizes, key).crossJoin(F.broadcast(totals.select("_mean")))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
    return ready.select(key, "token", part.alias("_part")).join(terms, "token").groupBy(query, key).agg(F.sum("_part").alias("score"))


def word_match(counts: DataFrame, queries: DataFrame, stop: Iterable[str] = (), key: str = "doc_id", query: str = "query_id") -> DataFrame:
    """Distinct query words in each document; stop words count only for a query of nothing else."""
    terms = query_terms(queries, stop, query)
    return counts.join(terms, "token").groupBy(query, key).agg(F.count(F.lit(1)).alias("score"))


def query_terms(queries: DataFrame, stop: Iterable[str] = (), query: str = "query_id") -> DataFrame:
    """Distinct (query, token) without stop words, but with all where nothing would remain."""
    flagged = queries.select(query, "token").distinct().withColumn("_stop", F.col("token").isin(*stop) if stop else F.lit(False))
    kept = flagged.groupBy(query).agg(F.collect_list(F.when(~F.col("_stop"), F.col("token"))).alias("_kept"), F.collect_list("token").alias("_all"))
    return kept.select(query, F.explode(F.when(F.size("_kept") > 0, F.col("_kept")).otherwise(F.col("_all"))).alias("token"))


def known(queries: DataFrame, vocab: DataFrame, query: str = "query_id") -> DataFrame:
    """Distinct query words with known = whether the vocabulary has them."""
    return queries.select(query, "token").distinct().join(vocab.select("token", F.lit(True).alias("known")), "token", "left").select(query, "token", F.coalesce("known", F.lit(False)).alias("known"))
