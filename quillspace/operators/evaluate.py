"""How well methods find documents again, and how alike they rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import numbered_within


def average_rank(scored: DataFrame, keys: list[str], score: str = "score", out: str = "rank") -> DataFrame:
    """Descending ranks within keys; ties share their mean. Places come from one order over all keys, so no key is gathered in a task."""
    placed = numbered_within(scored, keys, [F.desc(score)], "_p")
    tied = placed.groupBy(*keys, score).agg(F.avg("_p").alias(out))
    return placed.drop("_p").join(tied, [*keys, score])


def target_ranks(scored: DataFrame, targets: DataFrame, keys: list[str], item: str = "item") -> DataFrame:
    """keys, rank: 1 + rows over the target's score + half of its ties. targets: keys, item.

    Two conditional sums; no row is sorted.
    """
    own = scored.join(targets, [*keys, item]).select(*keys, F.col("score").alias("_t"))
    both = scored.join(own, keys)
    more = F.sum((F.col("score") > F.col("_t")).cast("long"))
    same = F.sum((F.col("score") == F.col("_t")).cast("long"))
    return both.groupBy(*keys).agg((1 + more + (same - 1) / 2).alias("rank"))


def spearman(scored: DataFrame, keys: list[str], item: str = "item", method: str = "method") -> DataFrame:
    """keys, method_a, method_b, rho over items for each pair of methods; 0 where ranks do not vary."""
    ranked = average_rank(scored, [*keys, method]).select(*keys, method, item, "rank")
    a = ranked.select(*keys, item, F.col(method).alias("method_a"), F.col("rank").alias("_a"))
    b = ranked.select(*keys, item, F.col(method).alias("method_b"), F.col("rank").alias("_b"))
    pairs = a.join(b, [*keys, item]).where("method_a < method_b")
    rho = F.corr("_a", "_b")
    return pairs.groupBy(*keys, "method_a", "method_b").agg(F.when(rho.isNull() | F.isnan(rho), 0.0).otherwise(rho).alias("rho"))


def rank_summary(ranks: DataFrame, keys: list[str]) -> DataFrame:
    hit = lambda k: F.avg((F.col("rank") <= k).cast("double"))
    return ranks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.median("rank").alias("median_rank"), F.avg(1 / F.col("rank")).alias("mrr"), hit(1).alias("top1"), hit(10).alias("top10"))


def agreement_summary(rho: DataFrame, keys: list[str]) -> DataFrame:
    return rho.groupBy(*keys).agg(F.avg("rho").alias("mean_rho"), F.coalesce(F.stddev_samp("rho"), F.lit(0.0)).alias("sd_rho"))


def sampled_tokens(tokens: DataFrame, percent: int, seed: int = 0, key: str = "doc_id", order: tuple[str, ...] = ("sent", "pos")) -> DataFrame:
    """max(1, round(n * percent / 100)) tokens of each document (half to even), by md5 of seed, percent and place."""
    place = F.md5(F.concat_ws("#", F.lit(seed), F.lit(percent), *[F.col(c).cast("string") for c in (key, *order)]))
    at = F.row_number().over(Window.partitionBy(key).orderBy(place, *order))
    size = F.count(F.lit(1)).over(Window.partitionBy(key))
    wanted = F.greatest(F.lit(1), F.bround(size * percent / 100.0))
    return tokens.withColumn("_at", at).withColumn("_m", wanted).where("_at <= _m").drop("_at", "_m")


def associates(tokens: DataFrame, near: DataFrame, outside: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """tokens with each word replaced by its nearest neighbour (query, label, rank) or, given outside(key, token),
    by the nearest one that the document does not have, else the nearest anyway; words without one stay.
    """
    options = near.select(F.col("query").alias("token"), F.col("label").alias("_o"), F.col("rank").alias("_r"))
    places = [c for c in tokens.columns if c != "token"]
    if outside is None:
        return tokens.join(options.where("_r = 1"), "token", "left").select(*places, F.coalesce("_o", "token").alias("token"))
    words = tokens.select(key, "token").distinct().join(options, "token", "left")
    held = outside.select(key, F.col("token").alias("_o"), F.lit(1).alias("_in")).distinct()
    best = words.join(held, [key, "_o"], "left").groupBy(key, "token").agg(F.min_by("_o", F.struct(F.coalesce("_in", F.lit(0)), "_r")).alias("_o"))
    return tokens.join(best, [key, "token"]).select(*places, F.coalesce("_o", "token").alias("token"))

