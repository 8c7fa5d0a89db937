"""Ranking the rows of a space against queries.

Scores are over whole spaces; masks come after them, as rank fusion and OR scaling depend on all rows.
Ties go by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..functions.shared import numbered

MODES, METHODS = ("compound", "and", "or"), ("semantic", "lexical", "hybrid")
RRF = 60


def scores(space: DataFrame, query: Sequence[float], vec: str = "vec") -> DataFrame:
    """space with score = cosine to one vector, which is a literal of the plan."""
    return space.withColumn("score", V.cosine(F.col(vec), F.array(*[F.lit(float(x)) for x in query])))


def term_scores(space: DataFrame, terms: DataFrame, key: str = "row", vec: str = "vec") -> DataFrame:
    """Every term of a query (term, vec; as few as a query has words) against every row: term, key, score."""
    given = F.broadcast(terms.select("term", F.col(vec).alias("_q")))
    return space.select(key, vec).crossJoin(given).select("term", key, V.cosine(F.col(vec), F.col("_q")).alias("score"))


def combined(by_term: DataFrame, mode: str, key: str = "row") -> DataFrame:
    """and: the product of the terms' scores; or: the largest, each term first divided by |its best score|.

    One term alone is not scaled.
    """
    if mode == "and":
        return by_term.groupBy(key).agg(F.product("score").alias("score"))
    if mode != "or":
        raise ValueError(f"mode is one of {MODES[1:]}")
    best = by_term.groupBy("term").agg(F.max("score").alias("_b"))
    # a row for each term of one query
    size = F.when((F.count(F.lit(1)).over(Window.partitionBy()) == 1) | (F.col("_b") == 0), 1.0).otherwise(F.abs("_b"))
    sized = best.select("term", size.alias("_b"))
    return by_term.join(F.broadcast(sized), "term").groupBy(key).agg(F.max(F.col("score") / F.col("_b")).alias("score"))


def top(scored: DataFrame, k: int | None, mask: Column | None = None, row: str = "row") -> DataFrame:
    """rank from 1, the best k rows that the mask lets through; all of them for None."""
    kept = scored if mask is None else scored.where(mask)
    if k is None:
        return numbered(kept, [F.desc("score"), F.asc(row)], "rank")
    best = kept.orderBy(F.desc("score"), row).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), row)))  # over k rows


def fused(semantic: DataFrame, lexical: DataFrame, weight: float = 0.5, row: str = "row") -> DataFrame:
    """Reciprocal rank fusion: row, score, semantic, lexical. lexical: only matching rows; others add nothing there."""
    if not 0 <= weight <= 1:
        raise ValueError("weight is from 0 to 1")
    a = numbered(semantic.select(row, F.col("score").alias("semantic")), [F.desc("semantic"), F.asc(row)], "_a")
    b = numbered(lexical.where("score > 0").select(row, F.col("score").alias("lexical")), [F.desc("lexical"), F.asc(row)], "_b")
    both = a.join(b, row, "left")
    score = (1 - weight) / (RRF + F.col("_a")) + F.coalesce(weight / (RRF + F.col("_b")), F.lit(0.0))
    return both.select(row, score.alias("score"), "semantic", F.coalesce("lexical", F.lit(0.0)).alias("lexical"))


def similar(source: DataFrame, label, target: DataFrame, k: int | None = 10, mask: Column | None = None) -> DataFrame:
    """The rows of target(row, label, vec) nearest to one item of source; in its own space it is the first."""
    found = source.where(F.col("label") == label).select("vec").first()
    if found is None:
        raise KeyError(label)
    return top(scores(target, found["vec"]), k, mask)


def check(mode: str, method: str, space: str, weight: float) -> None:
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    if method != "semantic" and space != "document":
        raise ValueError(f"{method} search ranks documents")
    if not 0 <= weight <= 1:
        raise ValueError("lexical_weight is from 0 to 1")


def pick(labels: DataFrame, needle: str, k: int = 12) -> DataFrame:
    """label, row: labels that start with needle, then those that hold it; case does not count."""
    at = F.instr(F.lower("label"), F.lit(needle.lower()))
    return labels.where(at > 0).orderBy((at != 1).cast("int"), "row").limit(k)
