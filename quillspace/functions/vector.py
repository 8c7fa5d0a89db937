"""Vectors as array<float> or array<double> columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norms: Column | None = None) -> Column:
    """0 where a vector is zero."""
    size = norm(a) * norm(b) if norms is None else norms
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value made once: as a part of a function over elements it would be made again for each of them."""
    return F.transform(F.array(value), use)[0]


def unit(a: Column) -> Column:
    """A zero vector stays zero."""
    return _once(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(F.transform(a, lambda x: x.cast("double"))))


def roll(a: Column, k: int) -> Column:
    """Places moved up by k, the last ones to the front."""
    size = F.size(a)
    first = F.pmod(F.lit(-k), size)
    return F.concat(F.slice(a, first + 1, size), F.slice(a, F.lit(1), first))


def abs_max(a: Column) -> Column:
    """|largest element|, 1 if that is 0."""
    top = F.abs(F.array_max(a))
    return F.when(top == 0, F.lit(1.0)).otherwise(top)


def quantize(a: Column) -> Column:
    """struct<q: array<tinyint>, scale: double>: 127ths of the largest magnitude, half to even; zero vectors scale by 1/127."""
    top = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    return _once(F.when(top > 0, top).otherwise(1.0), lambda t: F.struct(F.transform(a, lambda x: F.rint(x.cast("double") / t * 127).cast("tinyint")).alias("q"), (t / 127).alias("scale")))


def dequantize(q: Column) -> Column:
    return F.transform(q["q"], lambda x: x * q["scale"])


def summed(df: DataFrame, keys: list[str], vec: str, how: str = "sum") -> DataFrame:
    """Sum or mean of vec for each key; partial sums are made before the shuffle."""
    fold = {"sum": Summarizer.sum, "mean": Summarizer.mean}[how]
    made = df.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>"))).groupBy(*keys)
    return made.agg(vector_to_array(fold(F.col("_v"))).alias(vec), F.count(F.lit(1)).alias("n"))
