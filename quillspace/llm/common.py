"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shared import shared_path

#: A key is hot when it holds more than one row in this many; so at most this many keys are hot.
HOT_SHARE = 1000
#: Narrow rows in a partition of a table whose size is known.
ROWS_PER_PART = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frugal(scan: Callable[[Iterator], Iterator], forget: Callable[[], None] | None = None) -> Callable[[Iterator], Iterator]:
    """scan, a function for mapInArrow(), which gives freed memory back to the system when a task ends.

    Python workers outlive their tasks and serve other stages, so what each leaves behind would add up.
    forget: a function of a module, which drops what the worker keeps there.
    """

    def run(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        try:
            yield from scan(batches)
        finally:
            if forget is not None:
                forget()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return run


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized(df: DataFrame, rows: int, each: int = ROWS_PER_PART) -> DataFrame:
    """df of `rows` narrow rows at most, in no more partitions than hold `each` of them; so small tables are few files."""
    return df.coalesce(max(1, -(-rows // each)))


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut, and a lost executor loses no work.

    rows: a bound of its rows if one is known and they are narrow; see sized().
    """
    spark = df.sparkSession
    df = df if rows is None else sized(df, rows)
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, salts: int, bounded: bool = False) -> DataFrame:
    """Add a gapless number from 0 within each key, in no particular order over the whole key.

    Rows of a key are split over `salts` hash buckets, numbered there, and shifted by the counts of
    the buckets before; so no task ever holds a whole hot key. Equal rows get distinct numbers.
    bounded: the number of distinct keys has a fixed bound, and keys times salts rows can be broadcast.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy(*keys, "_salt").count()
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_salt").orderBy(*order)
    numbered = salted.withColumn("_within", F.row_number().over(within) - 1)
    joined = numbered.join(F.broadcast(counts) if bounded else counts, [*keys, "_salt"])
    return joined.withColumn(out, (F.col("_before") + F.col("_within")).cast("long")).drop("_salt", "_before", "_within")


def join_hot(left: DataFrame, right: DataFrame, key: str, n_col: str, total: int) -> DataFrame:
    """Inner join of left to right, unique by key, where a few keys may hold most rows of left.

    right[n_col] is the number of rows of left with the key. Keys with over total / HOT_SHARE rows
    number less than HOT_SHARE, so they are broadcast; the others are shuffled. Both inputs are
    read twice and should be materialized. n_col is dropped.
    """
    least = total / HOT_SHARE
    hot = right.where(F.col(n_col) > least).drop(n_col)
    cold = right.where(F.col(n_col) <= least).drop(n_col)
    keys = hot.select(key)
    return left.join(F.broadcast(hot), key).unionByName(left.join(F.broadcast(keys), key, "left_anti").join(cold, key))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
