"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share: spark.checkpoint.dir.

    Only a session on one machine may leave that unset.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/quillspace/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; data frames that read them are of no use then."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it comes in fewer partitions, as small files do; for work that is heavy for its bytes."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """df with its place, from 1, in a global order, without gathering all rows in one task.

    Rows are range-sorted (or taken as they come, without an order), numbered within their partitions,
    and shifted by the sizes of the partitions before, of which there are as many as tasks.
    """
    marked = kept((df.orderBy(*order) if order else df).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33).alias("_part")
    sizes = {r["_part"]: r["n"] for r in marked.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, rows = 0, []
    for k in sorted(sizes):
        rows.append((k, before))
        before += sizes[k]
    starts = df.sparkSession.createDataFrame(rows, "_part long, _before long")
    joined = marked.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(starts), "_part")
    place = F.col("_before") + F.col("_at") - F.shiftleft("_part", 33) + 1
    return joined.withColumn(out, place.cast("long")).drop("_at", "_part", "_before")


def numbered_within(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """df with its place, from 1, within each key; a key may hold any share of the rows.

    Places in one order by key are shifted by where each key starts.
    """
    placed = numbered(df, [*[F.asc(k) for k in keys], *order], "_place")
    starts = placed.groupBy(*keys).agg(F.min("_place").alias("_start"))
    return placed.join(starts, keys).withColumn(out, F.col("_place") - F.col("_start") + 1).drop("_place", "_start")
