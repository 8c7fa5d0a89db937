"""Connected components by alternating stars, on shuffles only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> node, root: for each node of an edge the smallest node it reaches.

    Large and small stars in turn link each node to the smallest one seen near it, until nothing
    changes; rounds grow with the logarithm of a component's size. Each round is written to the shared
    folder. The smallest neighbour is a partial aggregate and large stars are split as skewed joins, so
    a hub needs no task of its own. Self-loops and nulls are passed over; no edges give no rows.
    """
    links = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links, before = materialize(links, "links"), None
    while True:
        state = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "links", 2 * state[0])
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        links = materialize(small.distinct(), "links", 2 * state[0])
