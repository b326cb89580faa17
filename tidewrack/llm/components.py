"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import forget, keep

#: Edges that one file of a round holds, and the least number of files.
FILE_EDGES, FILES = 1_000_000, 8


def connect(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of (a, b) edges, which are binary; root is the smallest node of its component.

    Each step is a partial aggregation and a join; nothing but a count and a checksum
    reaches the driver.  A step's edges are written to the shared folder, which cuts the
    lineage, and those of the step before are deleted.  Edges with a null end or equal
    ends are left out.

    A component's centre has as many edges as the component has nodes.  The least
    neighbours come through an exchange of their own, not through the one that the
    aggregation used, so that Spark can split a centre's edges over tasks.
    """
    e = keep(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    mark = _mark(e)
    for _ in range(rounds):
        files = max(FILES, mark[0] // FILE_EDGES)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = apart(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = keep(large.coalesce(files), "cc")
        best = apart(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(best, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        last, e = e, keep(small.coalesce(files), "cc")
        forget(last)
        forget(large)
        if (now := _mark(e)) == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = now
    raise RuntimeError("the components did not settle")


def apart(df: DataFrame, key: str = "u") -> DataFrame:
    """The same rows under a binary key that hides how they are dealt: a join deals them anew, and can split its other side."""
    return df.withColumn(key, F.concat(key, F.unhex(F.lit(""))))


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
