"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.common import drop, written


def _large(edges: DataFrame) -> DataFrame:
    """Each node hangs its larger neighbours on the smallest node it knows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Each node hangs its smaller neighbours, and itself, on the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    joined = down.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(node, component) of every node of ``edges(a, b)`` but the smallest of each component, and the table's path.

    A round takes two joins on node ids; stars of any size are split by node, never gathered. The
    number of rounds grows with the logarithm of the longest chain.
    """
    spark = edges.sparkSession
    edges, path = written(_small(edges.select("a", "b")), "components")
    mark = None
    while True:
        seen = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (seen.n, seen.x) == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")), path
        mark = seen.n, seen.x
        if not seen.n:
            continue
        after, new = written(_small(_large(edges)), "components")
        drop(spark, path)
        edges, path = after, new
