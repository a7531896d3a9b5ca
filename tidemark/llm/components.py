"""Connected components of a graph that no machine holds: alternating star contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) of every node of the edges (a, b), but for roots themselves.

    Each round hooks larger neighbours to the smallest (large star), then smaller ones (small star), until the stars stand
    still; minima are pre-aggregated before the shuffle and written to the shared folder, so that the joins that follow
    are of plain tables and Spark can split a hub.  Rounds grow
    with the logarithm of the longest chain; running out of them is an error, never a partial result.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        # large star: every larger neighbour of a node goes to the smallest of the node and its neighbours
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = stored(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "large")
        # small star: a node's smaller neighbours, and the node, go to the smallest of them
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = stored(small.select("e.*").filter("a <> b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(now)
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
