"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessella.llm import common


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) of every node of the edges a, b.

    Each round points nodes at smaller neighbours: large-star joins each node's
    larger neighbours to its least neighbour, small-star its smaller ones.  The
    number of edges never grows, each round is a written table, and rounds go on
    until one changes nothing, as a star forest does not.  Stars of hot nodes are aggregated before they are joined
    back, and the join splits skewed nodes.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = common.written(edges, "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        # After large-star every edge points down; small-star joins what a node points at.
        low = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b"))
        edges = common.written(small.where("a <> b").distinct(), "edges")
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Equal before and after a round only if the round changed nothing."""
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(r)
