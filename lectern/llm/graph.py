"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: neighbours above a node go to its least neighbour; small: the node and neighbours below it do."""
    both = edges.union(edges.select("y", "x").toDF("x", "y")) if large else edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
    joined = both.join(least, "x")
    out = joined.filter(F.col("y") > F.col("x")).select(F.col("y").alias("x"), F.col("m").alias("y")) if large else joined.select(F.col("y").alias("x"), F.col("m").alias("y")).union(least.select("x", F.col("m").alias("y")))
    return out.filter("x <> y").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the least node reachable) of each node of edges (x, y: long). Fails where `rounds` do not do."""
    edges = staged(edges.select("x", "y").filter("x <> y").distinct(), "edges")
    last = None
    for _ in range(rounds):
        before, edges = edges, staged(_star(_star(edges, True), False), "edges")
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("x", "y"), F.lit(1 << 40)))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    return edges.select(F.col("x").alias("node"), F.col("y").alias("component")).union(edges.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct())
