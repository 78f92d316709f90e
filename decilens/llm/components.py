"""Connected components of an undirected graph, by alternating star contractions.

Every round is two grouped minima and two joins on the edges that are left, in which a node
with very many edges is dealt to several tasks; the work per round follows the number of edges and the number of rounds the logarithm of the longest
path. Nothing is collected, and each star ends in a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decilens.llm._io import cut, hot_keys, spread


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Hang the neighbours of each node on the least node of its neighbourhood.

    ``edges`` holds each undirected edge once with a > b. The large star moves only
    neighbours above the node, the small star only those below it. A node with a large part of
    all ``total`` edges is dealt to several tasks.
    """
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select("a", "b")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    moved = spread(both, least.select("a", "m"), ["a"], hot_keys(least.select("a", "n"), total), "b")
    if large:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(moved.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of one orderable type to ``(node, component)``: the least node reachable.

    Nodes without an edge do not appear; self-loops, nulls and repeated edges are ignored.
    """
    now = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    seen, total = None, now.count()
    while True:
        now = cut(_star(cut(_star(now, True, total)), False, total))
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.hash("b", "a"))).first()
        if state == seen:
            break
        seen = state
    tops = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops)
