"""Connected components of a graph held in a DataFrame.

Alternating large-star and small-star steps: every step links each node to the smallest
node among its neighbours, until only stars are left.  Edges stay distributed; the driver sees
one count and one checksum a round.  Hubs (a node with a third of all edges) are split by
salted joins, and the smallest neighbours are pre-aggregated map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics.llm.common import materialize, salted_join


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: ``a``, ``b`` (long, in any order, repeats and loops allowed; rows with a null are
    no edge).  Returns ``node``, ``root`` (smallest node reachable) for every node that has an edge
    to another one.  An empty frame gives an empty result."""
    e = (edges.where(F.col("a") != F.col("b"))
         .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    e, before = materialize(e), None
    for _ in range(rounds):
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not state[0] or state == before:
            break
        before = state
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: every larger neighbour of a node goes to the node's smallest one.
        e = (salted_join(both.where("b > a"), low, ["a"], ["b"])
             .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct())
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        # Small star: the smaller neighbours of a node, and the node, go to the smallest one.
        e = (salted_join(e, low, ["a"], ["b"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
             .union(low.select("a", F.col("m").alias("b"))).where("a != b").distinct())
        e = materialize(e)
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
