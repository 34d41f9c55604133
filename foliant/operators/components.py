"""Connected components of an edge table by alternating star contractions (Kiveris et al., 2014).

Large-star links every larger neighbour of a node to the smallest member of its neighbourhood, small-star does it for
the smaller neighbours; both are one shuffle by node and stop after O(log^2 n) rounds. No component is ever gathered
in one task: stars are formed by joining a per-node minimum, which is combined on the map side.

Cases: loops and repeated edges are allowed, edges with a null end are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (hi, lo) with hi > lo, distinct."""
    if large:
        both = edges.select("hi", "lo").union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    else:
        both = edges
    # (node, neighbour); the smallest of node and neighbours is the centre
    centre = both.groupBy("hi").agg(F.min("lo").alias("least")).select(F.col("hi").alias("_node"), F.least("hi", "least").alias("_centre"))
    linked = both.join(centre, both["hi"] == centre["_node"])
    if large:
        moved = linked.where(F.col("lo") > F.col("hi")).select(F.col("lo").alias("hi"), F.col("_centre").alias("lo"))
    else:
        moved = linked.select(F.col("lo").alias("hi"), F.col("_centre").alias("lo")).union(linked.select("hi", F.col("_centre").alias("lo")))
    return moved.where(F.col("hi") > F.col("lo")).distinct()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): every node of an edge with the smallest node of its component."""
    pairs = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    nodes = cut(pairs.distinct())
    state = nodes.where(F.col("hi") > F.col("lo"))
    before = None
    for _ in range(max_rounds):
        state = cut(_star(_star(state, True), False))
        now = state.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("hi", "lo").cast("long")).alias("h"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    every = nodes.select(F.col("hi").alias("node")).union(nodes.select(F.col("lo").alias("node"))).distinct()
    return every.join(state, every["node"] == state["hi"], "left").select("node", F.coalesce("lo", "node").alias("component"))
