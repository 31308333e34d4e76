"""Connected components of a graph given as edges, by alternating star operations.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): each round ties
larger neighbours, then smaller neighbours, to the smallest node in reach, until every
component is a star around its smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from twinsift.skew import with_aggregates
from twinsift.staging import discard, stage_counted


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an edge; the component is its smallest node.

    A round is one job: it writes the next edges and counts, on the way, how many it has moved.
    The round that moves none is the last one, and each round's table is deleted after the next.
    """
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u > v")
    pairs, n = stage_counted(pairs, "edges")
    moved = n
    while moved:
        large, small = Observation(), Observation()
        before = pairs
        pairs, n = stage_counted(_small_star(_large_star(pairs, n, large), n, small), "edges")
        moved = sum(seen.get.get("moved") or 0 for seen in (large, small))
        discard(before)
    # By now each node that is no centre has exactly one edge, to its centre.
    leaves = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _large_star(pairs: DataFrame, n: int, seen: Observation) -> DataFrame:
    """Tie each node's larger neighbours to the smallest of the node and its neighbours."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = with_aggregates(both, ["u"], {"low": F.min("v")}, 2 * n)
    larger = joined.where("v > u").observe(seen, F.count_if(F.expr("low < u")).alias("moved"))
    return larger.select(F.col("v").alias("u"), F.least("low", "u").alias("v"))


def _small_star(pairs: DataFrame, n: int, seen: Observation) -> DataFrame:
    """Tie each node and its smaller neighbours to the smallest of them."""
    joined = with_aggregates(pairs, ["u"], {"low": F.min("v")}, n)
    joined = joined.observe(seen, F.count_if(F.expr("low < v")).alias("moved"))
    own = F.struct(F.col("u"), F.col("low").alias("v"))
    other = F.struct(F.col("v").alias("u"), F.col("low").alias("v"))
    return joined.select(F.explode(F.array(own, other)).alias("e")).select("e.u", "e.v").where("u > v").distinct()
