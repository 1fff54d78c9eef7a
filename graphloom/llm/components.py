"""Connected components by alternating large-star and small-star steps, as joins and minima.

Edges stay distributed; a step never gathers a node's neighbours, it only takes their minimum. Each round is
written to the shared folder, so that a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import drop_scratch, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins every larger neighbour of a node to the least one of the node's neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges (u, v) with v < u: joins the smaller neighbours of a node, and itself, to the least one."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for every node on an edge of (a, b).

    Self-loops and null ends are ignored; an empty table gives an empty one. It ends when a round of both
    steps changes nothing; the number of rounds is logarithmic in the size of a component.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = materialize(pairs.where("u > v").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        after = materialize(_small_star(_large_star(now)), "edges")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_scratch(now)
        now = after
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    heads = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.union(heads)
