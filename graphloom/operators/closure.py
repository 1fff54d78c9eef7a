"""Transitive closure of a hierarchy by doubling: each round joins the pairs that are new with all pairs so far."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.scratch import materialize


def closure(edges: DataFrame, sub: str, super_: str) -> DataFrame:
    """(sub, super) of all pairs that a path of edges joins; null ends are left out, cycles are allowed.

    A round finds the paths that continue a new pair by a known one; paths double, so the number of rounds is
    logarithmic in the longest. Each round's new pairs are a written table, and it ends when there are none.
    """
    pairs = edges.select(edges[sub].alias("sub"), edges[super_].alias("super")).where("sub is not null and super is not null").distinct()
    known = new = materialize(pairs, "closure")
    while not new.isEmpty():
        on = lambda df, a, b: df.select(F.col("sub").alias(a), F.col("super").alias(b))
        longer = on(new, "sub", "mid").join(on(known, "mid", "super"), "mid").select("sub", "super")
        if new is not known:  # known pairs before new ones: paths whose first part is old
            longer = longer.union(on(known, "sub", "mid").join(on(new, "mid", "super"), "mid").select("sub", "super"))
        found = longer.distinct().join(known, ["sub", "super"], "left_anti")
        new = materialize(found, "closure")
        known = known.union(new)
    return known

