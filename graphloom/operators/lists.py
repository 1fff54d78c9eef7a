"""Ordered collections as chains of nodes, unordered ones as direct edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_nodes(df: DataFrame, key: str, items: str) -> DataFrame:
    """(key, node, contents, next_node) of an array column: node counts from 1, the last has no next.

    The next node is known from the array's size, so no window is needed.
    """
    flat = df.select(key, F.size(items).alias("n"), F.posexplode(items).alias("i", "contents"))
    return flat.select(key, (F.col("i") + 1).alias("node"), "contents", F.when(F.col("i") + 1 < F.col("n"), F.col("i") + 2).alias("next_node"))


def nested_nodes(df: DataFrame, key: str, lists: str) -> DataFrame:
    """(key, outer_node, inner_node, contents, next_inner, next_outer) of an array of arrays."""
    outer = df.select(key, F.size(lists).alias("m"), F.posexplode(lists).alias("i", "inner"))
    inner = outer.select(key, "m", "i", F.size("inner").alias("n"), F.posexplode("inner").alias("j", "contents"))
    after = lambda c, n: F.when(F.col(c) + 1 < F.col(n), F.col(c) + 2)
    return inner.select(key, (F.col("i") + 1).alias("outer_node"), (F.col("j") + 1).alias("inner_node"), "contents", after("j", "n").alias("next_inner"), after("i", "m").alias("next_outer"))


def set_edges(df: DataFrame, subject: str, item: str) -> DataFrame:
    """One edge for each distinct pair."""
    return df.select(subject, item).distinct()
