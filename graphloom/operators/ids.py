"""Identifier seeds, literal interning and allocation of ids as running sums.

A running sum over a whole file would sort the file in one task. Here a file is dealt into blocks of its order
column, blocks are summed first, and the sums of earlier blocks are added inside each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seed(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """First free id of each group: one above both its row count and its greatest number."""
    return df.groupBy(*keys).agg((F.greatest(F.count("*"), F.max(number)) + 1).alias("seed"))


def first_of(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """keys and `columns` of the first row of each key, by partial aggregates."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("first")).select(*keys, "first.*")


def running(df: DataFrame, keys: list[str], block: Column, order: list[str], amount: str, alias: str) -> DataFrame:
    """`df` with the sum of `amount` over its group up to and including the row.

    `block` must not fall along `order`; only rows of one block are sorted together. Null keys are a group.
    """
    marked = df.withColumn("_block", block)
    blocks = marked.groupBy(*keys, "_block").agg(F.sum(amount).alias("_sum"))
    along = Window.partitionBy(*keys).orderBy("_block")
    earlier = blocks.select(*keys, "_block", (F.sum("_sum").over(along) - F.col("_sum")).alias("_before"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = [*keys, "_block"]
    renamed = earlier.select(*(F.col(c).alias(f"_own_{c}") for c in own), "_before")
    match = F.lit(True)
    for c in own:
        match &= F.col(c).eqNullSafe(F.col(f"_own_{c}"))
    joined = marked.join(renamed, match).drop(*(f"_own_{c}" for c in own))
    return joined.withColumn(alias, F.col("_before") + F.sum(amount).over(inside)).drop("_block", "_before")
