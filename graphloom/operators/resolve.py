"""Keyed upserts, duplicate removal, reference resolution and dangling checks, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.scratch import materialize


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of greatest `order` for each key."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    return df.groupBy(*keys).agg(best).select(*keys, "row.*").select(*df.columns)


def canonical(df: DataFrame, group: list[str], key: str, alias: str = "canonical") -> DataFrame:
    """Every row with the least `key` among the rows equal in `group`, nulls being equal. One pass, nothing is merged again.

    The least keys are written first: both sides of the join are plain shuffles then, and adaptive execution can
    split the partition of a group that holds a great part of all rows.
    """
    least = materialize(df.groupBy(*[F.col(c).alias(f"_group_{c}") for c in group]).agg(F.min(key).alias(alias)), "least")
    match: Column = F.lit(True)
    for c in group:
        match &= F.col(c).eqNullSafe(F.col(f"_group_{c}"))
    return df.join(least, match).select(*df.columns, alias)


def survivors(df: DataFrame, group: list[str], key: str) -> DataFrame:
    """Rows that are their own canonical ones."""
    return canonical(df, group, key, "_least").where(F.col(key) == F.col("_least")).drop("_least").select(*df.columns)


def redirect(refs: DataFrame, ref: str, renamed: DataFrame, old: str, new: str, on: tuple[str, ...] = ()) -> DataFrame:
    """`refs` with column `ref` replaced by `new` where `renamed` (on, old, new) has it as `old`."""
    other = renamed.select(*[F.col(c).alias(f"_{c}") for c in on], F.col(old).alias("_old"), F.col(new).alias("_new"))
    match: Column = F.col(ref) == F.col("_old")
    for c in on:
        match &= F.col(c) == F.col(f"_{c}")
    joined = refs.join(other, match, "left")
    return joined.withColumn(ref, F.coalesce("_new", ref)).select(*refs.columns)


def dangling(refs: DataFrame, ref: str, targets: DataFrame, key: str, on: tuple[str, ...] = ()) -> DataFrame:
    """References without a target."""
    other = targets.select(*[F.col(c).alias(f"_{c}") for c in on], F.col(key).alias("_key"))
    match: Column = F.col(ref) == F.col("_key")
    for c in on:
        match &= F.col(c) == F.col(f"_{c}")
    return refs.join(other, match, "left_anti")


def abort_groups(df: DataFrame, bad: DataFrame, on: list[str]) -> DataFrame:
    """Rows of groups that `bad` doesn't name."""
    return df.join(bad.select(*on).distinct(), on, "left_anti")
