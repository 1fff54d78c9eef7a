"""Shared plumbing of the training-data operators: tables, scratch space and key helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.scratch import cleanup, drop_scratch, materialize, scratch_path, shared_dir

__all__ = ["cleanup", "drop_scratch", "map_columns", "materialize", "scratch_path", "shared_dir", "table", "unit_digest", "unit_hash", "word_count"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the synthetic tables, read by Spark alone (the path may be remote)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_hash(*cols: Column | str, seed: int = 0) -> Column:
    """Deterministic uniform value in (0, 1) of the columns' values; null counts as a value."""
    h = F.xxhash64(F.lit(seed), *cols)
    return (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def unit_digest(*cols: Column | str, seed: int = 0) -> Column:
    """As `unit_hash`, from 52 bits of an MD5 digest, which other SQL engines have too."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def word_count(text: Column | str) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` runs of a text; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    # every run of other characters becomes one separator-free mark, so the count is a length
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


#: Most rows of an Arrow batch; whole texts are rows, and a batch is held several times over.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of Python stages by smaller Arrow batches, for the session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def map_columns(df: DataFrame, compute: Callable[[dict[str, list]], dict[str, list]], added: str, keep: tuple[str, ...]) -> DataFrame:
    """Columns `keep` of `df` unchanged, and beside them the columns `added` (DDL) that `compute` makes.

    `compute` gets an Arrow batch as lists by column name and returns lists of the same length. Values stay
    exact: nothing passes through pandas, whose integers with nulls would become floats.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(df.sparkSession)
    more = T.StructType.fromDDL(added)
    schema = T.StructType([*(df.schema[c] for c in keep), *more])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fields = to_arrow_schema(more)
        for batch in batches:
            made = compute({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
            columns = [batch.column(batch.schema.names.index(c)) for c in keep]
            columns += [pa.array(made[f.name], f.type, from_pandas=False) for f in fields]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *(f.name for f in fields)])

    return df.mapInArrow(run, schema)
