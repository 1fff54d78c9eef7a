"""Set operations on triple tables, and Turtle blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).dropDuplicates()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b.select(*a.columns))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows of each side that the other lacks, duplicates counted. Both 0: equal."""
    b = b.select(*a.columns)
    marked = a.groupBy(*a.columns).agg(F.count("*").alias("n")).withColumn("side", F.lit(1))
    marked = marked.unionByName(b.groupBy(*b.columns).agg(F.count("*").alias("n")).withColumn("side", F.lit(-1)))
    net = marked.groupBy(*a.columns).agg(F.sum(F.col("n") * F.col("side")).alias("net"))
    plus = lambda sign: F.coalesce(F.sum(F.greatest(F.col("net") * sign, F.lit(0))), F.lit(0))
    return net.agg(plus(1).alias("only_left"), plus(-1).alias("only_right"))


def equal(a: DataFrame, b: DataFrame) -> bool:
    """Graphs here have no blank nodes, so equality of triples is isomorphism."""
    row = compare(a, b).first()
    return row["only_left"] == row["only_right"] == 0


def unpivot(df: DataFrame, subject: Column, columns: dict[str, Column]) -> DataFrame:
    """(subject, predicate, object) with one row for each column that isn't null."""
    pairs = F.array(*[F.struct(F.lit(p).alias("predicate"), c.cast("string").alias("object")) for p, c in columns.items()])
    return df.select(subject.alias("subject"), F.explode(pairs).alias("x")).select("subject", "x.*").where("object is not null")


def constants(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "subject string, predicate string, object string")


def blocks(df: DataFrame, keys: list[str], order: list[str], subject: str, line: Column) -> DataFrame:
    """keys, at (order of its first row), subject and lines (array) of runs of rows with one subject.

    Runs are found inside the groups of `keys`; a run has the number of its changes so far.
    """
    along = Window.partitionBy(*keys).orderBy(*order)
    changed = F.coalesce((F.lag(subject).over(along) != F.col(subject)).cast("long"), F.lit(1))
    marked = df.select(*keys, *order, subject, line.alias("_line")).withColumn("_changed", changed)
    run = F.sum("_changed").over(along.rowsBetween(Window.unboundedPreceding, 0))
    rows = F.transform(F.array_sort(F.collect_list(F.struct(*order, "_line"))), lambda x: x["_line"])
    grouped = marked.withColumn("_run", run).groupBy(*keys, subject, "_run").agg(F.min(F.struct(*order)).alias("at"), rows.alias("lines"))
    return grouped.drop("_run")
