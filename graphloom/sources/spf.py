"""Exchange-file reader: text lines to statements, with the schema that each file's header names.

A statement begins at a line whose first character is `#` and ends at the first line that contains `;`, itself
included; trimmed lines are joined. All other lines are ignored. Lines keep the order of their file by block
offset and position, so large files may be split among tasks while they are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.lexical import sniff_schema, trim_control


def read_lines(spark: SparkSession, *paths: str, glob: str | None = "*.ifc") -> DataFrame:
    """(file, block, row, line) of all files in `paths`; folders are read with their subfolders."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))
    # a carriage return alone ends a line too
    parts = F.posexplode(F.split(F.regexp_replace("line", r"\r$", ""), r"\r\n|\r"))
    return lines.select("file", "block", "row", parts.alias("part", "line"))


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file): every file below a folder, in order of name; a folder that doesn't exist has none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "file string")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.col("path").alias("file")).orderBy("file")


def assemble(lines: DataFrame, keys: tuple[str, ...] = ("file",), order: tuple[str, ...] = ("block", "row", "part"), line: str = "line") -> DataFrame:
    """keys, ord and text of statements: gaps and islands over terminators.

    A segment ends with a line that contains `;`. In a segment the statement begins at the first line that
    starts with `#`; a segment without one has no statement. A last one that never ends counts too.
    """
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ends = F.sum(F.col(line).contains(";").cast("long")).over(before)
    marked = lines.select(*keys, F.struct(*order).alias("at"), F.col(line).alias("line"), F.coalesce(ends, F.lit(0)).alias("segment"))
    upto = Window.partitionBy(*keys, "segment").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.max(F.col("line").startswith("#").cast("int")).over(upto)
    inside = marked.withColumn("begun", begun).where("begun = 1")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", trim_control("line").alias("text")))), lambda x: x["text"]), "")
    return inside.groupBy(*keys, "segment").agg(joined.alias("text")).withColumnRenamed("segment", "ord")


def schemas(lines: DataFrame) -> DataFrame:
    """(file, schema) of the first line of each file that starts with FILE_SCHEMA; empty without one."""
    header = F.when(F.col("line").startswith("FILE_SCHEMA"), F.struct("block", "row", "part", "line"))
    first = lines.groupBy("file").agg(F.min(header).alias("first"))
    return first.select("file", F.coalesce(sniff_schema("first.line"), F.lit("")).alias("schema"))


def read_statements(spark: SparkSession, *paths: str, glob: str | None = "*.ifc") -> tuple[DataFrame, DataFrame]:
    """Statements (file, ord, text) and schemas (file, schema) of the files."""
    lines = read_lines(spark, *paths, glob=glob)
    return assemble(lines), schemas(lines)
