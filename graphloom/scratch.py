"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Set inside graphloom scratch folders so that `cleanup` removes nothing else.
SCRATCH_PREFIX = "graphloom-"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: `spark.checkpoint.dir` of the session.

    Only where the setting is absent (tests, a single local JVM) a temporary folder of this machine
    is made and set; on a cluster the setting must exist.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="graphloom-checkpoints-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{SCRATCH_PREFIX}{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes `df` as a table in the shared folder and reads it back.

    The lineage ends there and lost executors cost no recomputation beyond the table.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Deletes a table made by `materialize` that no pending plan reads any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if f"/{SCRATCH_PREFIX}" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def cleanup(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this session's shared folder; no plan over them may still run."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    pattern = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{SCRATCH_PREFIX}*")
    fs = pattern.getFileSystem(conf)
    for found in fs.globStatus(pattern) or ():
        fs.delete(found.getPath(), True)
