"""Incremental conversion: new files in a folder, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.plans.convert import Conversion
from graphloom.sources.express import Catalog
from graphloom.sources.spf import assemble, schemas


def convert_stream(spark: SparkSession, folder: str, catalogs: dict[str, Catalog], base: str, sink: Callable[[Conversion, int], None], checkpoint: str, glob: str = "*.ifc", available_now: bool = True) -> StreamingQuery:
    """Converts files as they arrive; `sink(conversion, batch_id)` gets each batch of whole files.

    A file is read in one piece, because a conversion needs all of it. With `available_now` the query ends
    when the present files are done; otherwise it goes on. A batch that is repeated after a failure has the
    same id, so a sink that overwrites by id is exact.
    """
    source = spark.readStream.format("text").schema("value string").option("wholetext", "true").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    files = source.select(F.col("_metadata.file_path").alias("file"), "value")

    def batch(df: DataFrame, batch_id: int) -> None:
        parts = F.posexplode(F.split("value", r"\r\n|\n|\r"))
        lines = df.select("file", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("row"), parts.alias("part", "line"))
        sink(Conversion(assemble(lines), schemas(lines), catalogs, base), batch_id)

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
