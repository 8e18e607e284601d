"""Starting streams and reading what they wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sluice import workdir


def read_files(spark: SparkSession, folder: str, schema: StructType, files: str = "*.parquet",
               files_per_trigger: int | None = None) -> DataFrame:
    """Stream over the parquet files of a folder; a new file is new data."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def read_flow_csv(spark: SparkSession, path: str, columns: list[str], files_per_trigger: int = 1) -> DataFrame:
    """Stream over dropped extractor files, one per capture window; every column is text."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.readStream.schema(schema).option("header", True).option("enforceSchema", False).option(
        "maxFilesPerTrigger", files_per_trigger).csv(path)


def start_table(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True,
                every: str = "10 seconds") -> StreamingQuery:
    """Appends to a parquet table; with ``available_now`` it ends once all present data is read."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start(path)


def start_batches(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True,
                  every: str = "10 seconds") -> StreamingQuery:
    """Hands every micro-batch to ``fn``."""
    writer = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all present data into a scratch table and returns that table."""
    spark = stream.sparkSession
    path, checkpoint = workdir.new_path(spark, name), workdir.new_path(spark, f"{name}-checkpoint")
    start_table(stream, path, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
