"""The event log: CSV with a fixed header. Readers accept the older 19-column form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sluice.schemas import EVENT_FIELDS

_TEXT_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in EVENT_FIELDS])


def _reader(spark: SparkSession):
    """Batches of a stream are folders inside the log, not partitions of it."""
    return spark.read.option("header", True).option("recursiveFileLookup", True)


def _header(spark: SparkSession, path: str) -> list[str] | None:
    try:
        return _reader(spark).csv(path).columns
    except AnalysisException:
        return None


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Log rows as text in field order; a missing or empty log gives no rows.

    ``ts`` and ``event_id`` order them: the event time, then a hash of the row.
    """
    header = _header(spark, path)
    if not header:
        rows = spark.createDataFrame([], _TEXT_SCHEMA)
    else:
        raw = _reader(spark).option("mode", "PERMISSIVE").csv(path)
        extra = [c for c in ("actual_label",) if c in raw.columns]
        rows = raw.select(*[F.col(f) if f in header else F.lit(None).cast("string").alias(f)
                            for f in EVENT_FIELDS if f != "source" or "source" in header], *extra)
    return rows.withColumns({"ts": F.col("timestamp").try_cast("timestamp"),
                             "event_id": F.xxhash64(*[F.col(c) for c in rows.columns])})


def _fields(events: DataFrame) -> list:
    return [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in events.columns else F.lit("").alias(f)
            for f in EVENT_FIELDS]


def append_events(events: DataFrame, path: str) -> None:
    """Adds events in field order, absent values as empty text."""
    _write(events, path, "append")


def _write(events: DataFrame, path: str, mode: str) -> None:
    events.select(*_fields(events)).write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def reset_log(spark: SparkSession, path: str) -> None:
    """An empty log: header only."""
    spark.createDataFrame([], _TEXT_SCHEMA).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def ensure_log(spark: SparkSession, path: str) -> bool:
    """Keeps the log if its header is the current one, else starts an empty one. True if kept."""
    if _header(spark, path) == EVENT_FIELDS:
        return True
    reset_log(spark, path)
    return False


def batch_appender(path: str, callback: Callable[[DataFrame, int], None] | None = None,
                   stream: str = "stream") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that adds each batch of events to the log and hands it to a callback.

    A batch has its own folder, named by stream and number; a batch that is run again replaces it. Streams with
    checkpoints of their own need names of their own.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        _write(batch, f"{path}/{stream}-{batch_id:012d}", "overwrite")
        if callback is not None:
            callback(batch, batch_id)

    return run


def snapshot_batch(features: DataFrame, raw: DataFrame, folder: str) -> None:
    """Overwrites the latest normalised features and the latest raw rows."""
    features.write.mode("overwrite").parquet(f"{folder}/last_features")
    raw.write.mode("overwrite").parquet(f"{folder}/last_raw")


def write_metric_table(table: DataFrame, folder: str, name: str) -> str:
    """One small CSV table."""
    path = f"{folder}/{name}"
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path
