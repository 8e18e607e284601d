"""Detection on a stream of capture windows: extractor rows in; events, first blocks, alerts and failures out.

Each micro-batch is one window (a file; give the source one file a trigger). What a batch writes has its number, so a
batch that is run again after a failure replaces what the first try left. A window whose own rows cannot be processed is
logged and left out. Any other fault (lost executors, storage, a model that cannot be read) ends the run before the
batch is committed, and the next start takes the window again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import (AnalysisException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException,
                            IllegalArgumentException, NumberFormatException, PythonException)
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice import workdir
from sluice.operators import alerts, cleaning, detection, mitigation
from sluice.schemas import ALERT_COOLDOWN_SECONDS, ATTACK_THRESHOLD, DEPLOYMENT_CLASSES, FlowParams
from sluice.sources import eventlog, registry

Score = Callable[[DataFrame], DataFrame]

_EARLIER = -1  # stands for the event of an alert that an earlier batch has told

#: Faults that the rows of a window cause, and that would come again however often they are processed.
ROW_FAULTS = (AnalysisException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, IllegalArgumentException,
              NumberFormatException, PythonException, ValueError, TypeError, KeyError, ArithmeticError)


@dataclass
class SavedModel:
    """Scores windows by a saved model, loaded with the first of them."""

    folder: str
    name: str = "selected_model"
    _model: PipelineModel | None = field(default=None, init=False, repr=False)

    def __call__(self, rows: DataFrame) -> DataFrame:
        if self._model is None:
            self._model = registry.load_model(self.name, self.folder)
        return self._model.transform(rows).withColumn("probability", vector_to_array("probability"))


@dataclass
class WindowDetector:
    """``foreachBatch`` function. ``score`` adds the array ``probability``, in the order of ``classes``, to rows with
    the model features.

    Events that block their source raise alerts, with ``alert_on="attack"`` all attacks do. An alert silences its
    (source, attack) until the cooldown is over, over windows too: each batch leaves the alerts that still silence a
    key to the next one, a failed window those it has found.
    """

    folder: str
    score: Score
    threshold: float = ATTACK_THRESHOLD
    decision_source: str = "flow_window"
    classes: Sequence[str] = tuple(DEPLOYMENT_CLASSES)
    cooldown_seconds: float = ALERT_COOLDOWN_SECONDS
    alert_on: str = "block"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        try:
            events = workdir.materialize(self._events(batch), "window-events")
            blocked = self._first_blocks(events, batch_id)
            alerting = self._alerts(blocked.where("blocked" if self.alert_on == "block" else "is_attack"), batch_id)
        except ROW_FAULTS as error:
            row = [(batch_id, type(error).__name__, str(error)[:2000])]
            batch.sparkSession.createDataFrame(row, "batch long, error string, message string").write.mode("overwrite").json(
                self._path("failures", batch_id))
            self._write(self._silent(batch.sparkSession, batch_id), "silent", batch_id)
            return
        new = alerting.where(F.col("id") != _EARLIER)
        told = events.withColumn("message", alerts.alert_message()).join(new.select("id"), F.col("event_id") == F.col("id"))
        self._write(told.select("event_id", "ts", "src_ip", "dst_ip", "prediction", "confidence", "message"), "alerts", batch_id)
        over = F.col("ts_us") + FlowParams.micros(self.cooldown_seconds) <= F.unix_micros(F.current_timestamp())
        self._write(alerting.where(~over).select("src_ip", "prediction", "ts_us"), "silent", batch_id)
        self._write(blocked.where("blocked").select("src_ip"), "blocks", batch_id)
        eventlog.batch_appender(f"{self.folder}/events")(blocked, batch_id)

    def _path(self, kind: str, batch_id: int) -> str:
        return f"{self.folder}/{kind}/{batch_id:012d}"

    def _write(self, rows: DataFrame, kind: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(self._path(kind, batch_id))

    def _events(self, batch: DataFrame) -> DataFrame:
        rows = detection.score(self.score(cleaning.normalise_flow_rows(batch)), list(self.classes))
        rows = detection.decide_by_threshold(rows, self.threshold)
        taken = {c.lower() for c in rows.columns}  # names differ by more than case
        raw = [f for f in rows.schema["raw"].dataType.fieldNames() if f.lower() not in taken]
        flat = rows.select(*[c for c in rows.columns if c != "raw"], *[F.col("raw")[c].alias(c) for c in raw])
        fields = detection.flow_row_fields(flat)
        named = flat.select("prediction", "confidence", "is_attack", F.current_timestamp().alias("ts"), *[e.alias(n) for n, e in fields.items()])
        named = named.withColumns({"timestamp": F.col("ts").cast("string"), "event_id": F.monotonically_increasing_id(),
                                   "dst_ports": detection.single_port_text(F.col("dst_port"), F.col("fwd_packets"))})
        return detection.build_events(named, self.decision_source, keep=("ts", "event_id"))

    def _first_blocks(self, events: DataFrame, batch_id: int) -> DataFrame:
        """A source is blocked by its first qualifying event, unless an earlier batch has blocked it."""
        before = self.blocked_before(events.sparkSession, batch_id)
        blocked = mitigation.block_first_per_source(events.drop("blocked"), self.threshold)
        if before is not None:
            known = before.select(F.col("src_ip").alias("_known")).distinct()
            blocked = blocked.join(known, F.col("src_ip") == F.col("_known"), "left").withColumn(
                "blocked", F.col("blocked") & F.col("_known").isNull()).drop("_known")
        return workdir.materialize(blocked, "window-blocks")

    def _silent(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """Alerts that may still silence their key, as the batch before left them."""
        schema = "src_ip string, prediction string, ts_us long"
        if batch_id:
            try:
                return spark.read.schema(schema).parquet(self._path("silent", batch_id - 1))
            except AnalysisException:  # the folder is newer than the stream
                pass
        return spark.createDataFrame([], schema)

    def _alerts(self, worthy: DataFrame, batch_id: int) -> DataFrame:
        """Alerts of this window (``id`` of the event) and the earlier ones that came before them in their chain."""
        silent = self._silent(worthy.sparkSession, batch_id)
        earlier = silent.select("src_ip", "prediction", F.timestamp_micros("ts_us").alias("ts"), F.lit(_EARLIER).cast("long").alias("event_id"))
        found = alerts.alerts_after_cooldown(earlier.unionByName(worthy.select(*earlier.columns)), cooldown_seconds=self.cooldown_seconds)
        return workdir.materialize(found, "window-alerts")

    def blocked_before(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        try:
            found = spark.read.option("recursiveFileLookup", True).parquet(f"{self.folder}/blocks")
        except AnalysisException:
            return None
        number = F.regexp_extract(F.col("_metadata.file_path"), r"/blocks/(\d+)/", 1).cast("long")
        return found.where(number < batch_id)
