"""From class probabilities to detection events."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sluice.functions import scalars as S
from sluice.operators.labels import class_name
from sluice.schemas import ATTACK_THRESHOLD, DEPLOYMENT_CLASSES, EVENT_FIELDS

BENIGN = "Benign"

# Where an event field is found in extractor rows, first match wins.
FLOW_ROW_FIELDS = {
    "src_ip": ["Src IP", "Source IP", "src_ip", "SourceIP"],
    "dst_ip": ["Dst IP", "Destination IP", "dst_ip", "DestinationIP"],
    "protocol": ["Protocol", "protocol"],
    "src_port": ["Src Port", "Source Port", "src_port"],
    "dst_port": ["Dst Port", "Destination Port", "dst_port"],
    "fwd_packets": ["Total Fwd Packets", "Tot Fwd Pkts", "tot_fwd_pkts"],
    "bwd_packets": ["Total Backward Packets", "Tot Bwd Pkts", "tot_bwd_pkts"],
}


def best_class(probability: Column) -> Column:
    """Index of the largest probability, the first among equals."""
    return (F.array_position(probability, F.array_max(probability)) - 1).cast("int")


def score(df: DataFrame, classes: Sequence[str] = DEPLOYMENT_CLASSES, probability: str = "probability") -> DataFrame:
    """Adds ``class_index``, ``prediction`` and ``confidence``."""
    p = F.col(probability)
    return df.withColumns({"class_index": best_class(p), "prediction": class_name(best_class(p), list(classes)),
                           "confidence": F.array_max(p)})


def top_classes(probability: Column, classes: Sequence[str], k: int = 3) -> Column:
    """The k most probable classes as (class, probability), ties in class order."""
    entries = F.transform(probability, lambda p, i: F.struct((-p).alias("r"), i.alias("i")))
    names = F.array(*[F.lit(c) for c in classes])
    return F.transform(F.slice(F.array_sort(entries), 1, k), lambda e: F.struct(
        F.coalesce(F.get(names, e["i"]), F.concat(F.lit("Class "), e["i"].cast("string"))).alias("class"),
        (-e["r"]).alias("probability")))


def decide_by_threshold(df: DataFrame, threshold: float = ATTACK_THRESHOLD) -> DataFrame:
    """Attack only from the threshold on; below it the row shows as benign, confidence unchanged."""
    attack = (F.col("prediction") != BENIGN) & (F.col("confidence") >= threshold)
    return df.withColumns({"is_attack": attack, "prediction": F.when(attack, F.col("prediction")).otherwise(BENIGN)})


def decide_by_label(df: DataFrame) -> DataFrame:
    """Attack whenever the class is not benign; the threshold then only gates blocking."""
    return df.withColumn("is_attack", F.col("prediction") != BENIGN)


def flow_row_fields(df: DataFrame) -> dict[str, Column]:
    """Event identity from extractor rows, whichever header style they use."""
    out: dict[str, Column] = {}
    for field, names in FLOW_ROW_FIELDS.items():
        if field.endswith("_ip"):
            out[field] = S.first_value(df, names, "")
        else:
            out[field] = S.truncate_int(S.first_value(df, names, "0"))
    return out


def single_port_text(dst_port: Column, fwd_packets: Column) -> Column:
    return F.when(dst_port != 0, F.concat_ws(":", dst_port, fwd_packets)).otherwise(F.lit(""))


def build_events(df: DataFrame, decision_source: str, model: str = "selected_model", interface: str | None = None,
                 simulation: bool = True, victim_os: str = "", backend: str = "", elevated: bool = False,
                 keep: Sequence[str] = ()) -> DataFrame:
    """The 23 event fields in order, nothing blocked yet. ``keep`` adds ordering columns in front."""
    fixed = {
        "decision_source": F.lit(decision_source), "blocked": F.lit(False), "simulation": F.lit(simulation),
        "model": F.lit(model), "interface": F.lit(interface or "auto"), "victim_os": F.lit(victim_os),
        "mitigation_backend": F.lit(backend), "mitigation_elevated": F.lit(elevated),
        "block_command": F.lit(""), "block_message": F.lit(""), "source": F.lit("live_ips"),
    }
    return df.select(*keep, *[fixed[f].alias(f) if f in fixed else F.col(f) for f in EVENT_FIELDS])


def for_victim(events: DataFrame, victim_ip: str) -> DataFrame:
    return events.where(F.col("dst_ip") == victim_ip)


def confirmed(threshold: float) -> Column:
    """Attack with enough confidence that is not aimed at a broadcast or multicast address."""
    return (F.coalesce(F.col("is_attack"), F.lit(False)) & ~S.noise_destination(F.col("dst_ip"))
            & (F.coalesce(F.col("confidence"), F.lit(0.0)) >= threshold))


def on_each_batch(callback: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A user callback as ``foreachBatch`` function: it gets each batch of new events and its number.

    A batch that is run again after a failure comes with the same number, so that a callback which stores it can
    replace what the first try left.
    """
    return lambda batch, batch_id: callback(batch, batch_id)
