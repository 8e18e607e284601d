"""Summaries of the event log.

Order is by time and event id. Bounded views (the last n events) are top-n queries, so
each task keeps n rows and only those meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sluice.functions import scalars as S
from sluice.operators.detection import confirmed
from sluice.schemas import MONITOR_THRESHOLD

ORDER = ["ts", "event_id"]
_BOOL = ["is_attack", "blocked", "simulation", "mitigation_elevated"]
_INT = ["fwd_packets", "bwd_packets", "protocol"]


def live_events(log: DataFrame) -> DataFrame:
    """Events of the live agent; a log of labelled offline runs without sources yields none."""
    if "source" in log.columns:
        return log.where(F.coalesce(F.lower("source"), F.lit("")).isin("live_ips", ""))
    return log.limit(0) if "actual_label" in log.columns else log


def coerce(log: DataFrame) -> DataFrame:
    """Text columns of the log as booleans, numbers and counts; unreadable ones are false or 0."""
    changes: dict[str, Column] = {c: S.as_bool(F.col(c)) for c in _BOOL if c in log.columns}
    if "confidence" in log.columns:
        confidence = F.col("confidence").try_cast("double")
        changes["confidence"] = F.when(F.isnan(confidence), 0.0).otherwise(F.coalesce(confidence, F.lit(0.0)))
    changes |= {c: S.truncate_int(F.col(c)) for c in _INT if c in log.columns}
    return log.withColumns(changes) if changes else log


def tail(events: DataFrame, n: int = 500, order: list[str] | None = None) -> DataFrame:
    """The last n events, newest first."""
    return events.orderBy(*[F.desc(c) for c in order or ORDER]).limit(n)


def load(log: DataFrame, n: int = 500) -> DataFrame:
    return coerce(tail(live_events(log), n))


def visible(events: DataFrame) -> DataFrame:
    return events.where(~S.noise_destination(F.col("dst_ip")))


def kpis(events: DataFrame, threshold: float = MONITOR_THRESHOLD) -> DataFrame:
    """Visible events, confirmed attacks, blocked events, and distinct blocked sources."""
    blocked = F.coalesce(F.col("blocked"), F.lit(False))
    return visible(events).agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(confirmed(threshold)).alias("attacks_detected"),
        F.count_if(blocked).alias("ips_blocked"),
        F.count_distinct(F.when(blocked, F.col("src_ip"))).alias("distinct_sources_blocked"))


def banner(events: DataFrame, threshold: float = MONITOR_THRESHOLD, recent: int = 30) -> DataFrame:
    """One row: the last confirmed attack among the recent visible events, or all clear."""
    attacks = tail(visible(events), recent).where(confirmed(threshold))
    return _last_attack(attacks)


def _last_attack(attacks: DataFrame) -> DataFrame:
    fields = ["prediction", "src_ip", "dst_ip", "confidence", "blocked"]
    last = attacks.agg(F.max(F.struct(*ORDER, *fields)).alias("e"))
    return last.select(F.when(F.col("e").isNull(), "SYSTEM NORMAL").otherwise("ATTACK DETECTED").alias("status"),
                       *[F.col(f"e.{c}").alias(c) for c in fields if c != "confidence"],
                       S.percent_text(F.col("e.confidence"), 1).alias("confidence"))


def status(threshold: float | None) -> Column:
    """BLOCKED over ATTACK over LOW CONF over OK; without a threshold every attack counts."""
    attack = F.coalesce(F.col("is_attack"), F.lit(False))
    blocked = F.coalesce(F.col("blocked"), F.lit(False))
    if threshold is None:
        return F.when(blocked, "BLOCKED").when(attack, "ATTACK").otherwise("OK")
    return F.when(blocked, "BLOCKED").when(confirmed(threshold), "ATTACK").when(attack, "LOW CONF").otherwise("OK")


def log_view(events: DataFrame, threshold: float = MONITOR_THRESHOLD, n: int = 80) -> DataFrame:
    """The last n visible events with their status, newest first."""
    return tail(visible(events), n).withColumn("status", status(threshold))


def legacy_kpis(events: DataFrame) -> DataFrame:
    """The older cards: no noise or confidence filter."""
    return events.agg(F.count(F.lit(1)).alias("total_events"),
                      F.count_if(F.coalesce(F.col("is_attack"), F.lit(False))).alias("attacks_detected"),
                      F.count_if(F.coalesce(F.col("blocked"), F.lit(False))).alias("ips_blocked"))


def legacy_banner(events: DataFrame, recent: int = 10) -> DataFrame:
    return _last_attack(tail(events, recent).where(F.coalesce(F.col("is_attack"), F.lit(False))))


def legacy_log_view(events: DataFrame, n: int = 50) -> DataFrame:
    return tail(events, n).withColumn("status", status(None))
