"""Streams over the given tables, run until all present data is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice import workdir
from sluice.operators import detection
from sluice.plans import bindings as B
from sluice.plans.detect_queries import _COOL, _COOL_SQL, EVENTS_CTE
from sluice.plans.flow_queries import _K, _TICK, _TO, FLOW, ID, KEYED, SESS, ticks_cte
from sluice.plans.registry import query
from sluice.plans.source_queries import _csv_folder
from sluice.schemas import DEPLOYMENT_CLASSES
from sluice.sources import eventlog
from sluice.streaming import decisions, flows as SF, live, runs


def _events(spark, sf):
    return runs.read_files(spark, sf, B.table(spark, sf, "events").schema, "events.parquet")


def _packets(spark, sf):
    return B.packets(spark, sf, _events(spark, sf))


def _attacks(spark, sf):
    return detection.decide_by_label(B.scored(spark, sf, _events(spark, sf)))


@query("stream_packets", f"with {B.PACKETS_CTE} select pkt_id, src_ip, dst_ip, src_port, dst_port, proto, ip_len from packets")
def _(spark, sf):
    return runs.drain(_packets(spark, sf).select("pkt_id", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "ip_len"), "packets")


_WIN_US = 1800 * 1_000_000
_MS = "(select max(ts_us) // 1000 * 1000 from keyed)"  # the watermark after all data, in whole milliseconds


@query("stream_windowed_capture", f"""with {KEYED} select {_K}, ts_us // {_WIN_US} * {_WIN_US} as window_start_us, count(*) as packets,
  sum(ip_len) as bytes, count(*) filter (tcp_flags & 2 <> 0) as syn_count from keyed group by {_K}, ts_us // {_WIN_US}
  having (ts_us // {_WIN_US} + 1) * {_WIN_US} <= {_MS}""")
def _(spark, sf):
    return runs.drain(SF.windowed(_packets(spark, sf), 1800), "windows")


@query("stream_flow_sessions", f"""with {SESS} select {_K}, min(ts_us) as first_ts, max(ts_us) as last_ts, count(*) as packets,
  sum(ip_len) as bytes, count(*) filter (tcp_flags & 2 <> 0) as syn_count from sess group by {_K}, flow_no
  having max(ts_us) + {B.FLOW_TIMEOUT_US} <= {_MS}""")
def _(spark, sf):
    return runs.drain(SF.sessions(_packets(spark, sf), B.FLOW.timeout), "sessions")


_TICK_COLS = "last_ts, fwd_n, bwd_n, fwd_bytes, bwd_bytes, fwd_iat_sum, bwd_iat_sum, fwd_win, bwd_win"


@query("stream_flow_ticks", f"""with {ticks_cte(None)}, wm as (select max(ts_us) // 1000 * 1000 as now from keyed)
  select {ID}, {_TICK_COLS}, case when was_cut then 'active' else 'idle' end as ended_by from flow, wm
  where case when was_cut then (last_ts // {_TICK} + 1) * {_TICK} else ((last_ts + {_TO}) // {_TICK} + 1) * {_TICK} end <= now""")
def _(spark, sf):
    return runs.drain(SF.tick_flows(_packets(spark, sf), B.FLOW), "tick-flows")


@query("stream_block_first", f"with {EVENTS_CTE} select event_id, src_ip, blocked from ev")
def _(spark, sf):
    return runs.drain(decisions.block_first_per_source(_attacks(spark, sf)), "blocks")


@query("stream_alert_cooldown", f"with {_COOL_SQL} select src_ip, prediction, ts_us, id from walk where alert")
def _(spark, sf):
    return runs.drain(decisions.alerts_after_cooldown(_attacks(spark, sf).where("is_attack"), _COOL), "alerts")


@query("callback_hook", f"with {EVENTS_CTE} select prediction, count(*) as n from ev where is_attack group by prediction")
def _(spark, sf):
    """A user callback that stores what it is handed."""
    path, checkpoint = workdir.new_path(spark, "callback"), workdir.new_path(spark, "callback-checkpoint")
    hook = detection.on_each_batch(lambda batch, n: batch.select("prediction").write.mode("overwrite").parquet(f"{path}/{n}"))
    runs.start_batches(_attacks(spark, sf).where("is_attack"), hook, checkpoint).awaitTermination()
    return spark.read.option("recursiveFileLookup", True).parquet(path).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


@query("stream_event_log", f"with {EVENTS_CTE} select cast(event_id as varchar) as model, src_ip, prediction from ev")
def _(spark, sf):
    """Events of a stream appended to the event log, batch by batch."""
    path, checkpoint = workdir.new_path(spark, "log"), workdir.new_path(spark, "log-checkpoint")
    rows = _attacks(spark, sf).withColumns({"timestamp": F.col("ts").cast("string"), "model": F.col("event_id")})
    runs.start_batches(rows, eventlog.batch_appender(path), checkpoint).awaitTermination()
    return eventlog.read_events(spark, path).select("model", "src_ip", "prediction")


_IS_UDP = "least(src_port, dst_port) = 53 or greatest(src_port, dst_port) = 53"


@query("stream_live_detection", f"with {FLOW} select src_ip, count(*) as events, count_if({_IS_UDP}) as attacks, "
                                f"max(case when {_IS_UDP} then 1 else 0 end)::bigint as blocked from flow group by src_ip")
def _(spark, sf):
    """Extractor files window by window through scores, decisions and first blocks into the event log."""
    def score(rows):
        udp = F.array_contains(F.array("raw.src_port", "raw.dst_port"), "53")
        return rows.withColumn("probability", F.transform(F.array(*[F.lit(c) for c in DEPLOYMENT_CLASSES]), lambda c: (
            c == F.when(udp, F.lit("UDP Flood")).otherwise(F.lit("Benign"))).cast("double")))

    csv, folder = _csv_folder(spark, sf), workdir.new_path(spark, "live")
    columns = spark.read.option("header", True).csv(csv).columns
    stream = runs.read_flow_csv(spark, csv, columns)
    runs.start_batches(stream, live.WindowDetector(folder, score), workdir.new_path(spark, "live-checkpoint")).awaitTermination()
    events = eventlog.read_events(spark, f"{folder}/events")
    return events.groupBy("src_ip").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("is_attack") == "true").alias("attacks"),
                                        F.count_if(F.col("blocked") == "true").alias("blocked"))
