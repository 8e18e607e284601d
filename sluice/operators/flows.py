"""Packets to bidirectional flows.

A flow is all packets between two endpoints (ip, port) over one protocol, in both
directions, until it falls idle. Its forward direction is that of its first packet.

A single endpoint pair may carry a large share of all packets, so no step gathers
the packets of one pair in one task:

1. packets are shuffled by (endpoint pair, time slice) and each slice is reduced to
   segments, rows of running totals for the two directions;
2. segments, at most a few per pair and slice, are shuffled by endpoint pair, joined
   up across slice borders, and their totals added.

All totals are integers (lengths in bytes, times in microseconds, exact sums of
squares), so the result does not depend on the order of partial sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sluice.schemas import FLAG_BITS, FlowParams

KEY = ["lo_ip", "lo_port", "hi_ip", "hi_port", "proto"]
_WINDOW_RANGE = 65_536  # a TCP window is 16 bits wide
_SECOND = 1_000_000
#: Parts of a tick or window that are reduced apart, at most.
SUB_SLICES = 16

# How totals of two parts of a flow combine.
_BY_DIRECTION = {
    "n": "sum", "bytes": "sum", "len_sq": "sum", "len_max": "max", "len_min": "min",
    "hdr": "sum", "hdr_min": "min", "data": "sum", "win": "min",
    "iat_n": "sum", "iat_sum": "sum", "iat_sq": "sum", "iat_max": "max", "iat_min": "min",
}
_POOLED = {
    "idle_n": "sum", "idle_sum": "sum", "idle_sq": "sum", "idle_max": "max", "idle_min": "min",
    **{f"{flag.lower()}_count": "sum" for flag in FLAG_BITS},
}


def ip_packets(raw: DataFrame) -> DataFrame:
    """IPv4 packets only; ports, window and flags blanked where the protocol has none."""
    tcp, udp = F.col("proto") == 6, F.col("proto") == 17
    return (raw.where(F.col("ip_version") == 4).drop("ip_version")
            .withColumns({
                "src_port": F.when(tcp | udp, F.col("src_port")).otherwise(F.lit(0)),
                "dst_port": F.when(tcp | udp, F.col("dst_port")).otherwise(F.lit(0)),
                "tcp_window": F.when(tcp, F.col("tcp_window")).otherwise(F.lit(-1)),
                "tcp_flags": F.when(tcp, F.col("tcp_flags")).otherwise(F.lit(0)),
            }))


def capture_filter(packets: DataFrame, victim_ip: str) -> DataFrame:
    """Packets addressed to the protected host; a plain column test, so scans prune on it."""
    return packets.where(F.col("dst_ip") == victim_ip)


def with_endpoints(packets: DataFrame) -> DataFrame:
    """Adds the direction-free key and ``dir`` (0 when the source is the lower endpoint)."""
    marked = packets.selectExpr(
        "*", "unix_micros(ts) as ts_us",
        "case when src_ip < dst_ip or (src_ip = dst_ip and src_port <= dst_port) then 0 else 1 end as dir")
    turned = [f"case when dir = 0 then {a} else {b} end as {name}" for name, a, b in (
        ("lo_ip", "src_ip", "dst_ip"), ("lo_port", "src_port", "dst_port"),
        ("hi_ip", "dst_ip", "src_ip"), ("hi_port", "dst_port", "src_port"))]
    return marked.selectExpr("*", *turned)


def _square(c: str) -> str:
    return f"cast({c} as decimal(18,0)) * cast({c} as decimal(18,0))"


def _segment_totals() -> list[str]:
    """Totals of one slice part. ``iat`` is the time since the previous packet in it."""
    out = ["min(ts_us) as first_ts", "max(ts_us) as last_ts", "min(rn * 2 + dir) % 2 as first_dir"]
    for d in (0, 1):
        mine = f"filter (where dir = {d})"
        out += [
            f"count(*) {mine} as n_{d}",
            f"sum(cast(ip_len as bigint)) {mine} as bytes_{d}",
            f"sum(cast(ip_len as bigint) * ip_len) {mine} as len_sq_{d}",
            f"max(ip_len) {mine} as len_max_{d}",
            f"min(ip_len) {mine} as len_min_{d}",
            f"sum(cast(header_len as bigint)) {mine} as hdr_{d}",
            f"min(header_len) {mine} as hdr_min_{d}",
            f"count(*) filter (where dir = {d} and payload_len > 0) as data_{d}",
            f"min(rn * {_WINDOW_RANGE} + tcp_window) filter (where dir = {d} and tcp_window >= 0) % {_WINDOW_RANGE} as win_{d}",
            f"count(iat) {mine} as iat_n_{d}",
            f"sum(iat) {mine} as iat_sum_{d}",
            f"sum({_square('iat')}) {mine} as iat_sq_{d}",
            f"max(iat) {mine} as iat_max_{d}",
            f"min(iat) {mine} as iat_min_{d}",
        ]
    idle = f"filter (where iat >= {_SECOND})"
    out += [f"count(*) {idle} as idle_n", f"sum(iat) {idle} as idle_sum", f"sum({_square('iat')}) {idle} as idle_sq",
            f"max(iat) {idle} as idle_max", f"min(iat) {idle} as idle_min"]
    return out + [f"count_if((tcp_flags & {bit}) <> 0) as {flag.lower()}_count" for flag, bit in FLAG_BITS.items()]


def segments(packets: DataFrame, slice_us: int, gap_us: int | None) -> DataFrame:
    """One row of totals per endpoint pair, time slice and, with ``gap_us``, unbroken run in it."""
    p = with_endpoints(packets).selectExpr("*", f"ts_us div {slice_us} as slice")
    w = f"over (partition by {', '.join(KEY)}, slice order by ts_us, pkt_id)"
    p = p.selectExpr("*", f"cast(row_number() {w} as bigint) as rn", f"ts_us - lag(ts_us) {w} as since")
    if gap_us is None:
        p = p.selectExpr("*", "0 as part", "since as iat")
    else:
        p = p.selectExpr("*", f"sum(case when since > {gap_us} then 1 else 0 end) {w} as part",
                         f"case when since <= {gap_us} then since end as iat")
    return p.groupBy(*KEY, "slice", "part").agg(*map(F.expr, _segment_totals()))


def slices(packets: DataFrame, width_us: int) -> DataFrame:
    """One row of totals per endpoint pair and slice, added up from narrower slices.

    A pair that sends very much in one slice is so dealt to several tasks, and only their totals meet.
    """
    k = next(k for k in range(SUB_SLICES, 0, -1) if width_us % k == 0)
    parts = segments(packets, width_us // k, None).selectExpr("*", f"slice div {k} as flow_no")
    w = f"over (partition by {', '.join(KEY)}, flow_no order by slice)"
    parts = parts.selectExpr("*", f"cast(row_number() {w} as bigint) as seg_no", f"first_ts - lag(last_ts) {w} as bridge")
    return _merge(parts).withColumnsRenamed({"flow_no": "slice", "fdir": "first_dir"}).withColumn("part", F.lit(0))


def _combine(base: str, how: str, name: str, bridge: str | None) -> str:
    """Aggregate of one total over the segments of a flow, with the time between segments where it counts."""
    if bridge is None:
        return f"{how}({name}) as {name}"
    if base.endswith("_n"):
        return f"sum({name} + case when {bridge} is not null then 1 else 0 end) as {name}"
    if base.endswith("_sum"):
        return f"sum(coalesce({name}, 0) + coalesce({bridge}, 0)) as {name}"
    if base.endswith("_sq"):
        return f"sum(coalesce({name}, 0) + coalesce({_square(bridge)}, 0)) as {name}"
    return f"{how}({'greatest' if how == 'max' else 'least'}({name}, {bridge})) as {name}"


def _merge(parts: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Adds up segments of a flow. ``bridge`` is the time since the segment before it."""
    out = ["min(first_ts) as first_ts", "max(last_ts) as last_ts", "min(seg_no * 2 + first_dir) % 2 as fdir"]
    bridges = [f"case when first_dir = {d} then bridge end as bridge_{d}" for d in (0, 1)]
    parts = parts.selectExpr("*", *bridges, f"case when bridge >= {_SECOND} then bridge end as bridge_idle")
    for d in (0, 1):
        for base, how in _BY_DIRECTION.items():
            if base == "win":
                out.append(f"min(seg_no * {_WINDOW_RANGE} + win_{d}) % {_WINDOW_RANGE} as win_{d}")
            else:
                out.append(_combine(base, how, f"{base}_{d}", f"bridge_{d}" if base.startswith("iat_") else None))
    out += [_combine(base, how, base, "bridge_idle" if base.startswith("idle_") else None) for base, how in _POOLED.items()]
    return parts.groupBy(*KEY, "flow_no").agg(*map(F.expr, [*out, *(extra or [])]))


_ZERO_WHEN_SILENT = {"n", "bytes", "len_sq", "hdr", "data", "iat_n", "iat_sum"}


def _orient(merged: DataFrame, carry: list[str]) -> DataFrame:
    """Names the two directions forward and backward after the flow's first packet."""
    def turn(a: str, b: str) -> str:
        return f"case when fdir = 0 then {a} else {b} end"

    cols = [f"{turn('lo_ip', 'hi_ip')} as src_ip", f"{turn('hi_ip', 'lo_ip')} as dst_ip",
            f"{turn('lo_port', 'hi_port')} as src_port", f"{turn('hi_port', 'lo_port')} as dst_port",
            "proto", "first_ts", "last_ts"]
    for base in _BY_DIRECTION:
        for side, (a, b) in {"fwd": (0, 1), "bwd": (1, 0)}.items():
            value = turn(f"{base}_{a}", f"{base}_{b}")
            cols.append(f"coalesce({value}, 0) as {side}_{base}" if base in _ZERO_WHEN_SILENT else f"{value} as {side}_{base}")
    pooled = [f"coalesce({c}, 0) as {c}" if c == "idle_sum" else c for c in _POOLED]
    return merged.selectExpr(*cols, *pooled, *carry)


def aggregate_flows(packets: DataFrame, params: FlowParams = FlowParams(), as_of_us: int | None = None) -> DataFrame:
    """One row per flow, a flow ending when idle for more than ``timeout``.

    With ``as_of_us`` flows that are not yet idle at that time stay out, as a live
    capture that stops would leave them.
    """
    gap_us = params.micros(params.timeout)
    segs = segments(packets, params.micros(params.slice_seconds), gap_us)
    w = f"over (partition by {', '.join(KEY)} order by slice, part)"
    segs = segs.selectExpr("*", f"cast(row_number() {w} as bigint) as seg_no", f"first_ts - lag(last_ts) {w} as since")
    segs = segs.selectExpr("*", f"case when since <= {gap_us} then since end as bridge",
                           f"sum(case when since <= {gap_us} then 0 else 1 end) {w} as flow_no")
    flows = _orient(_merge(segs), [])
    if as_of_us is not None:
        flows = flows.where(F.lit(as_of_us) - F.col("last_ts") > gap_us)
    return flows


@dataclass
class FlowClock:
    """Decides, one tick of one endpoint pair at a time, where a flow ends.

    Flows are looked at only when a tick ends: one ends if it has been idle longer
    than the timeout, or if it is both long and large enough.
    """

    params: FlowParams
    flow_no: int = 0
    seg_no: int = 0
    start: int = 0
    last: int = 0
    packets: int = 0
    is_open: bool = False

    def begins_flow(self, tick_start: int) -> bool:
        """Whether packets of a tick that starts then belong to a new flow."""
        return not self.is_open or tick_start - self.last > FlowParams.micros(self.params.timeout)

    def is_large(self) -> bool:
        return (self.last - self.start >= FlowParams.micros(self.params.min_duration)
                and self.packets >= self.params.min_packets)

    def advance(self, tick_start: int, first: int, last: int, n: int) -> tuple[bool, bool]:
        """Takes in the packets of one tick. Returns (a new flow began, the flow was cut)."""
        began = self.begins_flow(tick_start)
        if began:
            self.flow_no += 1
            self.start, self.packets, self.is_open = first, 0, True
        self.seg_no += 1
        self.last = last
        self.packets += n
        cut = self.is_large()
        if cut:
            self.is_open = False
        return began, cut


def _tick_flows(params: FlowParams):
    tick_us = params.micros(params.tick)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, clock = None, FlowClock(params)
        for pdf in batches:
            if pdf.empty:
                continue
            first, last = pdf["first_ts"].to_numpy(), pdf["last_ts"].to_numpy()
            ticks, n = pdf["slice"].to_numpy(), (pdf["n_0"] + pdf["n_1"]).to_numpy()
            # Pairs with one tick, whole in this batch, are settled together; only the others are followed.
            flow_no, seg_no = np.ones(len(pdf), np.int64), np.ones(len(pdf), np.int64)
            bridge = pd.array([None] * len(pdf), dtype="Int64")
            cuts = (last - first >= params.micros(params.min_duration)) & (n >= params.min_packets)
            for i in np.flatnonzero(~_alone(pdf)):
                k = tuple(pdf[c].iat[i] for c in KEY)
                if k != key:
                    key, clock = k, FlowClock(params)
                before = clock.last
                began, cuts[i] = clock.advance(int(ticks[i]) * tick_us, int(first[i]), int(last[i]), int(n[i]))
                flow_no[i], seg_no[i] = clock.flow_no, clock.seg_no
                if not began:
                    bridge[i] = int(first[i]) - before
            yield pdf.assign(flow_no=flow_no, seg_no=seg_no, bridge=bridge, cut=cuts)

    return assign


def _alone(pdf: pd.DataFrame) -> np.ndarray:
    """Rows that are all their pair has; the first and the last pair of a batch may have more in its neighbours."""
    change = np.zeros(len(pdf) + 1, dtype=bool)
    for c in KEY:
        v = pdf[c].to_numpy()
        change[1:-1] |= v[1:] != v[:-1]
    return change[:-1] & change[1:]


def aggregate_flows_on_ticks(packets: DataFrame, params: FlowParams = FlowParams(),
                             as_of_us: int | None = None) -> DataFrame:
    """Flows as a periodic check ends them: idle or long-and-large, seen at ticks only.

    Column ``ended_by`` is ``active`` or ``idle``. Packets are first reduced to one row
    per endpoint pair and tick; only those rows are walked through in time order.
    """
    tick_us = params.micros(params.tick)
    if as_of_us is not None:
        packets = packets.where(F.unix_micros("ts") <= as_of_us)
    segs = slices(packets, tick_us)
    schema = T.StructType(segs.schema.fields + [
        T.StructField("flow_no", T.LongType()), T.StructField("seg_no", T.LongType()),
        T.StructField("bridge", T.LongType()), T.StructField("cut", T.BooleanType())])
    walked = (segs.repartition(*[F.col(k) for k in KEY]).sortWithinPartitions(*KEY, "slice")
              .mapInPandas(_tick_flows(params), schema))
    merged = _merge(walked, ["max(cut) as was_cut"])
    flows = _orient(merged, ["was_cut"])
    if as_of_us is not None:
        last_tick = as_of_us // tick_us * tick_us
        idle = F.lit(last_tick) - F.col("last_ts") > params.micros(params.timeout)
        tick_done = F.expr(f"(last_ts div {tick_us} + 1) * {tick_us}") <= as_of_us
        flows = flows.where(idle | (F.col("was_cut") & tick_done))
    return flows.withColumn("ended_by", F.when(F.col("was_cut"), "active").otherwise("idle")).drop("was_cut")


def window_flows(packets: DataFrame, window_seconds: float = 10.0) -> DataFrame:
    """Flows of fixed capture windows: every window starts afresh."""
    width = FlowParams.micros(window_seconds)
    whole = slices(packets, width).withColumnRenamed("first_dir", "fdir").withColumn("window_start_us", F.col("slice") * width)
    return _orient(whole, ["window_start_us"])


def destination_ports(flows: DataFrame) -> DataFrame:
    """(flow, port, packets): every packet counts its own destination port, port 0 aside.

    Packets of one flow have just two destination ports, one per direction.
    """
    ports = F.array(
        F.struct(F.col("dst_port").alias("port"), F.col("fwd_n").alias("packets"), F.lit(0).alias("seen")),
        F.struct(F.col("src_port").alias("port"), F.col("bwd_n").alias("packets"), F.lit(1).alias("seen")))
    ident = ["src_ip", "dst_ip", "src_port", "dst_port", "proto", "first_ts"]
    one = flows.select(*ident, F.explode(ports).alias("p")).select(*ident, "p.*")
    return one.where((F.col("port") != 0) & (F.col("packets") > 0)).groupBy(*ident, "port").agg(
        F.sum("packets").alias("packets"))


def top_ports_text() -> Column:
    """``port:count`` of the busiest destination ports joined by ``;``, ties in order of appearance."""
    fwd = F.struct((-F.col("fwd_n")).alias("rank"), F.lit(0).alias("seen"), F.col("dst_port").alias("port"))
    bwd = F.struct((-F.col("bwd_n")).alias("rank"), F.lit(1).alias("seen"), F.col("src_port").alias("port"))
    both = F.struct((-F.col("fwd_n") - F.col("bwd_n")).alias("rank"), F.lit(0).alias("seen"),
                    F.col("dst_port").alias("port"))
    entries = F.when(F.col("src_port") == F.col("dst_port"), F.array(both)).otherwise(F.array(fwd, bwd))
    used = F.filter(entries, lambda e: (e["port"] != 0) & (e["rank"] < 0))
    return F.array_join(
        F.transform(F.array_sort(used), lambda e: F.concat_ws(":", e["port"], -e["rank"])), ";")
