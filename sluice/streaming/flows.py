"""Flows over an unbounded packet stream.

Time is event time. The watermark delay says how late packets may come; windows and
sessions are given out once the watermark has passed their end.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sluice.functions.scalars import has_flag
from sluice.operators.flows import KEY, FlowClock, with_endpoints
from sluice.schemas import FLAG_BITS, FlowParams


def _totals() -> list:
    return [F.count(F.lit(1)).alias("packets"), F.sum(F.col("ip_len").cast("long")).alias("bytes"),
            F.count(F.when(has_flag(F.col("tcp_flags"), FLAG_BITS["SYN"]), 1)).alias("syn_count"),
            F.min("ts_us").alias("first_ts"), F.max("ts_us").alias("last_ts")]


def windowed(packets: DataFrame, seconds: float, delay: str = "0 seconds") -> DataFrame:
    """Totals per endpoint pair and fixed capture window."""
    p = with_endpoints(packets).withWatermark("ts", delay)
    return (p.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), *KEY).agg(*_totals())
            .select(F.unix_micros(F.col("w.start")).alias("window_start_us"), *KEY, "packets", "bytes", "syn_count"))


def sessions(packets: DataFrame, timeout_seconds: float, delay: str = "0 seconds") -> DataFrame:
    """Totals per endpoint pair and session, a session ending when idle for the timeout."""
    # Sessions of a pair are merged before the shuffle, so a pair with very many packets sends few rows.
    packets.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    p = with_endpoints(packets).withWatermark("ts", delay)
    return (p.groupBy(F.session_window("ts", f"{timeout_seconds} seconds").alias("w"), *KEY).agg(*_totals())
            .select(*KEY, "first_ts", "last_ts", "packets", "bytes", "syn_count"))


@dataclass
class RunningFlow:
    """Totals of the open flow of one endpoint pair; fixed size however many packets it has."""

    fdir: int = 0
    tick: int = 0
    n: list[int] = field(default_factory=lambda: [0, 0])
    size: list[int] = field(default_factory=lambda: [0, 0])
    iat_sum: list[int] = field(default_factory=lambda: [0, 0])
    win: list[int] = field(default_factory=lambda: [-1, -1])
    start: int = 0
    last: int = 0
    is_open: bool = False


OUTPUT = ("src_ip string, dst_ip string, src_port int, dst_port int, proto int, first_ts long, last_ts long, fwd_n long, "
          "bwd_n long, fwd_bytes long, bwd_bytes long, fwd_iat_sum long, bwd_iat_sum long, fwd_win long, bwd_win long, "
          "ended_by string")


class FlowTracker:
    """The stateful step: the tick rules of the batch operator, packet by packet."""

    def __init__(self, params: FlowParams):
        self.params = params
        self.tick_us = params.micros(params.tick)

    def __call__(self, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flow = RunningFlow(**json.loads(state.get[0])) if state.exists else RunningFlow()
        out: list[tuple] = []
        if state.hasTimedOut:
            self._close(key, flow, state.getCurrentWatermarkMs() * 1000, out)
        else:
            packets = pd.concat(list(batches)).sort_values(["ts_us", "pkt_id"])
            for row in packets[["ts_us", "dir", "ip_len", "tcp_window"]].itertuples(index=False):
                self._add(key, flow, *map(int, row), out)
        if flow.is_open:
            state.update((json.dumps(asdict(flow)),))
            # The watermark has to pass the timer, so it is set just before the check is due.
            state.setTimeoutTimestamp(max(self._due(flow) // 1000 - 1, state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")]).astype(
                {"fwd_win": "Int64", "bwd_win": "Int64"})

    def _clock(self, flow: RunningFlow) -> FlowClock:
        return FlowClock(self.params, start=flow.start, last=flow.last, packets=sum(flow.n), is_open=flow.is_open)

    def _due(self, flow: RunningFlow) -> int:
        """The next tick at which the flow may end."""
        if self._clock(flow).is_large():
            return (flow.tick + 1) * self.tick_us
        return ((flow.last + self.params.micros(self.params.timeout)) // self.tick_us + 1) * self.tick_us

    def _close(self, key: tuple, flow: RunningFlow, now: int, out: list[tuple]) -> None:
        if flow.is_open and now >= self._due(flow) - 1000:
            self._emit(key, flow, "active" if self._clock(flow).is_large() else "idle", out)

    def _add(self, key: tuple, flow: RunningFlow, ts: int, direction: int, size: int, window: int, out: list[tuple]) -> None:
        ts = max(ts, flow.last) if flow.is_open else ts
        tick = ts // self.tick_us
        clock = self._clock(flow)
        if flow.is_open and tick > flow.tick:
            if clock.is_large():
                self._emit(key, flow, "active", out)
            elif clock.begins_flow(tick * self.tick_us):
                self._emit(key, flow, "idle", out)
        if not flow.is_open:
            flow.__dict__.update(asdict(RunningFlow(fdir=direction, start=ts, last=ts, is_open=True)))
        flow.iat_sum[direction] += ts - flow.last
        flow.n[direction] += 1
        flow.size[direction] += size
        if flow.win[direction] < 0 <= window:
            flow.win[direction] = window
        flow.last, flow.tick = ts, tick

    def _emit(self, key: tuple, flow: RunningFlow, ended_by: str, out: list[tuple]) -> None:
        lo_ip, lo_port, hi_ip, hi_port, proto = key
        ends = [(lo_ip, lo_port), (hi_ip, hi_port)]
        f, b = flow.fdir, 1 - flow.fdir
        win = [w if w >= 0 else None for w in flow.win]
        out.append((ends[f][0], ends[b][0], ends[f][1], ends[b][1], proto, flow.start, flow.last, flow.n[f], flow.n[b],
                    flow.size[f], flow.size[b], flow.iat_sum[f], flow.iat_sum[b], win[f], win[b], ended_by))
        flow.is_open = False


def tick_flows(packets: DataFrame, params: FlowParams = FlowParams(), delay: str = "0 seconds") -> DataFrame:
    """Flows ended at ticks, idle or long-and-large. Flows still open stay in the state."""
    p = with_endpoints(packets).withWatermark("ts", delay)
    p = p.select(*KEY, "ts", "ts_us", "pkt_id", "dir", "ip_len", "tcp_window")
    return p.groupBy(*KEY).applyInPandasWithState(
        FlowTracker(params), OUTPUT, "flow string", "append", GroupStateTimeout.EventTimeTimeout)
