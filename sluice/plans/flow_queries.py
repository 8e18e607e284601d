"""Packets to flows to features."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions.scalars import has_flag
from sluice.operators import features as FE, flows as FL
from sluice.plans import bindings as B
from sluice.plans.registry import query
from sluice.schemas import FEATURES, FLAG_BITS

_T = B.FLOW_TIMEOUT_US
_K = "lo_ip, lo_port, hi_ip, hi_port, proto"

KEYED = B.PACKETS_CTE + """,
keyed as (select *, epoch_us(ts) as ts_us, low as src_low,
  case when low then src_ip else dst_ip end as lo_ip, case when low then src_port else dst_port end as lo_port,
  case when low then dst_ip else src_ip end as hi_ip, case when low then dst_port else src_port end as hi_port
  from (select *, src_ip < dst_ip or (src_ip = dst_ip and src_port <= dst_port) as low from packets) x)"""


def _sessions(name: str, gap_start: str, partition: str) -> str:
    """Packets with flow number, direction and time since the previous packet of the flow."""
    return f""",
{name}_1 as (select *, ts_us - lag(ts_us) over (partition by {partition} order by ts_us, pkt_id) as since from keyed),
{name}_2 as (select *, case when {gap_start} then 1 else 0 end as starts from {name}_1),
{name}_3 as (select *, sum(starts) over (partition by {partition} order by ts_us, pkt_id) as flow_no from {name}_2),
{name} as (select *, case when starts = 0 then since end as iat, src_ip = f_src_ip and src_port = f_src_port as fwd
  from (select *, first_value(src_ip) over g as f_src_ip, first_value(dst_ip) over g as f_dst_ip,
        first_value(src_port) over g as f_src_port, first_value(dst_port) over g as f_dst_port
        from {name}_3 window g as (partition by {partition}, flow_no order by ts_us, pkt_id)) y)"""


SESS = KEYED + _sessions("sess", f"since is null or since > {_T}", _K)


def _side(side: str, cond: str) -> str:
    return f"""
 count(*) filter ({cond}) as {side}_n, coalesce(sum(ip_len) filter ({cond}), 0) as {side}_bytes,
 coalesce(sum(cast(ip_len as bigint) * ip_len) filter ({cond}), 0) as {side}_len_sq,
 max(ip_len) filter ({cond}) as {side}_len_max, min(ip_len) filter ({cond}) as {side}_len_min,
 coalesce(sum(header_len) filter ({cond}), 0) as {side}_hdr, min(header_len) filter ({cond}) as {side}_hdr_min,
 count(*) filter ({cond} and payload_len > 0) as {side}_data,
 arg_min(tcp_window, ts_us::hugeint * 1000000000 + pkt_id) filter ({cond} and tcp_window >= 0) as {side}_win,
 count(iat) filter ({cond}) as {side}_iat_n, coalesce(sum(iat) filter ({cond}), 0) as {side}_iat_sum,
 sum(cast(iat as hugeint) * iat) filter ({cond}) as {side}_iat_sq,
 max(iat) filter ({cond}) as {side}_iat_max, min(iat) filter ({cond}) as {side}_iat_min"""


def flow_cte(sess: str = "sess", partition: str = _K, extra: str = "") -> str:
    flags = ", ".join(f"count(*) filter (tcp_flags & {b} <> 0) as {f.lower()}_count" for f, b in FLAG_BITS.items())
    return f""",
flow as (select min(f_src_ip) as src_ip, min(f_dst_ip) as dst_ip, min(f_src_port) as src_port,
 min(f_dst_port) as dst_port, min(proto) as proto, min(ts_us) as first_ts, max(ts_us) as last_ts,
 {_side('fwd', 'fwd')}, {_side('bwd', 'not fwd')},
 count(*) filter (iat >= 1000000) as idle_n, coalesce(sum(iat) filter (iat >= 1000000), 0) as idle_sum,
 sum(cast(iat as hugeint) * iat) filter (iat >= 1000000) as idle_sq,
 max(iat) filter (iat >= 1000000) as idle_max, min(iat) filter (iat >= 1000000) as idle_min, {flags} {extra}
 from {sess} group by {partition}, flow_no)"""


FLOW = SESS + flow_cte()

# ---- the 77 features in SQL ----


def _d(e: str) -> str:
    return f"cast({e} as double)"


def _var(n: str, s: str, q: str) -> str:
    return (f"(case when {n} > 1 then cast(cast(({n})::hugeint * ({q}) - ({s})::hugeint * ({s}) as varchar) as double)"
            f" / ({_d(n)} * {_d(n)}) else 0.0::double end)")


def _mean(s: str, n: str) -> str:
    return f"(case when {n} = 0 then 0.0::double else {_d(s)} / {_d(n)} end)"


def _spread_sql(name, n, s, q, hi, lo):
    return {f"{name} Mean": _mean(s, n), f"{name} Std": f"sqrt({_var(n, s, q)})",
            f"{name} Max": _d(f"coalesce({hi}, 0)"), f"{name} Min": _d(f"coalesce({lo}, 0)")}


def feature_sql() -> dict[str, str]:
    dur = _d("greatest(last_ts - first_ts, 1)")
    total, n = "(fwd_bytes + bwd_bytes)", "(fwd_n + bwd_n)"
    na = "(greatest(fwd_n, 1) + greatest(bwd_n, 1))"
    sq = "(fwd_len_sq + bwd_len_sq)"
    f: dict[str, str] = {"Protocol": _d("proto"), "Flow Duration": dur}
    f["Total Fwd Packets"] = f["Subflow Fwd Packets"] = _d("fwd_n")
    f["Total Backward Packets"] = f["Subflow Bwd Packets"] = _d("bwd_n")
    f["Fwd Packets Length Total"] = f["Subflow Fwd Bytes"] = _d("fwd_bytes")
    f["Bwd Packets Length Total"] = f["Subflow Bwd Bytes"] = _d("bwd_bytes")
    for nm, s in (("Fwd", "fwd"), ("Bwd", "bwd")):
        f |= _spread_sql(f"{nm} Packet Length", f"{s}_n", f"{s}_bytes", f"{s}_len_sq", f"{s}_len_max", f"{s}_len_min")
        f[f"Avg {nm} Segment Size"] = _mean(f"{s}_bytes", f"{s}_n")
        f[f"{nm} IAT Total"] = _d(f"{s}_iat_sum")
        f |= _spread_sql(f"{nm} IAT", f"{s}_iat_n", f"{s}_iat_sum", f"coalesce({s}_iat_sq, 0)", f"{s}_iat_max", f"{s}_iat_min")
        f[f"{nm} Packets/s"] = f"{_d(s + '_n')} / {dur} * 1e6"
        f[f"{nm} Header Length"] = _d(f"{s}_hdr")
        f[f"Init {nm} Win Bytes"] = _d(f"coalesce({s}_win, 0)")
    f |= _spread_sql("Flow IAT", "(fwd_iat_n + bwd_iat_n)", "(fwd_iat_sum + bwd_iat_sum)",
                     "(coalesce(fwd_iat_sq, 0) + coalesce(bwd_iat_sq, 0))",
                     "greatest(fwd_iat_max, bwd_iat_max)", "least(fwd_iat_min, bwd_iat_min)")
    f |= _spread_sql("Idle", "idle_n", "idle_sum", "coalesce(idle_sq, 0)", "idle_max", "idle_min")
    f["Flow Bytes/s"], f["Flow Packets/s"] = f"{_d(total)} / {dur} * 1e6", f"{_d(n)} / {dur} * 1e6"
    f["Packet Length Min"] = _d("case when fwd_n = 0 or bwd_n = 0 then 0 else least(fwd_len_min, bwd_len_min) end")
    f["Packet Length Max"] = _d("coalesce(greatest(fwd_len_max, bwd_len_max), 0)")
    f["Packet Length Mean"] = _mean(total, na)
    f["Packet Length Variance"] = _var(na, total, sq)
    f["Packet Length Std"] = f"sqrt({_var(na, total, sq)})"
    for flag in FLAG_BITS:
        f[f"{flag} Flag Count"] = _d(f"{flag.lower()}_count")
    f["Fwd PSH Flags"] = _d("case when psh_count > 0 then 1 else 0 end")
    f["Fwd URG Flags"] = _d("case when urg_count > 0 then 1 else 0 end")
    f["Down/Up Ratio"] = _mean("bwd_n", "fwd_n")
    f["Avg Packet Size"] = f"{_d(total)} / {_d(f'greatest({n}, 1)')}"
    f["Fwd Act Data Packets"] = _d("fwd_data")
    f["Fwd Seg Size Min"] = _d("coalesce(fwd_hdr_min, 0)")
    f["Active Mean"] = f["Active Max"] = f["Active Min"] = dur
    return {name: f.get(name, "0.0::double") for name in FEATURES}


FSQL = feature_sql()
ID = "src_ip, dst_ip, src_port, dst_port, proto, first_ts"
_ID = ID.split(", ")


def feature_select(names=FEATURES) -> str:
    return ", ".join(f'{FSQL[n]} as "{n}"' for n in names)


def _flows(spark, sf):
    return FL.aggregate_flows(B.packets(spark, sf), B.FLOW)


def _flow_columns(name: str, cols: list[str]) -> None:
    @query(name, f"with {FLOW} select {ID}, {', '.join(cols)} from flow")
    def _(spark, sf):
        return _flows(spark, sf).select(*_ID, *cols)


@query("ip_packet_filter", f"""with {B.PACKETS_CTE}, raw as (select pkt_id, src_ip, dst_ip,
  case when pkt_id % 7 = 0 then 6 else 4 end as ip_version, case when pkt_id % 9 = 0 then 1 else proto end as proto,
  src_port, dst_port, tcp_window, tcp_flags from packets)
  select pkt_id, src_ip, dst_ip, proto, case when proto in (6, 17) then src_port else 0 end as src_port,
  case when proto in (6, 17) then dst_port else 0 end as dst_port,
  case when proto = 6 then tcp_window else -1 end as tcp_window, case when proto = 6 then tcp_flags else 0 end as tcp_flags
  from raw where ip_version = 4""")
def _(spark, sf):
    raw = B.packets(spark, sf).withColumns({
        "ip_version": F.when(F.col("pkt_id") % 7 == 0, 6).otherwise(4),
        "proto": F.when(F.col("pkt_id") % 9 == 0, 1).otherwise(F.col("proto"))})
    return FL.ip_packets(raw).select("pkt_id", "src_ip", "dst_ip", "proto", "src_port", "dst_port",
                                     "tcp_window", "tcp_flags")


@query("capture_victim_filter", f"with {B.PACKETS_CTE} select pkt_id, src_ip, dst_ip, ip_len from packets "
                                "where dst_ip = '192.168.56.101'")
def _(spark, sf):
    return FL.capture_filter(B.packets(spark, sf), "192.168.56.101").select("pkt_id", "src_ip", "dst_ip", "ip_len")


@query("protocol_flag_bits", f"with {B.PACKETS_CTE} select pkt_id, " + ", ".join(
    f"tcp_flags & {b} <> 0 as {f.lower()}" for f, b in FLAG_BITS.items()) + " from packets")
def _(spark, sf):
    return B.packets(spark, sf).select("pkt_id", *[
        has_flag(F.col("tcp_flags"), b).alias(f.lower()) for f, b in FLAG_BITS.items()])


@query("flow_key_canonical", f"with {KEYED} select pkt_id, lo_ip, lo_port, hi_ip, hi_port, proto, "
                             "case when src_low then 0 else 1 end as dir from keyed")
def _(spark, sf):
    return FL.with_endpoints(B.packets(spark, sf)).select("pkt_id", *FL.KEY, "dir")


@query("flow_sessionize", f"with {FLOW} select {ID}, last_ts, fwd_n + bwd_n as packets from flow")
def _(spark, sf):
    return _flows(spark, sf).select(*_ID, "last_ts", (F.col("fwd_n") + F.col("bwd_n")).alias("packets"))


_flow_columns("flow_counts", ["fwd_n", "bwd_n", "fwd_bytes", "bwd_bytes"])
_flow_columns("flow_iat", [f"{s}_iat_{k}" for s in ("fwd", "bwd") for k in ("n", "sum", "max", "min")])
_flow_columns("flow_header_bytes", ["fwd_hdr", "bwd_hdr", "fwd_hdr_min"])
_flow_columns("flow_payload_packets", ["fwd_data"])
_flow_columns("flow_init_window", ["fwd_win", "bwd_win"])
_flow_columns("flow_flag_counts", [f"{f.lower()}_count" for f in FLAG_BITS])

_AGG = ["last_ts"] + [f"{s}_{k}" for s in ("fwd", "bwd") for k in (
    "n", "bytes", "len_sq", "len_max", "len_min", "hdr", "hdr_min", "data", "win", "iat_n", "iat_sum", "iat_max",
    "iat_min")] + ["idle_n", "idle_sum", "idle_max", "idle_min"] + [f"{f.lower()}_count" for f in FLAG_BITS]
_flow_columns("flow_aggregate", _AGG)

_PORTS = """, ports as (select lo_ip, lo_port, hi_ip, hi_port, proto, flow_no, min(f_src_ip) as src_ip,
 min(f_dst_ip) as dst_ip, min(f_src_port) as src_port, min(f_dst_port) as dst_port_of_flow, dst_port as port,
 count(*) as packets, min(ts_us::hugeint * 1000000000 + pkt_id) as seen from sess where dst_port <> 0
 group by lo_ip, lo_port, hi_ip, hi_port, proto, flow_no, dst_port)"""
_STARTS = ", starts_at as (select lo_ip, lo_port, hi_ip, hi_port, proto, flow_no, min(ts_us) as first_ts from sess group by all)"


@query("flow_dst_ports", f"with {SESS} {_PORTS} {_STARTS} select src_ip, dst_ip, src_port, dst_port_of_flow as dst_port, "
                         "proto, first_ts, port, packets from ports join starts_at using "
                         "(lo_ip, lo_port, hi_ip, hi_port, proto, flow_no)")
def _(spark, sf):
    return FL.destination_ports(_flows(spark, sf))


@query("dst_ports_top5", f"""with {SESS} {_PORTS} {_STARTS}, ranked as (select *, row_number() over (
  partition by lo_ip, lo_port, hi_ip, hi_port, proto, flow_no order by packets desc, seen) as r from ports)
  select min(src_ip) as src_ip, min(dst_ip) as dst_ip, min(src_port) as src_port, min(dst_port_of_flow) as dst_port,
  proto, min(first_ts) as first_ts, string_agg(port || ':' || packets, ';' order by r) as dst_ports
  from ranked join starts_at using (lo_ip, lo_port, hi_ip, hi_port, proto, flow_no) where r <= 5
  group by lo_ip, lo_port, hi_ip, hi_port, proto, flow_no""")
def _(spark, sf):
    return _flows(spark, sf).select(*_ID, FL.top_ports_text().alias("dst_ports"))


_WIN = 24 * 3600
WINDOWED = KEYED.replace("epoch_us(ts) as ts_us,", f"epoch_us(ts) as ts_us, epoch_us(ts) // {_WIN * 1000000} as win,") + \
    _sessions("sess", "since is null", _K + ", win") + flow_cte(
        partition=_K + ", win", extra=f", min(win) * {_WIN * 1000000} as window_start_us")


@query("flow_window_batch", f"with {WINDOWED} select {ID}, last_ts, window_start_us, fwd_n, bwd_n, fwd_bytes, bwd_bytes, "
                            "fwd_iat_sum, bwd_iat_sum, fwd_win, bwd_win from flow")
def _(spark, sf):
    return FL.window_flows(B.packets(spark, sf), _WIN).select(
        *_ID, "last_ts", "window_start_us", "fwd_n", "bwd_n", "fwd_bytes", "bwd_bytes",
        "fwd_iat_sum", "bwd_iat_sum", "fwd_win", "bwd_win")


# Tick variant: the same walk as a recursive query over per-tick counts.
_TICK, _TO = B.FLOW.micros(B.FLOW.tick), B.FLOW.micros(B.FLOW.timeout)
_DUR, _MINP = B.FLOW.micros(B.FLOW.min_duration), B.FLOW.min_packets


def ticks_cte(as_of: str | None) -> str:
    keyed = KEYED + f", ticked as (select *, ts_us // {_TICK} as tick from keyed" + (
        f" where ts_us <= {as_of})" if as_of else ")")
    return "recursive " + keyed + f""",
ticks as (select {_K}, tick, min(ts_us) as a, max(ts_us) as z, count(*) as n,
  row_number() over (partition by {_K} order by tick) as rn from ticked group by {_K}, tick),
walk as (
  select {_K}, tick, rn, 1 as flow_no, a as start, z as last, n as cnt, z - a >= {_DUR} and n >= {_MINP} as cut
  from ticks where rn = 1
  union all
  select {', '.join('t.' + k.strip() for k in _K.split(','))}, t.tick, t.rn, w.flow_no + s.fresh,
    case when s.fresh = 1 then t.a else w.start end, t.z, case when s.fresh = 1 then t.n else w.cnt + t.n end,
    t.z - case when s.fresh = 1 then t.a else w.start end >= {_DUR}
      and case when s.fresh = 1 then t.n else w.cnt + t.n end >= {_MINP}
  from walk w join ticks t on t.lo_ip = w.lo_ip and t.lo_port = w.lo_port and t.hi_ip = w.hi_ip
    and t.hi_port = w.hi_port and t.proto = w.proto and t.rn = w.rn + 1,
    lateral (select case when w.cut or t.tick * {_TICK} - w.last > {_TO} then 1 else 0 end as fresh) s),
sess_1 as (select p.*, w.flow_no, w.cut, ts_us - lag(ts_us) over (partition by {', '.join('p.' + k.strip() for k in _K.split(','))}, w.flow_no
    order by ts_us, pkt_id) as iat from ticked p join walk w using (lo_ip, lo_port, hi_ip, hi_port, proto, tick)),
sess as (select *, src_ip = f_src_ip and src_port = f_src_port as fwd
  from (select *, first_value(src_ip) over g as f_src_ip, first_value(dst_ip) over g as f_dst_ip,
        first_value(src_port) over g as f_src_port, first_value(dst_port) over g as f_dst_port
        from sess_1 window g as (partition by {_K}, flow_no order by ts_us, pkt_id)) y)""" + flow_cte(
        extra=", bool_or(cut) as was_cut")


_TICK_COLS = ["last_ts", "fwd_n", "bwd_n", "fwd_bytes", "bwd_bytes", "fwd_iat_sum", "bwd_iat_sum", "fwd_win", "bwd_win"]
_ENDED = "case when was_cut then 'active' else 'idle' end as ended_by"


@query("flow_active_cut", f"with {ticks_cte(None)} select {ID}, {', '.join(_TICK_COLS)}, {_ENDED} from flow")
def _(spark, sf):
    return FL.aggregate_flows_on_ticks(B.packets(spark, sf), B.FLOW).select(*_ID, *_TICK_COLS, "ended_by")


# 2024-01-20 12:10 UTC, within the data's 30 days and inside a tick.
_AS_OF = 1_705_752_600_000_000


@query("flow_tick_eviction", f"""with {ticks_cte(str(_AS_OF))} select {ID}, {', '.join(_TICK_COLS)}, {_ENDED} from flow
  where {_AS_OF // _TICK * _TICK} - last_ts > {_TO} or (was_cut and (last_ts // {_TICK} + 1) * {_TICK} <= {_AS_OF})""")
def _(spark, sf):
    flows = FL.aggregate_flows_on_ticks(B.packets(spark, sf), B.FLOW, as_of_us=_AS_OF)
    return flows.select(*_ID, *_TICK_COLS, "ended_by")


def _feature_query(name: str, belongs) -> None:
    names = [n for n in FEATURES if belongs(n)]

    @query(name, f"with {FLOW} select {ID}, {feature_select(names)} from flow")
    def _(spark, sf):
        return FE.flow_features(_flows(spark, sf), _ID, names)


_feature_query("features_77", lambda n: True)
_feature_query("features_len_stats", lambda n: "Packet Length" in n)
_feature_query("features_rates", lambda n: n.endswith("/s"))
_feature_query("features_iat_stats", lambda n: " IAT " in n)
_feature_query("features_active_idle", lambda n: n.startswith(("Active ", "Idle ")))
_feature_query("features_ratio", lambda n: n == "Down/Up Ratio" or n.startswith("Avg "))

_LEGACY = [FSQL[n] for n in (
    "Protocol", "Flow Duration", "Total Fwd Packets", "Total Backward Packets", "Fwd Packets Length Total",
    "Fwd Packet Length Max", "Fwd Packet Length Min", "Fwd Packet Length Std", "Bwd Packet Length Max",
    "Bwd Packet Length Min", "Bwd Packet Length Std", "Flow Bytes/s", "Flow Packets/s", "Flow IAT Mean",
    "Flow IAT Min", "Bwd IAT Mean", "Bwd IAT Mean", "Bwd IAT Min", "Fwd PSH Flags", "SYN Flag Count",
    "ACK Flag Count", "URG Flag Count", "CWE Flag Count", "Down/Up Ratio")] + [
    "cast(fwd_bytes as double) / greatest(fwd_n, 1)", "cast(bwd_bytes as double) / greatest(bwd_n, 1)",
    FSQL["Fwd Packets/s"], FSQL["Packet Length Mean"], FSQL["Packet Length Mean"],
    "cast(fwd_bytes as double)", "cast(bwd_bytes as double)", "0.0::double"]


@query("features_legacy_32", f"with {FLOW} select {ID}, " + ", ".join(
    f"{e} as v{i:02d}" for i, e in enumerate(_LEGACY)) + " from flow")
def _(spark, sf):
    vec = _flows(spark, sf).selectExpr(*_ID, f"{FE.legacy_vector()} as v")
    return vec.selectExpr(*_ID, *[f"v[{i}] as v{i:02d}" for i in range(32)])


_SUMMARY = ["Total Fwd Packets", "Total Backward Packets", "Fwd Packets Length Total", "Bwd Packets Length Total",
            "SYN Flag Count"]


@query("flow_protocol_summary", f"with {FLOW}, feat as (select proto as protocol_no, {feature_select(_SUMMARY + ['Flow Duration'])} "
       "from flow) select protocol_no, count(*) as flows, " + ", ".join(
           f'sum("{n}") as {n.lower().replace(" ", "_")}' for n in _SUMMARY) +
       ', sum("Flow Duration") / count(*) as mean_duration_us from feat group by protocol_no')
def flow_protocol_summary(spark, sf):
    """Flagship: packets to flows to features, summarised by protocol."""
    feat = FE.flow_features(_flows(spark, sf))
    return feat.groupBy(F.col("proto").alias("protocol_no")).agg(
        F.count(F.lit(1)).alias("flows"),
        *[F.sum(F.col(f"`{n}`")).alias(n.lower().replace(" ", "_")) for n in _SUMMARY],
        (F.sum(F.col("`Flow Duration`")) / F.count(F.lit(1))).alias("mean_duration_us"))
