import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import features, flows
from sluice.schemas import FEATURES, PACKET_SCHEMA, FlowParams
from sluice.sources import eventlog
from sluice.streaming import live, runs

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def packet(i, at, src="10.0.0.1", dst="10.0.0.9", sport=1000, dport=80, proto=6, size=100, header=40, payload=60,
           flags=0, window=500):
    return (i, T0 + timedelta(seconds=at), src, dst, sport, dport, proto, size, header, payload, flags, window)


def reverse(i, at, **kw):
    return packet(i, at, src="10.0.0.9", dst="10.0.0.1", sport=80, dport=1000, **kw)


def frame(spark, rows):
    return spark.createDataFrame(rows, PACKET_SCHEMA)


def test_idle_gap_must_exceed_the_timeout(spark):
    for gap, n in ((9.999, 1), (10.0, 1), (10.001, 2)):
        assert flows.aggregate_flows(frame(spark, [packet(0, 0), packet(1, gap)])).count() == n


def test_direction_follows_the_first_packet_of_each_flow(spark):
    rows = [reverse(0, 0, window=7), packet(1, 1), packet(2, 30), reverse(3, 31)]
    got = {(r["src_ip"], r["fwd_n"], r["bwd_n"], r["fwd_win"]) for r in flows.aggregate_flows(frame(spark, rows)).collect()}
    assert got == {("10.0.0.9", 1, 1, 7), ("10.0.0.1", 1, 1, 500)}


@pytest.mark.parametrize("slice_seconds", [1.0, 3.0, 60.0])
def test_slices_do_not_change_the_flows(spark, slice_seconds):
    """Random packets of a few endpoint pairs, one of them holding most of them."""
    rng, rows, at = random.Random(3), [], 0.0
    for i in range(1500):
        at += rng.choice([0.0, 0.01, 0.4, 2.5, 9.9, 12.0]) * rng.random()
        make = packet if rng.random() < 0.6 else reverse
        port = 80 if rng.random() < 0.8 else rng.choice([81, 82])
        p = dict(size=rng.randint(40, 1500), flags=rng.randint(0, 255), window=rng.randint(-1, 9000), payload=rng.randint(0, 3))
        row = packet(i, at, **p, dport=port) if make is packet else packet(
            i, at, src="10.0.0.9", dst="10.0.0.1", sport=port, dport=1000, **p)
        rows.append(row)
    got = flows.aggregate_flows(frame(spark, rows), FlowParams(slice_seconds=slice_seconds))
    got = {(r["src_ip"], r["src_port"], r["dst_port"], r["first_ts"]): r.asDict() for r in got.collect()}
    want = fold(rows, 10.0)
    assert set(got) == set(want)
    for k, w in want.items():
        for name, value in w.items():
            assert got[k][name] == value, (k, name)
    assert sum(g["fwd_n"] + g["bwd_n"] for g in got.values()) == len(rows)


def fold(rows, timeout):
    """Packet by packet, as a capture would see them."""
    open_flows, done = {}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        _i, ts, src, dst, sport, dport, proto, size, header, payload, flags, window = r
        us = int(round((ts - T0).total_seconds() * 1e6))
        key = tuple(sorted([(src, sport), (dst, dport)])) + (proto,)
        f = open_flows.get(key)
        if f is None or us - f["last"] > timeout * 1e6:
            f = open_flows[key] = {"src": (src, sport), "dst": (dst, dport), "first": us, "last": us, "len": ([], []),
                                   "iat": ([], []), "hdr": [0, 0], "data": 0, "win": [None, None], "psh": 0, "new": True}
            done.setdefault(key, []).append(f)
        d = 0 if (src, sport) == f["src"] else 1
        if not f.pop("new", False):
            f["iat"][d].append(us - f["last"])
        f["last"] = us
        f["len"][d].append(size)
        f["hdr"][d] += header
        f["data"] += d == 0 and payload > 0
        if f["win"][d] is None and window >= 0:
            f["win"][d] = window
        f["psh"] += bool(flags & 8)
    base = int(T0.timestamp() * 1e6)
    out = {}
    for fs in done.values():
        for f in fs:
            iats = f["iat"][0] + f["iat"][1]
            out[(f["src"][0], f["src"][1], f["dst"][1], base + f["first"])] = {
                "fwd_n": len(f["len"][0]), "bwd_n": len(f["len"][1]), "fwd_bytes": sum(f["len"][0]),
                "bwd_len_sq": sum(x * x for x in f["len"][1]), "fwd_hdr": f["hdr"][0], "fwd_data": f["data"],
                "fwd_win": f["win"][0], "bwd_win": f["win"][1], "psh_count": f["psh"],
                "fwd_iat_sum": sum(f["iat"][0]), "bwd_iat_n": len(f["iat"][1]),
                "bwd_iat_max": max(f["iat"][1], default=None), "fwd_iat_min": min(f["iat"][0], default=None),
                "idle_n": sum(x >= 1_000_000 for x in iats), "idle_sum": sum(x for x in iats if x >= 1_000_000)}
    return out


def test_features_match_numpy(spark):
    sizes, times = [100, 300, 60, 900], [0, 0.5, 2.0, 2.25]
    rows = [packet(0, times[0], size=sizes[0], flags=8), reverse(1, times[1], size=sizes[1]),
            packet(2, times[2], size=sizes[2]), packet(3, times[3], size=sizes[3])]
    r = features.flow_features(flows.aggregate_flows(frame(spark, rows))).first()
    fwd, bwd, iat = [100, 60, 900], [300], np.array([0.5, 1.5, 0.25]) * 1e6
    want = {"Fwd Packet Length Std": np.std(fwd), "Packet Length Variance": np.var(fwd + bwd), "Flow IAT Std": np.std(iat),
            "Fwd IAT Mean": np.mean(iat[1:]), "Bwd IAT Total": iat[0], "Idle Mean": 1.5e6, "Idle Std": 0.0,
            "Flow Duration": 2.25e6, "Flow Bytes/s": 1360 / 2.25e6 * 1e6, "Down/Up Ratio": 1 / 3, "Fwd PSH Flags": 1.0,
            "Active Max": 2.25e6, "Bwd Avg Bulk Rate": 0.0, "Packet Length Min": 60.0}
    for name, value in want.items():
        assert r[name] == pytest.approx(value, rel=1e-12), name
    assert r.__fields__[-len(FEATURES):] == FEATURES


def test_one_way_flow_counts_a_zero_length(spark):
    r = features.flow_features(flows.aggregate_flows(frame(spark, [packet(0, 0, size=90), packet(1, 1, size=30)]))).first()
    assert r["Packet Length Min"] == 0.0 and r["Packet Length Mean"] == 40.0 and r["Bwd IAT Max"] == 0.0


def tick_fold(times, params):
    """Flows of one direction as the five-second check ends them."""
    out, flow = [], []
    for t in times:
        tick = t // params.tick * params.tick
        if flow:
            ended = (flow[-1] // params.tick + 1) * params.tick
            large = flow[-1] - flow[0] >= params.min_duration and len(flow) >= params.min_packets
            if (tick >= ended and large) or tick - flow[-1] > params.timeout:
                out.append(flow)
                flow = []
        flow = flow + [t]
    return out + [flow]


def test_tick_flows_match_the_fold(spark):
    rng = random.Random(9)
    params = FlowParams(timeout=10, min_duration=3, min_packets=8, tick=5)
    t, times = 0, []
    for _ in range(400):
        t += rng.choice([0.1, 0.2, 0.5, 1.0, 4.0, 11.0, 16.0])
        times.append(round(t, 3))
    rows = [packet(i, at) for i, at in enumerate(times)]
    got = flows.aggregate_flows_on_ticks(frame(spark, rows), params).orderBy("first_ts")
    assert [r["fwd_n"] for r in got.collect()] == [len(f) for f in tick_fold(times, params)]
    assert got.where("ended_by = 'active'").count() > 3


def test_late_packet_before_the_tick_extends_the_flow(spark):
    # Idle for 12 s, but no tick falls into the time the flow counts as idle.
    params = FlowParams()
    assert flows.aggregate_flows_on_ticks(frame(spark, [packet(0, 4.5), packet(1, 16.5)]), params).count() == 2
    assert flows.aggregate_flows_on_ticks(frame(spark, [packet(0, 5.5), packet(1, 17.5)]), params).count() == 1


def test_open_flows_stay_out(spark):
    rows = [packet(0, 0), packet(1, 100, dport=81)]
    as_of = int((T0 + timedelta(seconds=105)).timestamp() * 1e6)
    assert flows.aggregate_flows(frame(spark, rows), as_of_us=as_of).count() == 1
    assert flows.aggregate_flows_on_ticks(frame(spark, rows), as_of_us=as_of).count() == 1


def test_top_ports(spark):
    f = flows.aggregate_flows(frame(spark, [packet(0, 0), packet(1, 1), reverse(2, 2)]))
    assert f.select(flows.top_ports_text()).first()[0] == "80:2;1000:1"


def test_plan_shuffles_packets_once(spark):
    plan = flows.aggregate_flows(frame(spark, [packet(0, 0)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert "SortAggregate" not in plan


def test_a_failed_window_is_logged_and_left_out(spark, tmp_path):
    """Every third window fails; a window that is run again leaves no second copy."""
    rows = spark.createDataFrame([("10.0.0.1", "10.0.0.9", "53", "7", "6")], ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"])

    def score(df):
        if failing:
            raise ValueError("no such model")
        return df.withColumn("probability", F.array(*[F.lit(0.0)] * 5, F.lit(1.0), F.lit(0.0)))

    detector = live.WindowDetector(str(tmp_path), score)
    for batch, failing in ((0, False), (1, True), (2, False), (2, False)):
        detector(rows, batch)
    events = eventlog.read_events(spark, f"{tmp_path}/events").collect()
    assert sorted((e["prediction"], e["blocked"]) for e in events) == [("UDP Flood", "false"), ("UDP Flood", "true")]
    failures = spark.read.option("recursiveFileLookup", True).json(f"{tmp_path}/failures").collect()
    assert [(f["batch"], f["error"]) for f in failures] == [(1, "ValueError")]


@pytest.mark.parametrize("alert_on, cooldown, told", [
    ("attack", 3600, [("10.0.0.1", 0), ("10.0.0.2", 2)]),
    ("attack", 0.001, [("10.0.0.1", 0), ("10.0.0.1", 2), ("10.0.0.2", 2)]),
    ("block", 0.001, [("10.0.0.1", 0), ("10.0.0.2", 2)])])
def test_alerts_are_silent_over_windows(spark, tmp_path, alert_on, cooldown, told):
    """Of three windows the second fails; the silence of the first lasts over it, and a batch run again tells no more."""
    def rows(*sources):
        return spark.createDataFrame([(s, "10.0.0.9", "53", "7", "6") for s in sources], ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"])

    def score(df):
        if failing:
            raise ValueError("bad rows")
        return df.withColumn("probability", F.array(*[F.lit(0.0)] * 5, F.lit(1.0), F.lit(0.0)))

    detector = live.WindowDetector(str(tmp_path), score, cooldown_seconds=cooldown, alert_on=alert_on)
    for batch, failing in ((0, False), (1, True), (2, False), (2, False)):
        detector(rows("10.0.0.1", "10.0.0.1", *["10.0.0.2"] * (batch > 0)), batch)
    out = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/alerts")
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/alerts/(\d+)/", 1).cast("int")
    found = out.select("src_ip", number.alias("batch"), "message").collect()
    assert sorted((r["src_ip"], r["batch"]) for r in found) == told
    assert found[0]["message"].startswith("Attack type: UDP Flood")


def test_a_fault_of_the_cluster_loses_no_window(spark, tmp_path):
    """A store that fails once ends the stream; started again, it takes the same window and the ones after it."""
    rows = spark.createDataFrame([(f"10.0.0.{i}", "10.0.0.9", "53", "7", "6") for i in range(3)], ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"])
    rows.repartition(3).write.option("header", True).csv(f"{tmp_path}/csv")
    files = len(list((tmp_path / "csv").glob("part-*")))
    faults = [OSError("store is away")]

    def score(df):
        if faults:
            raise faults.pop()
        return df.withColumn("probability", F.array(*[F.lit(0.0)] * 5, F.lit(1.0), F.lit(0.0)))

    def run():
        stream = runs.read_flow_csv(spark, f"{tmp_path}/csv", rows.columns)
        runs.start_batches(stream, live.WindowDetector(f"{tmp_path}/out", score), f"{tmp_path}/checkpoint").awaitTermination()

    with pytest.raises(Exception, match="store is away"):
        run()
    run()
    events = eventlog.read_events(spark, f"{tmp_path}/out/events").collect()
    assert files >= 2 and sorted(e["src_ip"] for e in events) == ["10.0.0.0", "10.0.0.1", "10.0.0.2"]
    assert not (tmp_path / "out" / "failures").exists()
