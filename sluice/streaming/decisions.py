"""Block and alert decisions over a stream of events; state per source, or per bucket of sources and attacks."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sluice.operators.mitigation import qualifies
from sluice.schemas import ALERT_COOLDOWN_SECONDS, ATTACK_THRESHOLD, FlowParams


def _block(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    done = bool(state.get[0]) if state.exists else False
    # Arrow batches of one trigger: the earliest qualifying event among all of them blocks.
    rows = pd.concat(list(batches)).sort_values(["ts_us", "event_id"])
    blocked = pd.Series(False, index=rows.index)
    hits = (rows["hit"] & rows["ok"]).to_numpy().nonzero()[0]
    if not done and len(hits):
        blocked.iloc[hits[0]] = True
        state.update((True,))
    yield pd.DataFrame({"event_id": rows["event_id"], "src_ip": key[0], "blocked": blocked})


def block_first_per_source(events: DataFrame, threshold: float = ATTACK_THRESHOLD, success: str | None = None) -> DataFrame:
    """(event_id, src_ip, blocked): a source is blocked once, failed attempts are tried again."""
    rows = events.select("src_ip", F.unix_micros("ts").alias("ts_us"), "event_id", qualifies(threshold).alias("hit"),
                         (F.col(success) if success else F.lit(True)).alias("ok"))
    return rows.groupBy("src_ip").applyInPandasWithState(
        _block, "event_id long, src_ip string, blocked boolean", "done boolean", "append", GroupStateTimeout.NoTimeout)


#: How late events may come where nothing else is said; a longer cooldown takes its place.
LATENESS_SECONDS = 600.0


#: Calls that one trigger makes; a call costs milliseconds, however few keys and events it takes.
BUCKETS = 256


class Cooldown:
    """Keys of a bucket in one call. State: the keys and, one after another, the times of their alerts that an event may still fall beside."""

    def __init__(self, seconds: float):
        self.cooldown = FlowParams.micros(seconds)

    def __call__(self, _bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = self._known(state)
        rows = pd.concat(list(batches), ignore_index=True)
        ts, ids = rows["ts_us"].to_numpy(), rows["event_id"].to_numpy()
        codes, values = zip(*(pd.factorize(rows[c], use_na_sentinel=False) for c in ("src_ip", "prediction")))
        of = codes[0].astype(np.int64) * len(values[1]) + codes[1]
        order = np.lexsort((ids, ts, of))
        ts, ids, of = ts[order], ids[order], of[order]
        begins = np.flatnonzero(np.diff(of, prepend=-1))
        kept = []
        for a, b in zip(begins, np.append(begins[1:], len(of))):
            key = tuple(v[i] if isinstance(v[i], str) else None for v, i in zip(values, divmod(int(of[a]), len(values[1]))))
            kept += [(*key, *alert) for alert in self._alerts(ts[a:b], ids[a:b], known.setdefault(key, []))]
        self._remember(known, state)
        yield pd.DataFrame(kept, columns=["src_ip", "prediction", "ts_us", "id"])

    def _alerts(self, ts: np.ndarray, ids: np.ndarray, alerts: list[int]) -> list[tuple[int, int]]:
        """(time, id) of a key's new alerts, which are added to those it had, ascending."""
        kept, i = [], 0
        while i < len(ts):  # one step an alert: the events that it silences are passed by a search
            now = int(ts[i])
            at = bisect_right(alerts, now)
            if at and now - alerts[at - 1] < self.cooldown:
                over = alerts[at - 1]
            elif at < len(alerts) and alerts[at] - now < self.cooldown:
                over = alerts[at]
            else:
                alerts.insert(at, now)
                kept.append((now, int(ids[i])))
                over = now
            i = max(i + 1, int(np.searchsorted(ts, over + self.cooldown)))
        return kept

    @staticmethod
    def _known(state: GroupState) -> dict[tuple, list[int]]:
        if not state.exists:
            return {}
        sources, predictions, many, times = state.get
        ends = np.cumsum(many, dtype=np.int64)
        return {key: list(times[end - n:end]) for key, n, end in zip(zip(sources, predictions), many, ends)}

    def _remember(self, known: dict[tuple, list[int]], state: GroupState) -> None:
        # Once the watermark is past the cooldown no event can fall into it any more.
        now = state.getCurrentWatermarkMs()
        live = {key: some for key, times in known.items() if (some := [t for t in times if t + self.cooldown > now * 1000])}
        if not live:
            state.remove()
            return
        state.update(([k[0] for k in live], [k[1] for k in live], [len(t) for t in live.values()], [t for some in live.values() for t in some]))
        over = -(-(max(some[-1] for some in live.values()) + self.cooldown) // 1000)
        state.setTimeoutTimestamp(max(over, now + 1))


def alerts_after_cooldown(events: DataFrame, cooldown_seconds: float = ALERT_COOLDOWN_SECONDS,
                          delay: str | None = None) -> DataFrame:
    """Alerts of each (source, attack), at least one cooldown apart. A key is forgotten when its cooldown is over.

    ``delay`` says how late events may come (ten minutes, or the cooldown if that is longer); later ones are left out.
    Alerts are sent at once: a late event alerts unless an alert already sent is less than a cooldown before or after it.
    """
    delay = delay or f"{math.ceil(max(cooldown_seconds, LATENESS_SECONDS))} seconds"
    rows = events.withWatermark("ts", delay).select("src_ip", "prediction", "ts", F.unix_micros("ts").alias("ts_us"), "event_id")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("src_ip", "prediction"), F.lit(BUCKETS)))
    return rows.groupBy("bucket").applyInPandasWithState(
        Cooldown(cooldown_seconds), "src_ip string, prediction string, ts_us long, id long",
        "src_ip array<string>, prediction array<string>, many array<long>, alerts array<long>", "append", GroupStateTimeout.EventTimeTimeout)
