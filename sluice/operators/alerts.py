"""Alert rate limiting: an alert silences its key until the cooldown is over.

Whether an event alerts depends on the last alert before it, so events of a key form a
chain. To keep a key with very many events from becoming one long task, events are
ordered by key and time and cut into chunks of about ``CHUNK_ROWS`` rows:

1. a chunk is a function from the time until which its key is silent before it to the
   time until which it is silent after it. Only the first key of a chunk can come from
   the chunk before, and only events within one cooldown of its first event can be its
   first alert; those that lead to the same last alert are one step of the function.
2. functions of neighbouring chunks are composed, ``FAN_IN`` at a time, level by level,
   and the levels are then walked down to give each chunk its time of silence.
3. per chunk the alerts are marked, starting at the first event after that.

A function has one step for each distinct time in one cooldown at most. Chains meet
after a few alerts, so that composed functions mostly have a handful.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sluice import workdir
from sluice.functions import scalars as S
from sluice.schemas import ALERT_COOLDOWN_SECONDS, FlowParams

CHUNK_ROWS = 250_000
FAN_IN = 16
_NEVER = np.iinfo(np.int64).min


def _key_starts(pdf: pd.DataFrame, key: Sequence[str]) -> np.ndarray:
    change = np.zeros(len(pdf), dtype=bool)
    change[0] = True
    for k in key:
        codes = pd.factorize(pdf[k], use_na_sentinel=False)[0]
        change[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(change)


def _next_alert(ts: np.ndarray, starts: np.ndarray, cooldown: int) -> np.ndarray:
    """Per row the row of its key's next alert if this one alerts, ``len(ts)`` if there is none."""
    n = len(ts)
    # A gap of a cooldown or more ends the silence however long it is, so cut gaps keep the line short.
    gaps = np.minimum(np.diff(ts, prepend=ts[:1]), cooldown)
    gaps[starts] = cooldown
    line = np.cumsum(gaps)
    nxt = np.maximum(np.searchsorted(line, line + cooldown, side="left"), np.arange(1, n + 1))
    ends = np.append(starts[1:], n)
    return np.where(nxt < np.repeat(ends, ends - starts), nxt, n)


def _merged(upto: np.ndarray, leads_to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring steps with one value are one step."""
    closes = np.append(leads_to[1:] != leads_to[:-1], True)
    return upto[closes], leads_to[closes]


def _chunk_function(key: Sequence[str], cooldown: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Steps (upto, leads_to): silence that ends in (previous upto, upto] makes ``leads_to`` the chunk's last alert."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        ts, starts, n = pdf["ts_us"].to_numpy(), _key_starts(pdf, key), len(pdf)
        nxt = _next_alert(ts, starts, cooldown)
        last = np.append(np.where(nxt < n, nxt, np.arange(n)), n)
        while True:  # pointer doubling: follow chains to their last alert
            further = last[last[:n]]
            if np.array_equal(further, last[:n]):
                break
            last[:n] = further
        first = ts[:starts[1] if len(starts) > 1 else n]
        steps = min(int(np.searchsorted(first, first[0] + cooldown)) + 1, len(first))
        upto, leads_to = _merged(first[:steps], ts[last[:steps]])
        rows = pdf.iloc[np.zeros(len(upto), dtype=int)][[*key, "chunk"]].assign(upto=upto, leads_to=leads_to)
        if len(starts) == 1:
            return rows
        # The last key starts here, so its first event alerts; keys between the two lie in this chunk alone.
        tail = pdf.iloc[[starts[-1]]][[*key, "chunk"]].assign(upto=ts[starts[-1]], leads_to=ts[last[starts[-1]]])
        return pd.concat([rows, tail], ignore_index=True)

    return run


def _functions(pdf: pd.DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(chunk, upto, leads_to) of each chunk in order."""
    pdf = pdf.sort_values(["chunk", "upto"], ignore_index=True)
    chunk, upto, leads_to = (pdf[c].to_numpy() for c in ("chunk", "upto", "leads_to"))
    cuts = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
    return [(int(chunk[a]), upto[a:b], leads_to[a:b]) for a, b in zip(cuts, np.append(cuts[1:], len(pdf)))]


def _composed(key: Sequence[str], cooldown: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The function of a block of neighbouring chunks from theirs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = _functions(pdf)
        _, upto, leads_to = parts[-1]
        for _, before, value in reversed(parts[:-1]):
            at = np.searchsorted(upto, value + cooldown)
            through = np.where(at < len(upto), leads_to[np.minimum(at, len(upto) - 1)], value)
            passed = upto > before[-1]  # silence that outlasts the first chunk meets the next one unchanged
            upto, leads_to = np.append(before, upto[passed]), np.append(through, leads_to[passed])
            steps = int(np.searchsorted(upto, upto[0] + cooldown)) + 1  # no silence ends later
            upto, leads_to = _merged(upto[:steps], leads_to[:steps])
        rows = pdf.iloc[np.zeros(len(upto), dtype=int)]
        return rows[[*key, "block"]].rename(columns={"block": "chunk"}).assign(upto=upto, leads_to=leads_to)

    return run


def _silences(key: Sequence[str], cooldown: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Until when each chunk of a block is silent, given that of the block; none for a key's first chunk."""

    def run(steps: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        since = int(block["since"].iloc[0]) if len(block) else _NEVER
        chunks, silent = [], []
        for chunk, upto, leads_to in _functions(steps) if len(steps) else ():
            if since != _NEVER:
                chunks.append(chunk)
                silent.append(since)
            at = int(np.searchsorted(upto, since))
            if at < len(upto):
                since = int(leads_to[at]) + cooldown
        rows = steps.iloc[np.zeros(len(chunks), dtype=int)][list(key)]
        return rows.assign(chunk=np.array(chunks, dtype=np.int64), since=np.array(silent, dtype=np.int64))

    return run


def _mark(key: Sequence[str], cooldown: int) -> Callable[..., pd.DataFrame]:
    def run(pdf: pd.DataFrame, before: pd.DataFrame | None = None) -> pd.DataFrame:
        columns = [*key, "ts_us", "id"]
        if pdf.empty:
            return pdf[columns]
        pdf = pdf.sort_values("pos", ignore_index=True)
        ts, starts, n = pdf["ts_us"].to_numpy(), _key_starts(pdf, key), len(pdf)
        nxt = _next_alert(ts, starts, cooldown)
        at = starts.copy()
        if before is not None and len(before):
            end = starts[1] if len(starts) > 1 else n
            first = int(np.searchsorted(ts[:end], int(before["since"].iloc[0])))
            at = np.append(first, at[1:]) if first < end else at[1:]
        alerts = np.zeros(n, dtype=bool)
        while len(at):
            alerts[at] = True
            at = nxt[at]
            at = at[at < n]
        return pdf.loc[alerts, columns]

    return run


def alerts_after_cooldown(events: DataFrame, key: Sequence[str] = ("src_ip", "prediction"), ts: str = "ts",
                          event_id: str = "event_id",
                          cooldown_seconds: float = ALERT_COOLDOWN_SECONDS) -> DataFrame:
    """Keys, time and id of the events that alert.

    Events of a key at one time are one, with the smallest id. A null in a key is a key of its own; an event without
    a time never alerts.
    """
    key = list(key)
    cooldown = FlowParams.micros(cooldown_seconds)
    rows = events.select(*key, F.unix_micros(ts).alias("ts_us"), F.col(event_id).alias("id")).where(F.col("ts_us").isNotNull())
    types = {f.name: f.dataType for f in rows.schema.fields}
    keyed = [T.StructField(k, types[k]) for k in key]

    def schema(**fields: T.DataType) -> T.StructType:
        return T.StructType(keyed + [T.StructField(n, t) for n, t in fields.items()])

    long = T.LongType()
    steps_schema, since_schema = schema(chunk=long, upto=long, leads_to=long), schema(chunk=long, since=long)
    times = workdir.materialize(rows.groupBy(*key, "ts_us").agg(F.min("id").alias("id")), "alert-times")
    chunks = max(1, -(-times.count() // CHUNK_ROWS))
    # The position holds the chunk in its upper bits; it is written, since ranges differ from one run to the next.
    placed = (times.repartitionByRange(chunks, *key, "ts_us").sortWithinPartitions(*key, "ts_us")
              .withColumn("pos", F.monotonically_increasing_id()).withColumn("chunk", F.shiftright("pos", 33)))
    marked = schema(ts_us=long, id=types["id"])
    if chunks == 1:  # nothing comes from a chunk before
        mark = _mark(key, cooldown)
        return placed.groupBy("chunk").applyInPandas(lambda pdf: mark(pdf), marked)
    placed = workdir.materialize(placed, "alert-chunks")
    levels = [workdir.materialize(placed.groupBy("chunk").applyInPandas(_chunk_function(key, cooldown), steps_schema), "alert-steps")]
    while chunks > FAN_IN:
        chunks = -(-chunks // FAN_IN)
        blocks = _in_blocks(levels[-1]).groupBy(*key, "block").applyInPandas(_composed(key, cooldown), steps_schema)
        levels.append(workdir.materialize(blocks, "alert-steps"))
    since = events.sparkSession.createDataFrame([], since_schema)
    for steps in reversed(levels):
        known = since.withColumnRenamed("chunk", "block").groupBy(*key, "block")
        by_block = _in_blocks(steps).groupBy(*key, "block")
        since = workdir.materialize(by_block.cogroup(known).applyInPandas(_silences(key, cooldown), since_schema), "alert-silence")
    return placed.groupBy("chunk").cogroup(since.groupBy("chunk")).applyInPandas(_mark(key, cooldown), marked)


def _in_blocks(steps: DataFrame) -> DataFrame:
    return steps.withColumn("block", F.expr(f"chunk div {FAN_IN}"))


def alert_message() -> Column:
    """The text shown to the operator (a fixed value)."""
    return F.concat(F.lit("Attack type: "), F.col("prediction"), F.lit("\nSource IP: "), F.col("src_ip"),
                    F.lit("\nTarget IP: "), F.col("dst_ip"), F.lit("\nConfidence: "),
                    S.percent_text(F.col("confidence"), 1), F.lit("\n\nSystem action: Blocking attacker IP..."))
