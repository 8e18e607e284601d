"""Runs a registered query and its SQL equivalent and compares the whole results."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set threads to 4")
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from read_parquet('{path}')")
    return con


def norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, repr(v))
    if isinstance(v, float):
        if math.isnan(v):
            return (2, "nan")
        return (2, repr(v + 0.0 if v != 0 else 0.0))
    if isinstance(v, int):
        return (2, repr(float(v)))
    return (3, str(v))


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data)


def differences(spark, fn, sql: str, sf_dir: str, con=None) -> str | None:
    con = con or connect(sf_dir)
    df = fn(spark, sf_dir)
    got_cols = df.columns
    got = rows(got_cols, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want_cols = [d[0] for d in res.description]
    want = rows(want_cols, res.fetchall())
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        names = sorted(got_cols)
        a, b = bad[0]
        diff = [(n, x, y) for n, x, y in zip(names, a, b) if x != y][:5]
        return f"{len(bad)} of {len(got)} rows differ, e.g. {diff}"
    return None
