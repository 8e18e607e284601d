"""SimHash groups, vector links and components against plain Python over all pairs."""

import math

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F, types as T

from sluice.llm import components, metric_join, onebit, simhash
from sluice.llm.queries import QUERIES
from texts import odd_texts

SF = "/root/testdata/sf0.001"
WORDS = __import__("re").compile(r"[^\x20\x09-\x0D]+")


def roots(nodes, links):
    """Least node that each node reaches."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(lower)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    root = roots(range(len(rows)), links)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[root[i]] = min(name, least.get(root[i], name))
    return sorted(((n, f"{p:016x}", least.get(root[i])) for i, ((n, _), p) in enumerate(zip(rows, prints))), key=str)


DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("root", T.StringType())])


def test_fingerprints():
    for t in odd_texts(300):
        assert simhash.fingerprint(t) == plain_fingerprint(t), repr(t)
        for part in (1, 4, 9):
            assert simhash.fingerprint(t, part=part) == plain_fingerprint(t), (repr(t), part)


def test_simhash_registered(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op2_simhash"](spark, SF).collect()), key=str)
    assert got == plain_groups(rows)


def test_simhash_odd_tables(spark, tmp_path):
    base = "one two three four five six seven eight nine ten " * 20
    rows = [(i, t) for i, t in enumerate([None, "", "  \n", "a", "A", "a b", *odd_texts(20), base, base + "x", base.upper(), "copy", "copy"])]
    rows += [(None, "a"), (None, None), (None, "only here, without a name, stands this text"), (3, "a"), (3, "a")]
    for given in ([], rows):
        spark.createDataFrame([(*r, "x", "y") for r in given], DOCS).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        got = sorted((tuple(r) for r in QUERIES["op2_simhash"](spark, str(tmp_path)).collect()), key=str)
        assert got == plain_groups(given)


def prints_of(spark, values):
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    return spark.createDataFrame([(v,) for v in signed], "fp long")


def linked_roots(spark, values, distance, **how):
    got = {r["node"]: r["root"] for r in components.components(simhash.near_links(prints_of(spark, values), distance, **how)).collect()}
    return {v: got.get(v - (1 << 64) if v >> 63 else v) for v in values}


@pytest.mark.parametrize("distance", [1, 2])
@pytest.mark.parametrize("how", [{}, {"group_counts": (3,)}, {"group_counts": (2,)}])
def test_links_connect_what_is_near(spark, distance, how):
    """Chains, far fingerprints, and one crowd of hundreds around a centre, which shares its values in every group."""
    rng = np.random.default_rng(4)
    values = {int(v) for v in rng.integers(0, 1 << 63, 200, dtype=np.uint64)}
    for v in list(values)[:40]:
        for _ in range(3):
            v ^= (1 << int(rng.integers(64))) | (1 << int(rng.integers(64)))
            values.add(v)
    centre = (1 << 64) - 1
    crowd = {centre ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 64, (700, 3))}
    values = sorted(values | crowd | {centre})
    links = [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= distance]
    want = roots(values, links)
    got = linked_roots(spark, values, distance, **how)
    groups = lambda root: sorted(tuple(sorted(v for v in values if root(v) == r)) for r in {root(v) for v in values})
    assert groups(lambda v: want[v]) == groups(lambda v: ("alone", v) if got[v] is None else got[v])


def test_thresholds_by_dynamic_programming():
    cost, chosen = simhash.allocate([{-1: 0, 0: 5, 1: 50, 2: 90}, {-1: 0, 0: 1, 1: 2, 2: 4}, {-1: 0, 0: 9, 1: 99, 2: 999}], 0)
    assert (cost, chosen) == (4.0, [-1, 2, -1])
    assert simhash.allocate([{-1: 0, 0: 5, 1: 7}, {-1: 0, 0: 1, 1: 2}], 1) == (7, [0, 1])


def test_correlated_bits_share_a_group():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (4000, 64))
    for k in range(8):
        bits[:, 5 + 7 * k] = bits[:, 5]
    groups = simhash.correlated_groups(4000, bits.T @ bits, 4)
    assert any({5 + 7 * k for k in range(8)} <= set(g) for g in groups)
    assert sorted(b for g in groups for b in g) == list(range(64))


def test_keep_one(spark):
    rows = [(5, "same words here", "x", "y"), (2, "same words here", "x", "y"), (2, "same words here", "x", "y"), (7, "quite another text", "x", "y"), (None, None, "x", "y"), (None, "", "x", "y")]
    kept = simhash.keep_one(spark.createDataFrame(rows, DOCS))
    assert kept.columns == DOCS.names
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect() if r["doc_id"]) == [(2, "same words here"), (7, "quite another text")]
    assert kept.count() == 3
    assert simhash.keep_one(spark.createDataFrame([], DOCS)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(9)
    links = [tuple(map(int, x)) for x in rng.integers(0, 400, (260, 2))] + [(1000 + k, 1001 + k) for k in range(150)] + [(5000, 5001 + k) for k in range(300)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame([*links, (None, 3)], "x long, y long")).collect()}
    nodes = {n for x in links for n in x if x[0] != x[1]}
    assert got == {n: r for n, r in roots({n for x in links for n in x}, links).items() if n in nodes}
    assert components.components(spark.createDataFrame([], "x long, y long")).count() == 0


VECS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("n_links", T.StringType())])


def valid(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
    return float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b))


def plain_links(rows):
    n = len(rows)
    links = [(i, j) for i in range(n) for j in range(i) if rows[i][2] is not None and rows[i][2] == rows[j][2] and valid(rows[i][1]) and valid(rows[j][1])
             and len(rows[i][1]) == len(rows[j][1]) and cosine(rows[i][1], rows[j][1]) >= 0.98]
    root, least, count = roots(range(n), links), {}, [0] * n
    for i, j in links:
        count[i] += 1
        count[j] += 1
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(r[0], least.get(root[i], r[0]))
    return sorted(((r[0], count[i], least.get(root[i]), r[0] == least.get(root[i])) for i, r in enumerate(rows)), key=str)


def crowded(n=260, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    rows = []
    for i in range(n):
        v = centres[i % 6] + rng.standard_normal(dim) * rng.choice([0.02, 0.12, 0.2, 1.0])
        rows.append((i, (v / np.linalg.norm(v) * rng.uniform(0.5, 2)).astype(np.float32).tolist(), int(i % 6 < 4)))
    return rows


ODD = [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [1.0, None] + [0.0] * 14, 1), (904, [float("nan")] * 16, 1), (905, [float("inf")] * 16, 1),
       (906, [1.0] * 16, None), (907, [1.0] * 16, None), (908, [1.0, 2.0], 1), (909, [2.0, 4.0], 1), (None, [1.0, 2.0], 1), (None, [-1.0, 2.0], 7),
       (910, [1e-30] * 16, 5), (911, [1e30] * 16, 5), (912, [3.0] * 16, 5), (912, [3.0] * 16, 5), (913, [3.0] * 16, 6), (-4, [3.0] * 16, 5)]


@pytest.mark.parametrize("how", [{}, {"cell_rows": 20, "block_rows": 16}, {"cell_rows": 60, "most_pivots": 3, "block_rows": 7}])
def test_vector_links(spark, how):
    rows = crowded() + [(i + 500, v, g) for i, v, g in crowded()[:20]] + ODD
    df = spark.createDataFrame([(*r, "x") for r in rows], VECS)
    assert sorted((tuple(r) for r in metric_join.near_vectors(df, **how).collect()), key=str) == plain_links(rows)
    assert metric_join.near_vectors(df.limit(0), **how).count() == 0


def test_boundary_copies_are_enough():
    rng = np.random.default_rng(8)
    v = rng.standard_normal((600, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    home, row, cell = metric_join.assign(v, v[:12], 0.2)
    there = {(i, int(c)) for i, c in enumerate(home)} | set(zip(row.tolist(), cell.tolist()))
    near = np.argwhere(np.linalg.norm(v[:, None] - v[None], axis=2) <= 0.2)
    assert all((int(y), int(home[x])) in there for x, y in near)
    assert len(there) < 0.7 * 600 * 12


def plain_nearest(rows, k=5):
    out = []
    for q, (name, v, _) in enumerate(rows):
        if name is None or name % 50 or not valid(v):
            continue
        scored = [(cosine(v, w), other) for c, (other, w, _) in enumerate(rows) if c != q and valid(w) and len(w) == len(v)]
        scored.sort(key=lambda x: (-x[0], math.inf if x[1] is None else x[1]))
        out += [(name, r + 1, other, score) for r, (score, other) in enumerate(scored[:k])]
    return out


def recall(got, want):
    have = {(g[0], g[2]) for g in got}
    return sum((w[0], w[2]) in have for w in want) / len(want)


def test_nearest_registered(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        rows = [(r.vec_id, r.embedding, None) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
        got, want = [tuple(r) for r in QUERIES["op3_nearest_vectors"](spark, sf).collect()], plain_nearest(rows)
        assert len(got) == len(want) and recall(got, want) >= 0.95
        exact = {(q, v): s for q, _, v, s in plain_nearest(rows, k=len(rows))}
        assert all(abs(exact[q, v] - s) < 1e-12 for q, _, v, s in got)


@pytest.mark.parametrize("how", [{}, {"block_rows": 30, "query_rows": 2, "sample_rows": 4}, {"width": 1e9, "sample_rows": 40}])
def test_nearest_odd(spark, how):
    rows = crowded() + [(i + 500, v, g) for i, v, g in crowded()[:20]] + ODD + [(950, [1.0, 2.0], 1), (1000, [0.5] * 3, 1), (50, [0.1] * 16, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], VECS)
    got = sorted((tuple(r) for r in onebit.nearest(df, F.col("vec_id") % 50 == 0, **how).collect()))
    want = sorted(plain_nearest(rows))
    assert len(got) == len(want)
    assert recall(got, want) >= (1 if how.get("width") else 0.9)
    if how.get("width"):
        assert [g[:3] for g in got] == [w[:3] for w in want]
    assert onebit.nearest(df.limit(0), F.col("vec_id") % 50 == 0, **how).count() == 0
    assert onebit.nearest(df.where("vec_id = 50"), F.col("vec_id") % 50 == 0, **how).count() == 2


def test_bound_holds_for_nearly_all():
    rng = np.random.default_rng(2)
    v, q = rng.standard_normal((3000, 64)), rng.standard_normal((20, 64))
    v, q = v / np.linalg.norm(v, axis=1, keepdims=True), q / np.linalg.norm(q, axis=1, keepdims=True)
    turn = onebit.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    guess, error = onebit.estimates(*onebit.encode(v, turn), q @ turn.T, 2.7)
    assert (np.abs(guess - v @ q.T) <= error[:, None]).mean() > 0.99


def test_unit_of_extreme_rows():
    rows = np.array([[1e-300, 1e-300], [1e300, 1e300], [3.0, 4.0]])
    assert np.allclose(metric_join.unit(rows), [[math.sqrt(0.5)] * 2] * 2 + [[0.6, 0.8]])


def test_local_roots():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 500, (2, 300))
    got = metric_join.local_roots(a, b, 500)
    want = roots(range(500), list(zip(a.tolist(), b.tolist())))
    assert got.tolist() == [want[i] for i in range(500)]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], VECS).write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("op3_nearest_vectors", "op5_near_vectors"):
        assert QUERIES[name](spark, str(tmp_path)).count() == 0
    pd.testing.assert_index_equal(pd.Index(QUERIES["op5_near_vectors"](spark, str(tmp_path)).columns), pd.Index(["vec_id", "n_links", "component_id", "kept"]))
