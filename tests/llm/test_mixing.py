"""The mix against its SQL in DuckDB, and the splitting tree."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from sluice.llm import mixing
from sluice.llm.queries import mixing_sql
from texts import odd_texts

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("size", T.StringType()), T.StructField("draws", T.StringType())])


def rows_of(kind):
    if kind == "empty":
        return []
    if kind == "no words":
        return [(1, None, "a"), (2, " ", None)]
    if kind == "odd":
        texts = odd_texts(120)
        return [(i if i % 11 else None, t, [None, "", "b", "B", "é", "🙂", "b"][i % 7]) for i, t in enumerate(texts)] + [(3, "a b", "b"), (3, "a b", "b"), (3, "a b c", "b")]
    rng = np.random.default_rng(6)
    return [(i, "w " * int(rng.integers(0, 40)), "hot" if i % 3 == 0 else f"s{int(rng.integers(9))}") for i in range(2500)] + [(9000, "w " * 3000, "s1"), (9001, "w " * 700, "long")]


@pytest.mark.parametrize("kind", ["empty", "no words", "odd", "many"])
@pytest.mark.parametrize("block_words", [50, 1000, mixing.BLOCK_WORDS])
def test_equals_sql(spark, tmp_path, kind, block_words):
    rows = rows_of(kind)
    docs = spark.createDataFrame([(*r, "old", "old") for r in rows], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    drawn = mixing.draw(docs, block_words=block_words, shard_blocks=3).cache()
    got = sorted(drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken")).collect(), key=str)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(mixing_sql(block_words)).fetchall()
    assert [tuple(g) for g in got] == sorted(want, key=str)
    by_source = drawn.groupBy("source").agg(F.sum(F.col("size") * F.size("draws")).alias("taken"), F.first("target").alias("target"),
                                            F.max("size").alias("longest"), F.sum("size").alias("size")).collect()
    for r in by_source:
        assert r.target <= 3 * r["size"] + 1e-9
        if kind == "many":
            assert abs(r.taken - r.target) <= r.longest / 2 + 1
    assert abs(sum(r.target for r in by_source) - sum(r["size"] for r in by_source)) < 1e-6 * max(1, sum(r["size"] for r in by_source))
    assert all(len(r.draws) <= 3 and len({d.pass_no for d in r.draws}) == len(r.draws) for r in drawn.select("draws").collect())
    mixed = mixing.mix(docs, block_words=block_words, shard_blocks=3)
    assert mixed.columns == docs.columns
    assert mixed.count() == drawn.agg(F.sum(F.size("draws"))).first()[0] or not rows
    drawn.unpersist()


def test_reruns_agree(spark):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows_of("many")], DOCS)
    draws = [sorted(mixing.draw(d, block_words=300).select("doc_id", F.col("draws").cast("string")).collect()) for d in (docs, docs.repartition(7))]
    assert draws[0] == draws[1]


def test_shards_take_even_parts_of_each_source(spark):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows_of("many")], DOCS)
    sources, draws, shards = mixing.plan_mix(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), block_words=10, shard_blocks=40)
    counts = draws.groupBy("shard").count().toPandas()
    assert len(counts) == shards > 5 and counts["count"].max() - counts["count"].min() <= 2
    hot = draws.where("key = '1hot'").groupBy("shard").count().toPandas()
    even = hot["count"].sum() / shards  # about as many shards go without as drawing at random leaves
    assert abs(len(hot) / shards - (1 - np.exp(-even))) < 0.15 and hot["count"].max() < 5 * even
    assert draws.count() == draws.select("key", "block", "pass_no").distinct().count()


def test_tree_is_exact_and_reproducible():
    quotas = np.array([1000, 0, 3, 500, 77])
    leaves = list(mixing.split_quotas(quotas, 0 * quotas, 0, 13, 5, 1))
    assert [x[0] for x in leaves] == list(range(13))
    assert (sum(x[2] for x in leaves) == quotas).all()
    ends = np.zeros(5, int)
    for _, _, q, o in leaves:
        assert (o == ends).all()
        ends += q
    assert max(x[2].sum() for x in leaves) - min(x[2].sum() for x in leaves) <= 1
    again = [y for lo, hi, q, o in mixing.split_quotas(quotas, 0 * quotas, 0, 13, 5, 4) for y in mixing.split_quotas(q, o, lo, hi, 5, 1)]
    assert all(a[0] == b[0] and (a[2] == b[2]).all() and (a[3] == b[3]).all() for a, b in zip(leaves, again))


def test_targets_reshare_the_excess(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10), ("d", 500), (None, 0)], "source string, source_size long")
    got = {r.source: (r.weight, r.target) for r in mixing.targets(sizes).collect()}
    assert [got[s][0] for s in ("a", "b", "c", "d", None)] == [1, 2, 3, 1, 2]
    assert got["b"][1] == 30 and got["c"][1] == 30 and got[None][1] == 0 and got["a"][1] == got["d"][1] == 730
