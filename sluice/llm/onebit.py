"""Approximate nearest neighbours by randomly rotated one-bit codes with error bounds.

A unit vector is rotated and only the signs of its components are kept, with the inner product f of the rotated
vector and its sign vector (scaled to length 1). For a rotated query q the inner product of the vectors is estimated
by <signs, q> / f, and misses it by more than e * sqrt((1 - f^2) / f^2 / (dim - 1)) only rarely, for e the bound's
width. Only vectors whose upper bound reaches a query's threshold are compared with it exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sluice.llm.text import first_by_hash
from sluice.llm.vectors import lengths, packed, stacked, unit, width_of
from sluice.workdir import materialize

#: Width of the error bound in standard errors; one in some hundred true neighbours is missed.
WIDTH = 2.7
#: Candidates and queries that meet in one task, and rows whose exact nearness gives the first thresholds.
BLOCK_ROWS, QUERY_ROWS, SAMPLE_ROWS = 1024, 1024, 2048


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([seed, dim])).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed sign bits, correction scalar f) of unit vectors."""
    turned = vectors @ turn.T
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(turn.shape[0])


def estimates(codes: np.ndarray, factors: np.ndarray, turned: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """(estimated inner products of all codes with all rotated unit queries, half width of each code's bound)."""
    dim = turned.shape[1]
    signs = (np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1) / math.sqrt(dim)
    error = width * np.sqrt(np.maximum(1 - factors ** 2, 0) / factors ** 2 / max(dim - 1, 1))
    return (signs @ turned.T.astype(np.float32)) / factors[:, None].astype(np.float32), error + 1e-6


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows with rows in double precision."""
    return np.einsum("ij,ij->i", a, b) / (lengths(a) * lengths(b))


def best(queries: np.ndarray, rows: np.ndarray, scores: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's ``k`` best of scored pairs, ties to the smaller key."""
    order = np.lexsort((rows, keys, -scores, queries))
    rank = np.arange(len(order)) - np.searchsorted(queries[order], queries[order], side="left")
    return order[rank < k]


def search_block(items: pd.DataFrame, queries: pd.DataFrame, kind: str, k: int, width: float, seed: int) -> pd.DataFrame:
    """Each query's nearest rows of one block, of those that may reach its threshold."""
    dim = len(queries.vec.iloc[0]) // int(kind[2]) if len(queries) else 0
    empty = pd.DataFrame({"query": [], "row": [], "key": [], "score": []}).astype({"query": "int64", "row": "int64", "key": "Int64", "score": "float64"})
    if not len(items) or not len(queries):
        return empty
    codes = np.frombuffer(b"".join(items.code), np.uint8).reshape(len(items), -1)
    asked, held = stacked(queries.vec, kind), stacked(items.vec, kind)
    guess, error = estimates(codes, items.factor.to_numpy(), unit(asked) @ rotation(dim, seed).T, width)
    may = (guess + error[:, None] >= queries.threshold.to_numpy()[None, :]) & (items.row.to_numpy()[:, None] != queries.row.to_numpy()[None, :])
    i, j = np.nonzero(may)
    score = np.concatenate([exact(held[i[at:at + 65536]], asked[j[at:at + 65536]]) for at in range(0, max(1, len(i)), 65536)])
    enough = score >= queries.threshold.to_numpy()[j]
    i, j, score = i[enough], j[enough], score[enough]
    keys = items.key.astype("Int64").fillna(np.iinfo(np.int64).max).to_numpy(np.int64)
    top = best(j, items.row.to_numpy()[i], score, keys[i], k)
    return pd.DataFrame({"query": queries.row.to_numpy()[j[top]], "row": items.row.to_numpy()[i[top]],
                         "key": items.key.astype("Int64").iloc[i[top]].array, "score": score[top]}) if len(top) else empty


def nearest(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", width: float = WIDTH, seed: int = 11,
            block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, ``key`` and score: for each row of ``df`` that ``is_query`` its ``k`` nearest other rows found.

    Score is the cosine of the original vectors in double precision; nearest first, ties to the smaller key (null
    keys last). Every row is coded and every code is compared with every query, in blocks of bounded rows that
    meet in one task each. A query's first threshold is its k-th best exact score in a sample of ``sample_rows``
    rows (the first by a hash; these alone are broadcast), so later few rows pass. Vectors that are null, empty,
    zero or hold null or non-finite components take no part; vectors of different lengths are not compared.
    Repeated rows are candidates each for themselves; a query with fewer candidates gets all of them.
    """
    kind = width_of(df, vector)
    octets = int(kind[2])

    @F.pandas_udf("code binary, factor double")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vecs in batches:
            out = pd.DataFrame({"code": pd.Series([b""] * len(vecs), dtype=object), "factor": 1.0})
            sizes = vecs.map(len)
            for size in sizes.unique():
                where = np.flatnonzero(sizes == size)
                bits, factors = encode(unit(stacked(vecs.iloc[where], kind)), rotation(size // octets, seed))
                out.loc[where, "code"] = pd.Series([b.tobytes() for b in bits], index=where, dtype=object)
                out.loc[where, "factor"] = factors
            yield out

    taking = df.select(F.col(key).cast("long").alias("key"), F.coalesce(is_query, F.lit(False)).alias("asks"), packed(df, vector).alias("vec")).where("vec is not null")
    rows = (taking.withColumn("c", coded("vec")).select("key", "asks", "vec", "c.code", "c.factor", F.octet_length("vec").alias("size"),
                                                        F.monotonically_increasing_id().alias("row")))
    rows = materialize(rows, "one-bit-codes")
    n, n_queries = rows.agg(F.count("*"), F.count_if("asks")).first()
    blocks, query_blocks = max(1, math.ceil(n / block_rows)), max(1, math.ceil(n_queries / query_rows))
    sample = first_by_hash(rows.select("row", "vec"), n, sample_rows, "vec", "row").toPandas()

    @F.pandas_udf("double")
    def threshold(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for vecs, own in batches:
            out = np.full(len(vecs), -np.inf)
            sizes = vecs.map(len).to_numpy()
            for size in np.unique(sizes):
                where, some = np.flatnonzero(sizes == size), sample[sample.vec.map(len) == size]
                if len(some) > k:
                    scores = unit(stacked(vecs.iloc[where], kind)) @ unit(stacked(some.vec, kind)).T
                    scores[own.to_numpy()[where][:, None] == some.row.to_numpy()[None, :]] = -np.inf
                    out[where] = np.partition(scores, -k, axis=1)[:, -k] - 1e-9
            yield pd.Series(out)

    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = materialize(rows.where("asks").select("key", "row", "size", "vec", threshold("vec", "row").alias("threshold")), "one-bit-queries")
    by = ["size", "block", "query_block"]
    items = rows.withColumn("block", deal(blocks)).withColumn("query_block", each(query_blocks))
    queries = asked.withColumn("query_block", deal(query_blocks)).withColumn("block", each(blocks))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return search_block(a, b, kind, k, width, seed)

    found = (items.select(*by, "row", "key", "vec", "code", "factor").groupBy(*by)
                  .cogroup(queries.select(*by, "row", "vec", "threshold").groupBy(*by))
                  .applyInPandas(meet, "query long, row long, key long, score double"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("key"), "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = asked.select(F.col("row").alias("query"), F.col("key").alias("query_id"))
    return ranked.join(names, "query").select("query_id", "rank", F.col("key").alias(key), "score")
