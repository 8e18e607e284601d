"""Embedding near-duplicates by an exact metric range join.

Unit vectors with cosine c are sqrt(2 - 2c) apart. Pivots cut the space into cells of nearest pivots; a vector is
copied to each other cell that may hold a partner, by the triangle inequality; then each cell finds the links of its
own vectors alone. Cells with many vectors are worked through in blocks, so no task holds a cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sluice.llm.components import components
from sluice.llm.text import first_by_hash
from sluice.llm.vectors import lengths, packed, stacked, unit, width_of
from sluice.workdir import materialize

#: Distinct vectors for which one more pivot is taken, and the pivots that every task gets at most.
CELL_ROWS, MOST_PIVOTS = 4096, 1024
#: Vectors of either side that meet in one task.
BLOCK_ROWS = 2048
#: Rounding allowed for in distances; pairs this near the limit are judged by their own cosine.
SLACK = 1e-9


def assign(vectors: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home cell of each unit vector, row and cell of each copy to another cell).

    If y within ``radius`` of x has home p, then d(y, p) <= d(y, h) for x's home h, and the triangle inequality
    gives d(x, p) - d(x, h) <= 2 radius. In Euclidean space x is then also within ``radius`` of the plane between h
    and p: d(x, p)^2 - d(x, h)^2 <= 2 radius d(h, p), which is never weaker. x is copied to the cells that meet both.
    """
    squared = np.maximum(2 - 2 * vectors @ pivots.T, 0)
    home = squared.argmin(axis=1)
    near = squared[np.arange(len(vectors)), home]
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))[home]
    reach = (squared - near[:, None] <= 2 * radius * apart + SLACK) & (np.sqrt(squared) - np.sqrt(near)[:, None] <= 2 * radius + SLACK)
    reach[np.arange(len(vectors)), home] = False
    row, cell = np.nonzero(reach)
    return home, row, cell


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least index that each of ``n`` points reaches by links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def block_links(homes: pd.DataFrame, members: pd.DataFrame, kind: str, least: float) -> pd.DataFrame:
    """node, n (copies of other nodes linked to a home here) and root (least node of its links here)."""
    a, b = stacked(homes.vec, kind), stacked(members.vec, kind)
    linked = unit(a) @ unit(b).T
    close = np.argwhere(np.abs(linked - least) < 1e-9)
    if len(close):
        i, j = close.T
        linked[i, j] = np.einsum("ij,ij->i", a[i], b[j]) / (lengths(a)[i] * lengths(b)[j])
    mask = (linked >= least) & (homes.node.to_numpy()[:, None] != members.node.to_numpy()[None, :])
    i, j = np.nonzero(mask)
    if not len(i):
        return pd.DataFrame({"node": [], "n": [], "root": []}, dtype="int64")
    names, index = np.unique(np.concatenate([homes.node.to_numpy()[i], members.node.to_numpy()[j]]), return_inverse=True)
    roots = names[local_roots(index[:len(i)], index[len(i):], len(names))]
    counts = np.zeros(len(names), np.int64)
    np.add.at(counts, index[:len(i)], members.copies.to_numpy()[j])
    return pd.DataFrame({"node": names, "n": counts, "root": roots})


def near_vectors(df: DataFrame, least: float = 0.98, key: str = "vec_id", vector: str = "embedding", within: str = "label",
                 cell_rows: int = CELL_ROWS, most_pivots: int = MOST_PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``key``, n_links, component_id and kept of each row of ``df``.

    Rows whose ``within`` is equal and not null are linked if the cosine of their vectors, in double precision, is
    ``least`` or more. n_links counts the other rows linked directly, component_id is the smallest key that links
    reach, kept tells that it is the row's own. Vectors that are null, empty, zero or hold null or non-finite
    components, and vectors of different lengths, link with nothing. Copies of a vector are one node with a count,
    never pairs; links inside a block come back as a count and one root for each node, never pairs either. Pivots,
    the first in the order of a hash, are one for ``cell_rows`` nodes up to ``most_pivots``: these alone reach the
    driver and all tasks. A cell of any size is dealt over pairs of blocks of ``block_rows`` rows.
    Rows with a null key count as links; their component_id is null if no other key is reached.
    """
    kind = width_of(df, vector)
    rows = materialize(df.select(F.col(key).alias("key"), F.col(within).alias("part"), packed(df, vector).alias("vec")), "vectors")
    valid = rows.where("vec is not null and part is not null")
    nodes = materialize(valid.groupBy("part", "vec").agg(F.min("key").alias("first_key"), F.count("*").alias("copies"))
                             .withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    n = nodes.count()
    chosen = first_by_hash(nodes.select("vec").distinct(), n, min(most_pivots, max(1, math.ceil(n / cell_rows))), "vec")
    pivots: dict[int, np.ndarray] = {}
    for size, some in _by_size(chosen.toPandas().vec):
        pivots[size] = unit(stacked(some, kind))
    radius = math.sqrt(2 - 2 * least) + SLACK

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            for size, vecs in _by_size(some.vec):
                own = some.loc[vecs.index]
                if size not in pivots:
                    yield own.assign(cell=0, size=size, home=True)
                    continue
                home, row, cell = assign(unit(stacked(vecs, kind)), pivots[size], radius)
                yield own.assign(cell=home, size=size, home=True)
                for at in range(0, len(row), 8192):
                    yield own.iloc[row[at:at + 8192]].assign(cell=cell[at:at + 8192], size=size, home=False)

    part = nodes.schema["part"].dataType.simpleString()
    placed = nodes.select("part", "vec", "copies", "node").mapInPandas(
        cells, f"part {part}, vec binary, copies long, node long, cell int, size int, home boolean")
    placed = materialize(placed, "vector-cells")
    sizes = (placed.groupBy("part", "size", "cell").agg(F.count_if("home").alias("n_home"), F.count("*").alias("n_all"))
                   .where("n_home > 0 and n_all > 1")
                   .select("part", "size", "cell", F.ceil(F.col("n_home") / block_rows).alias("home_blocks"), F.ceil(F.col("n_all") / block_rows).alias("all_blocks")))
    at = ["part", "size", "cell"]
    placed = placed.join(sizes, at)
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    count_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    homes = placed.where("home").withColumn("i", block("home_blocks")).withColumn("j", count_to("all_blocks"))
    members = placed.withColumn("j", block("all_blocks")).withColumn("i", count_to("home_blocks"))
    by = [*at, "i", "j"]

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return block_links(a, b, kind, least)

    found = (homes.select(*by, "node", "vec").groupBy(*by).cogroup(members.select(*(F.col(c).alias(c) for c in (*by, "node", "vec", "copies"))).groupBy(*by))
                  .applyInPandas(meet, "node long, n long, root long"))
    found = materialize(found, "vector-links")
    roots = components(found.where("node != root").select("node", "root"), "vector-components")
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    rooted = materialize(nodes.join(links, "node", "left").join(roots, "node", "left")
                              .select("part", "vec", "first_key", F.coalesce("root", "node").alias("root"),
                                      (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-roots")
    ids = rooted.groupBy("root").agg(F.min("first_key").alias("component_id"))
    facts = rooted.join(ids, "root").select("part", "vec", "n_links", "component_id")
    joined = valid.join(facts, ["part", "vec"]).select("key", "n_links", "component_id")
    alone = rows.where("vec is null or part is null").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return joined.unionByName(alone).select(F.col("key").alias(key), "n_links", "component_id",
                                            F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def _by_size(vecs: pd.Series) -> Iterator[tuple[int, pd.Series]]:
    sizes = vecs.map(len)
    for size in sorted(sizes.unique()):
        yield int(size), vecs[sizes == size]
