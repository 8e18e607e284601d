"""Exact nearest neighbours by cells of a k-d tree, k-NN classification and SMOTE.

Reference rows with equal vectors are one, with the ids that can be among the k nearest. A sample of the
vectors gives a tree whose leaves are cells of a bounded number of vectors. A query is first searched in its own cell,
by a second tree inside the task; the distance of the k-th neighbour found there rules out every other cell
whose box lies further away. So in few dimensions most queries are settled by one cell, and the work grows with
the rows. Busy cells serve their queries in several tasks, and at most k rows a query and cell leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import Column, DataFrame, Window, functions as F

from sluice import workdir
from sluice.functions import ranking

#: Distinct vectors of a cell, less where they have many components.
BLOCK_ROWS = 32_000
QUERIES_PER_TASK = 50_000
_CELL_VALUES = 1_000_000
_SAMPLE_PER_CELL = 64
_SAMPLE_VALUES = 8_000_000
_LEAF_ROWS = 256
_BATCH = 512
_MOST_FOUND = 1 << 19

_NEAR = "array<struct<dist:double,rid:string,rtag:int>>"
_NEAR_TYPE = pa.struct([("dist", pa.float64()), ("rid", pa.string()), ("rtag", pa.int32())])


def _matrix(vectors: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    if not len(vectors):
        return np.zeros((0, 0))
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return pc.list_flatten(vectors).to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed one dimension after the other so that results repeat."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d = a[:, j, None] - b[None, :, j]
        d *= d
        out += d
    return out


def _gap(low: np.ndarray, high: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least distance of each of the boxes (low, high) to each of the boxes (lo, hi)."""
    out = np.zeros((len(low), len(lo)))
    for j in range(low.shape[1]):
        d = np.maximum(lo[None, :, j] - high[:, j, None], low[:, j, None] - hi[None, :, j])
        np.maximum(d, 0, out=d)
        d *= d
        out += d
    return np.sqrt(out)


def _reach(bound: np.ndarray) -> np.ndarray:
    # A hair of slack covers rounding in the distances.
    return bound * (1 + 1e-9) + 1e-9


class _Tree:
    """A k-d tree of some points: left of a node are those with at most its cut in its dimension, the one that varies most."""

    def __init__(self, points: np.ndarray, leaf_rows: int):
        dim, cut, kids, self.rows = [], [], [], []
        todo = [(np.arange(len(points)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            node = len(dim)
            if parent >= 0:
                kids[parent][side] = node
            some, at, value = points[rows], -1, 0.0
            if len(rows) > leaf_rows:
                with np.errstate(over="ignore", invalid="ignore"):
                    spread = np.where(some.max(axis=0) > some.min(axis=0), np.nan_to_num(some.std(axis=0), nan=np.inf), -1.0)
                at = int(spread.argmax()) if spread.max(initial=-1.0) >= 0 else -1
            dim.append(at)
            kids.append([0, 0])
            if at < 0:
                kids[node][0] = len(self.rows)
                self.rows.append(rows)
            else:
                x = some[:, at]
                value = np.partition(x, (len(x) - 1) // 2)[(len(x) - 1) // 2]
                if value == x.max():
                    value = x[x < value].max()
                todo += [(rows[x <= value], node, 0), (rows[x > value], node, 1)]
            cut.append(value)
        self.dim, self.cut, self.kids = np.array(dim), np.array(cut, dtype=float), np.array(kids)

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        inner = np.arange(len(points)) if self.dim[0] >= 0 else np.zeros(0, dtype=np.int64)
        while len(inner):
            at = node[inner]
            node[inner] = self.kids[at, (points[inner, self.dim[at]] > self.cut[at]).astype(int)]
            inner = inner[self.dim[node[inner]] >= 0]
        return self.kids[node, 0]


def _runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(sorted_values)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(sorted_values)]) if len(sorted_values) else iter(())


def _first(k: int, q: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of rows in ``order``, by query, the first k of each."""
    q = q[order]
    start = np.append(True, q[1:] != q[:-1])[:len(q)]
    place = np.arange(len(q)) - np.flatnonzero(start)[np.cumsum(start) - 1]
    return order[place < k]


class _Block:
    """Different vectors, in leaves of a tree of their own. Of equally distant ones those of lesser ``rank`` are nearer."""

    def __init__(self, m: np.ndarray, rank: np.ndarray, k: int):
        self.tree = _Tree(m, max(_LEAF_ROWS, 4 * k))
        self.row = np.concatenate(self.tree.rows)
        self.m, self.rank, self.k = m[self.row], rank[self.row], k
        self.end = np.cumsum([len(r) for r in self.tree.rows])
        self.start = self.end - [len(r) for r in self.tree.rows]
        self.lo, self.hi = np.minimum.reduceat(self.m, self.start), np.maximum.reduceat(self.m, self.start)

    def nearest(self, q: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) of the k nearest vectors of each query, none further than its ``bound``."""
        leaf = self.tree.leaf_of(q)
        order, out = np.argsort(leaf, kind="stable"), []
        for a, b in _runs(leaf[order]):
            for i in range(a, b, _BATCH):
                at = order[i:min(i + _BATCH, b)]
                found = self._nearest_of(q[at], bound[at].copy(), int(leaf[order[a]]))
                out.append((at[found[0]], self.row[found[1]], found[2]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def _nearest_of(self, q: np.ndarray, bound: np.ndarray, home: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def look(leaf: int, some: np.ndarray) -> None:
            d = np.sqrt(_squared(q[some], self.m[self.start[leaf]:self.end[leaf]]))
            if leaf == home and d.shape[1] >= self.k:
                bound[some] = np.fmin(bound[some], np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
            i, j = np.nonzero((d <= bound[some, None]) & np.isfinite(d))
            more.append((some[i], j + self.start[leaf], d[i, j]))

        def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            i, j, d = (np.concatenate(x) for x in zip(found, *more))
            more.clear()
            kept = _first(self.k, i, np.lexsort((self.rank[j], d, i)))
            i, j, d = i[kept], j[kept], d[kept]
            full = np.flatnonzero(np.bincount(i, minlength=len(q)) == self.k)
            last = np.append(i[1:] != i[:-1], True)[:len(i)]
            furthest = np.full(len(q), np.inf)
            furthest[i[last]] = d[last]
            bound[full] = np.minimum(bound[full], furthest[full])
            return i, j, d

        look(home, np.arange(len(q)))
        found = best()
        gaps = _gap(q.min(axis=0)[None], q.max(axis=0)[None], self.lo, self.hi)[0]
        for leaf in np.argsort(gaps, kind="stable"):
            if gaps[leaf] > _reach(bound.max()):
                break
            if leaf != home:
                some = np.flatnonzero(_gap(q, q, self.lo[leaf:leaf + 1], self.hi[leaf:leaf + 1])[:, 0] <= _reach(bound))
                if len(some):
                    look(int(leaf), some)
                    if sum(len(x[0]) for x in more) > 2 * self.k * len(q):
                        found = best()
        return best()


def _usable(vec: str = "vec") -> Column:
    """Vectors with a missing or infinite component are near nothing."""
    inside = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(inside, F.lit(False)) & F.col("grp").isNotNull()


def _with_cell(trees: Mapping[str, tuple[_Tree, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of the groups that have a tree, with the number of their cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, cell = _matrix(batch["vec"]), np.full(batch.num_rows, -1, dtype=np.int32)
            names = pc.dictionary_encode(batch["grp"])
            code = names.indices.to_numpy(zero_copy_only=False)
            for i, name in enumerate(names.dictionary.to_pylist()):
                if name in trees:
                    at = np.flatnonzero(code == i)
                    tree, first = trees[name]
                    cell[at] = tree.leaf_of(m[at]) + first
            made = pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])
            yield made.filter(pa.array(cell >= 0))

    return run


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Extremes of the vectors of each cell in a batch."""
    for batch in batches:
        if batch.num_rows:
            cell, m = batch["cell"].to_numpy(), _matrix(batch["vec"])
            order = np.argsort(cell, kind="stable")
            starts = np.array([a for a, _ in _runs(cell[order])])
            lo, hi = np.minimum.reduceat(m[order], starts), np.maximum.reduceat(m[order], starts)
            yield pa.RecordBatch.from_arrays([pa.array(cell[order][starts]), pa.array(lo.tolist(), pa.list_(pa.float64())),
                                              pa.array(hi.tolist(), pa.list_(pa.float64()))], names=["cell", "lo", "hi"])


def _cell_boxes(celled: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, lo, hi) of all cells."""
    parts = celled.select("cell", "vec").mapInArrow(_boxes, "cell int, lo array<double>, hi array<double>")

    def over(name: str, pick: Callable[[Column, Column], Column]) -> Column:
        lists = F.collect_list(name)
        return F.reduce(lists, F.get(lists, F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: pick(x, y))).alias(name)

    found = parts.groupBy("cell").agg(over("lo", F.least), over("hi", F.greatest)).orderBy("cell").collect()
    return (np.array([r["cell"] for r in found], dtype=np.int64), np.array([r["lo"] for r in found]), np.array([r["hi"] for r in found]))


def _probe_cell(k: int, exclude_self: bool, cells: Mapping[int, tuple[np.ndarray, np.ndarray, np.ndarray]] | None):
    """The k nearest of each query in one cell; with ``cells`` also what other cells of its group may hold nearer ones."""
    many = k + 1 if exclude_self else k

    def run(queries: pa.Table, refs: pa.Table) -> pa.Table:
        n = queries.num_rows
        q, bound = _matrix(queries["vec"]), queries["bound"].to_numpy()
        ids = queries["id"].combine_chunks()
        of, rid, tag, dist = np.zeros(0, dtype=np.int64), pa.array([], pa.string()), np.zeros(0, dtype=np.int32), np.zeros(0)
        if n and refs.num_rows:
            held = refs["ids"].combine_chunks()
            rids, tags = pc.list_flatten(held), pc.list_flatten(refs["tags"].combine_chunks()).to_numpy()
            rank = np.empty(len(rids), dtype=np.int64)
            rank[pc.sort_indices(rids).to_numpy()] = np.arange(len(rids))
            size = pc.list_value_length(held).to_numpy()
            start = np.cumsum(size) - size
            i, row, d = _Block(_matrix(refs["vec"]), rank[start], many).nearest(q, bound)
            times = size[row]
            item = np.repeat(start[row] - np.cumsum(times) + times, times) + np.arange(times.sum())
            i, d = np.repeat(i, times), np.repeat(d, times)
            order = _first(many, i, np.lexsort((rank[item], d, i)))
            if exclude_self:
                own = pc.equal(rids.take(pa.array(item[order])), ids.take(pa.array(i[order]))).to_numpy(zero_copy_only=False)
                order = order[~own]
                order = _first(k, i, order)
            of, dist, item = i[order], d[order], item[order]
            rid, tag = rids.take(pa.array(item)), tags[item]
        many_of = np.bincount(of, minlength=n)
        offsets = np.append(0, np.cumsum(many_of))
        near = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(dist), rid, pa.array(tag, pa.int32())], fields=list(_NEAR_TYPE)))
        if cells is None:
            return pa.table({"id": ids, "near": near})
        full = many_of == k
        bound = bound.copy()
        bound[full] = np.minimum(bound[full], dist[offsets[1:][full] - 1])
        further, at = [], np.zeros(n + 1, dtype=np.int64)
        if n:
            at[1:], further = _further(q, bound, int(queries["cell"][0].as_py()), cells)
        open_ = pa.array(at[1:] > at[:-1])
        cell = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.array(further, dtype=np.int32)))
        vec = pc.if_else(open_, queries["vec"].combine_chunks(), pa.scalar(None, queries["vec"].type)) if n else queries["vec"].combine_chunks()
        return pa.table({"id": ids, "vec": vec, "near": near, "bound": pa.array(bound), "further": cell})

    return run


def _further(q: np.ndarray, bound: np.ndarray, home: int,
             cells: Mapping[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(ends of the lists, other cells) within reach of each query."""
    number, lo, hi = cells[home]
    order = _Tree(q, _BATCH).rows  # queries near each other share a first, coarse look at the cells
    query, cell = [], []
    for at in order:
        low, high = q[at].min(axis=0)[None], q[at].max(axis=0)[None]
        for c in np.flatnonzero(_gap(low, high, lo, hi)[0] <= _reach(bound[at].max())):
            if number[c] != home:
                hit = at[_gap(q[at], q[at], lo[c:c + 1], hi[c:c + 1])[:, 0] <= _reach(bound[at])]
                query.append(hit)
                cell.append(np.full(len(hit), number[c]))
    if not query:
        return np.zeros(len(q), dtype=np.int64), np.zeros(0, dtype=np.int32)
    query, cell = np.concatenate(query), np.concatenate(cell)
    return np.cumsum(np.bincount(query, minlength=len(q))), cell[np.argsort(query, kind="stable")]


def _probe(queries: DataFrame, refs: DataFrame, search: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``search`` for each cell with queries; cells with very many serve them in several turns."""
    load = queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES_PER_TASK).alias("turns")).where("turns > 1")
    load = F.broadcast(workdir.materialize(load, "knn-load"))
    turns = F.coalesce(F.col("turns"), F.lit(1)).cast("int")
    served = refs.join(load, "cell", "left").select("vec", "ids", "tags", "cell", F.explode(F.sequence(F.lit(0), turns - 1)).alias("turn"))
    asking = queries.join(load, "cell", "left").select("id", "vec", "cell", "bound", F.pmod(F.xxhash64("id"), turns).cast("int").alias("turn"))
    return asking.groupBy("cell", "turn").cogroup(served.groupBy("cell", "turn")).applyInArrow(search, schema)


def _distinct(refs: DataFrame, k: int) -> DataFrame:
    """(grp, vec, ids, tags): different vectors, with the first ids that have them, k at most.

    Rows of one vector are as near as each other, so only the first k ids can be among the k nearest. Each task passes
    on that many of a vector.
    """
    keyed = refs.withColumn("_h", F.xxhash64("grp", "vec"))
    first = Window.partitionBy("_h", "grp", "vec").orderBy("id")
    kept = keyed.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k)
    held = kept.groupBy("_h", "grp", "vec").agg(F.array_sort(F.collect_list(F.struct("id", "tag"))).alias("_held"))
    return held.select("grp", "vec", F.col("_held.id").alias("ids"), F.col("_held.tag").alias("tags"))


def _trees(refs: DataFrame, n: int, cell_rows: int, dims: int) -> dict[str, tuple[_Tree, int]]:
    """Per group a tree over a sample of its vectors, chosen by hash, and the number of its first cell."""
    share = min(_SAMPLE_PER_CELL / cell_rows, _SAMPLE_VALUES / max(1, dims) / n, 1.0)
    names = [r["grp"] for r in refs.select("grp").distinct().orderBy("grp").collect()]
    chosen = refs.where(F.pmod(F.xxhash64("vec", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample: dict[str, list] = {name: [] for name in names}
    for r in chosen.select("grp", "vec").collect():
        sample[r["grp"]].append(r["vec"])
    trees, first = {}, 0
    for name in names:
        tree = _Tree(np.array(sorted(sample[name]), dtype=float).reshape(-1, dims), max(1, round(share * cell_rows)))
        trees[name] = (tree, first)
        first += len(tree.rows)
    return trees


def nearest(queries: DataFrame, refs: DataFrame, k: int, exclude_self: bool = False,
            block_rows: int | None = None) -> DataFrame:
    """(id, near): the exact k nearest reference rows of each query, nearest first, of equally near ones those of lesser id.

    Both frames hold ``grp`` (neighbours are sought in the same group), ``id``, unique, ``vec`` and ``tag``.
    """
    queries, refs = queries.selectExpr(*_select()[:3]), refs.selectExpr(*_select())
    refs = workdir.materialize(_distinct(refs.where(_usable()), k + 1 if exclude_self else k), "knn-vectors")
    n = refs.count()
    if n == 0:
        return queries.select("id", F.expr(f"cast(array() as {_NEAR})").alias("near"))
    dims = refs.select(F.max(F.size("vec"))).first()[0]
    cell_rows = block_rows or max(1_000, min(BLOCK_ROWS, _CELL_VALUES // max(1, dims)))
    trees = _trees(refs, n, cell_rows, dims)
    celled = workdir.materialize(refs.mapInArrow(_with_cell(trees), "grp string, vec array<double>, ids array<string>, tags array<int>, cell int"), "knn-cells")
    number, lo, hi = _cell_boxes(celled)
    cells = {}
    for tree, first in trees.values():
        own = (number >= first) & (number < first + len(tree.rows))
        cells |= dict.fromkeys(range(first, first + len(tree.rows)), (number[own], lo[own], hi[own]))
    homes = queries.where(_usable()).mapInArrow(_with_cell(trees), "grp string, id string, vec array<double>, cell int")
    homes = workdir.materialize(homes.select("id", "vec", "cell", F.lit(float("inf")).alias("bound")), "knn-home")
    first = workdir.materialize(_probe(homes, celled, _probe_cell(k, exclude_self, cells),
                                       f"id string, vec array<double>, near {_NEAR}, bound double, further array<int>"), "knn-first")
    settled, rest = first.where(F.size("further") == 0), first.where(F.size("further") > 0)
    asking = rest.select("id", "vec", "bound", F.explode("further").alias("cell"))
    more = _probe(asking, celled, _probe_cell(k, exclude_self, None), f"id string, near {_NEAR}")
    merged = rest.select("id", "near").unionByName(more).groupBy("id").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return settled.select("id", "near").unionByName(merged).where(F.size("near") > 0)


def _select() -> list[str]:
    return ["cast(grp as string) as grp", "cast(id as string) as id", "vec", "cast(tag as int) as tag"]


def vote(near: Column, n_classes: int) -> Column:
    """Class shares of the neighbours weighted by 1/distance; at distance 0 only those rows count."""
    exact = F.exists(near, lambda e: e["dist"] == 0)
    weights = F.transform(near, lambda e: F.struct(e["rtag"].alias("c"), F.when(
        exact, (e["dist"] == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), e["dist"])).alias("w")))
    sums = F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda c: F.aggregate(
        F.filter(weights, lambda e: e["c"] == c), F.lit(0.0), lambda acc, e: acc + e["w"]))
    total = F.aggregate(sums, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(sums, lambda s: s / total)


class KnnClassifier(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Distance-weighted k nearest neighbours. Fitting writes the reference rows as a table."""

    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)
    idCol = Param(Params._dummy(), "idCol", "unique row id", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "class index", TypeConverters.toString)
    nClasses = Param(Params._dummy(), "nClasses", "number of classes", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, k: int = 11, idCol: str = "row_id", labelCol: str = "label_index", nClasses: int = 2):
        super().__init__()
        self._setDefault(k=11, idCol="row_id", labelCol="label_index", nClasses=2)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> KnnModel:
        spark = dataset.sparkSession
        path = workdir.new_path(spark, "knn-model")
        _vectors(dataset, self.getOrDefault("idCol"), self.getOrDefault("labelCol")).write.parquet(path)
        return KnnModel(path=path, **{p: self.getOrDefault(p) for p in ("k", "idCol", "nClasses")})


class KnnModel(Model, MLWritable, MLReadable):
    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)
    idCol = Param(Params._dummy(), "idCol", "unique row id", TypeConverters.toString)
    nClasses = Param(Params._dummy(), "nClasses", "number of classes", TypeConverters.toInt)
    path = Param(Params._dummy(), "path", "table of reference rows", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, path: str = "", k: int = 11, idCol: str = "row_id", nClasses: int = 2):
        super().__init__()
        self._setDefault(k=11, idCol="row_id", nClasses=2, path="")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rid = self.getOrDefault("idCol")
        refs = dataset.sparkSession.read.parquet(self.getOrDefault("path"))
        found = nearest(_vectors(dataset, rid, None), refs, self.getOrDefault("k"))
        p = found.select("id", vote(F.col("near"), self.getOrDefault("nClasses")).alias("_p"))
        joined = dataset.join(p, dataset[rid].cast("string") == p["id"]).drop("id")
        return joined.select(*dataset.columns, array_to_vector("_p").alias("probability"),
                             (F.array_position("_p", F.array_max("_p")) - 1).cast("double").alias("prediction"))


    def write(self) -> MLWriter:
        return _KnnWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _KnnReader()


class _KnnWriter(MLWriter):
    """Saves the reference rows with the model, so that it does not depend on scratch storage."""

    def __init__(self, model: KnnModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.sparkSession.read.parquet(self.model.getOrDefault("path")).write.parquet(f"{path}/rows")


class _KnnReader(MLReader):
    def load(self, path: str) -> KnnModel:
        model = KnnModel()
        DefaultParamsReader.getAndSetParams(model, DefaultParamsReader.loadMetadata(path, self.sparkSession))
        return model._set(path=f"{path}/rows")


def _vectors(df: DataFrame, rid: str, label: str | None) -> DataFrame:
    tag = F.col(label).cast("int") if label else F.lit(0)
    return df.select(F.lit("all").alias("grp"), F.col(rid).cast("string").alias("id"),
                     vector_to_array("features").alias("vec"), tag.alias("tag"))


def smote(df: DataFrame, label: str, row_id: str, vector: str = "vec", k: int = 3, seed: int = 42) -> DataFrame:
    """Adds synthetic rows until every class has as many as the largest one.

    A synthetic row lies between a row and one of its k nearest of the same class; which
    ones, and where between them, follows from a hash of seed, class and draw number.
    Returns label, id, vector; ids of synthetic rows start with ``synthetic``.
    """
    counts = ranking.group_counts(df, label)
    top = max(counts.values())
    short = {c: n for c, n in counts.items() if n < top}
    rows = df.select(label, F.col(row_id).cast("string").alias("id"), F.col(vector).alias("vec"))
    if not short:
        return rows
    if min(short.values()) <= k:
        raise ValueError(f"a class has no more than {k} rows; its rows have too few neighbours")
    minority = rows.where(F.col(label).isin(list(short)))
    points = minority.select(F.col(label).cast("string").alias("grp"), "id", "vec", F.lit(0).alias("tag"))
    near = nearest(points, points, k, exclude_self=True)
    ranked = ranking.with_group_rank(minority, label, ["id"], seed, "_rank").join(near, "id")
    kind = df.schema[label].dataType.simpleString()
    draws = reduce(DataFrame.unionByName, [df.sparkSession.range(1, top - n + 1).select(
        F.lit(c).cast(kind).alias("_c"), F.lit(n).cast("long").alias("_n"), F.col("id").alias("_draw")) for c, n in short.items()])
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_c").cast("string"), F.col("_draw").cast("string")))

    def part(at: int) -> Column:
        return F.conv(F.substring(h, at, 8), 16, 10).cast("long")

    draws = draws.select("_c", "_draw", (part(1) % F.col("_n") + 1).alias("_pick"), (part(9) % k).cast("int").alias("_which"),
                         (part(17).cast("double") / F.lit(2.0 ** 32)).alias("_u"))
    drawn = ranked.join(draws, (F.col(label) == F.col("_c")) & (F.col("_rank") == F.col("_pick")))
    drawn = drawn.withColumn("_rid", F.get("near", F.col("_which"))["rid"]).drop("near")
    others = minority.select(F.col(label).alias("_oc"), F.col("id").alias("_oid"), F.col("vec").alias("_other"))
    drawn = drawn.join(others, (F.col(label) == F.col("_oc")) & (F.col("_rid") == F.col("_oid")))
    other = F.col("_other")
    made = drawn.select(label, F.concat_ws("-", F.lit("synthetic"), F.col("_c").cast("string"), "_draw").alias("id"),
                        F.zip_with("vec", other, lambda a, b: a + F.col("_u") * (b - a)).alias("vec"))
    return rows.unionByName(made)


def knn_predict(queries: DataFrame, refs: DataFrame, k: int, n_classes: int, block_rows: int | None = None) -> DataFrame:
    """(id, prediction, probability) of k-NN over plain vector frames."""
    found = nearest(queries, refs, k, block_rows=block_rows)
    p = found.select("id", vote(F.col("near"), n_classes).alias("probability"))
    return p.select("id", (F.array_position("probability", F.array_max("probability")) - 1).cast("int").alias("prediction"),
                    "probability")
