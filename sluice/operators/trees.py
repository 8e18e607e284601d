"""Forests, extremely randomised trees and softmax boosting, grown level by level over blocks of rows.

All trees of a job grow together. For the open nodes of a level each block of rows adds up what its rows say: the range
of each tried feature and the sums left of a threshold drawn in it, or the sums by bin of the feature. Sums of all blocks
choose the splits. Weights, gradients and curvatures are whole numbers of a small unit, so sums do not depend on their
order, and a table small enough to be sent to every task gives the same trees there as level-wise jobs over a large one.

Every draw (rows of a tree, features of a node, thresholds) is a hash of the seed, the tree, the node and the row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, functions as F

from sluice import workdir

#: Sums that one job hands to the driver at most, rows of a block, and values (rows x features) of a table that is sent whole.
CELLS, BLOCK_ROWS, WHOLE = 1 << 21, 4096, 4 << 20
_UNIT = float(1 << 20)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def draw(*keys) -> np.ndarray:
    """Numbers from 0 to 1 that follow from whole numbers alone; arrays are broadcast."""
    out = np.uint64(0)
    with np.errstate(over="ignore"):
        for key in keys:
            out = (out ^ np.asarray(key).astype(np.int64).view(np.uint64)) + _MIX[0]
            out = (out ^ (out >> np.uint64(30))) * _MIX[1]
            out = (out ^ (out >> np.uint64(27))) * _MIX[2]
            out = out ^ (out >> np.uint64(31))
    return (out >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


@dataclass(frozen=True)
class Growth:
    """How trees grow. ``tries`` is the number of features a node draws, a share, "sqrt" or "log2" (0: all that ``columns`` leaves to the tree)."""

    random_cuts: bool = False
    boosted: bool = False
    depth: int = 18
    min_split: int = 2
    min_leaf: int = 1
    min_gain: float = 0.0
    tries: int | float | str = 0
    columns: float = 1.0
    rows: float = 1.0
    bootstrap: bool = False
    seed: int = 42
    rate: float = 1.0
    l1: float = 0.0
    l2: float = 0.0
    min_weight: float = 0.0


@dataclass
class Block:
    x: np.ndarray  # [row, feature]
    y: np.ndarray
    w: np.ndarray
    key: np.ndarray
    stop: np.ndarray  # rows that only tell boosting when to stop
    margin: np.ndarray | None = None  # [row, class]
    bins: np.ndarray | None = None

    def pull(self, classes: int) -> np.ndarray:
        """[row, class, gradient and curvature] of the log loss of the softmax of the margins, in whole units."""
        e = np.exp(self.margin - self.margin.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        own = np.arange(classes) == self.y[:, None]
        return np.rint(np.stack([p - own, np.maximum(2 * p * (1 - p), 1e-16)], axis=2) * self.w[:, None, None] * _UNIT)


@dataclass
class Trees:
    """Nodes of some trees in flat arrays; ``feature`` is -1 at leaves. ``path`` numbers a node within its tree."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray  # [node, class] or [node, 1]

    def leaves(self, x: np.ndarray, node: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The node each (start node, row) ends in."""
        node = node.copy()
        at = np.flatnonzero(self.feature[node] >= 0)
        while len(at):
            here = node[at]
            lower = x[row[at], self.feature[here]] <= self.threshold[here]
            node[at] = np.where(lower, self.left[here], self.right[here])
            at = at[self.feature[node[at]] >= 0]
        return node

    def sum(self, x: np.ndarray, group: int = 1) -> np.ndarray:
        """[row, value] of all trees added up; with ``group`` trees take turns in that many columns."""
        width = self.value.shape[1] if group == 1 else group
        out = np.zeros((len(x), width))
        row = np.arange(len(x))
        for t, root in enumerate(self.roots):
            found = self.value[self.leaves(x, np.full(len(x), root), row)]
            if group == 1:
                out += found
            else:
                out[:, t % group] += found[:, 0]
        return out


@dataclass
class Request:
    """Asks blocks for sums over the open nodes ``slots``: their totals, ranges, sums left of cuts, or sums by bin."""

    kind: str
    growth: Growth
    trees: Sequence[int]
    classes: int
    state: Trees
    slots: np.ndarray
    tried: np.ndarray | None = None  # [slot, try] features
    cuts: np.ndarray | None = None  # [slot, try]
    edges: list | None = None
    n_bins: int = 0

    @property
    def channels(self) -> int:
        return 2 if self.growth.boosted else self.classes

    def cells(self) -> int:
        return len(self.slots) * (1 if self.kind == "totals" else self.tried.shape[1]) * (self.n_bins if self.kind == "bins" else 1)

    def empty(self) -> np.ndarray:
        """[cell, channels and count], or [cell, least and largest]."""
        if self.kind == "range":
            return np.tile([np.inf, -np.inf], (self.cells(), 1))
        return np.zeros((self.cells(), self.channels + 1))

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.stack([np.minimum(a[:, 0], b[:, 0]), np.maximum(a[:, 1], b[:, 1])], axis=1) if self.kind == "range" else a + b

    def of(self, block: Block) -> np.ndarray:
        tree, row, times = _members(block, self.trees, self.growth, self.classes)
        node = self.state.leaves(block.x, self.state.roots[tree], row)
        slot_of = np.full(len(self.state.feature), -1)
        slot_of[self.slots] = np.arange(len(self.slots))
        slot = slot_of[node]
        keep = np.flatnonzero(slot >= 0)
        keep = keep[np.argsort(slot[keep], kind="stable")]
        slot, tree, row, times = slot[keep], tree[keep], row[keep], times[keep]
        if self.kind == "totals":
            return self._add(block, slot[:, None], tree, row, times, None)
        out, many = self.empty(), self.tried.shape[1]
        if not len(slot):
            return out
        cell, of = slot[:, None] * many + np.arange(many), self.tried[slot]
        if self.kind == "bins":
            if block.bins is None:
                block.bins = binned(block.x, self.edges)
            return self._add(block, cell * self.n_bins + block.bins[row[:, None], of], tree, row, times, None)
        x = block.x[row[:, None], of]
        if self.kind == "sides":
            return self._add(block, cell, tree, row, times, x <= self.cuts[slot])
        begin = np.flatnonzero(np.diff(slot, prepend=-1))
        place = (slot[begin][:, None] * many + np.arange(many)).ravel()
        out[place, 0], out[place, 1] = np.minimum.reduceat(x, begin, axis=0).ravel(), np.maximum.reduceat(x, begin, axis=0).ravel()
        return out

    def _add(self, block: Block, cell: np.ndarray, tree: np.ndarray, row: np.ndarray, times: np.ndarray, only: np.ndarray | None) -> np.ndarray:
        """Sums of the rows by cell; ``cell`` has one for each try of a row, ``only`` says which of them count."""
        size = self.cells()
        spread = (lambda v: np.repeat(v, cell.shape[1])) if only is None else (lambda v: np.where(only, v[:, None], 0.0).ravel())
        out, flat = np.empty((size, self.channels + 1)), cell.ravel()
        out[:, -1] = np.bincount(flat, spread(times), size)
        if self.growth.boosted:
            sums = block.pull(self.classes)[row, np.asarray(self.trees)[tree] % self.classes]
            for c in range(2):
                out[:, c] = np.bincount(flat, spread(sums[:, c]), size)
        else:
            own = (cell * self.classes + block.y[row][:, None]).ravel()
            out[:, :-1] = np.bincount(own, spread(np.rint(block.w[row] * _UNIT) * times), size * self.classes).reshape(size, -1)
        return out


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin b of a feature has the values up to its edge b and above the edge before."""
    return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1).astype(np.uint8)


def quantile_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    at = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(x[:, f], at, method="lower")) for f in range(x.shape[1])]


def _members(block: Block, trees: Sequence[int], growth: Growth, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of tree, row, times) for all rows of a block that the trees learn from; trees of one round share theirs."""
    tree = np.asarray(trees)[:, None] // (classes if growth.boosted else 1)
    if growth.bootstrap:
        upto = np.cumsum([math.exp(-growth.rows) * growth.rows ** k / math.factorial(k) for k in range(12)])
        times = np.searchsorted(upto, draw(growth.seed, 1, tree, block.key), side="right").astype(float)
    elif growth.rows < 1:
        times = (draw(growth.seed, 1, tree, block.key) < growth.rows).astype(float)
    else:
        times = np.ones((len(trees), len(block.y)))
    times[:, block.stop] = 0
    tree, row = np.nonzero(times)
    return tree, row, times[tree, row]


Measure = Callable[[Request], np.ndarray]


def over(blocks: Iterable[Block]) -> Measure:
    """Answers requests from blocks at hand."""
    blocks = list(blocks)

    def measure(request: Request) -> np.ndarray:
        out = request.empty()
        for block in blocks:
            out = request.merge(out, request.of(block))
        return out

    return measure


def _purity(sums: np.ndarray, growth: Growth) -> np.ndarray:
    """Higher for better nodes; [..., channel] sums in whole units."""
    if growth.boosted:
        g, h = sums[..., 0] / _UNIT, sums[..., 1] / _UNIT
        return np.maximum(np.abs(g) - growth.l1, 0) ** 2 / np.maximum(h + growth.l2, 1e-300)
    whole = sums.sum(axis=-1)
    return (sums * sums).sum(axis=-1) / np.maximum(whole, 1e-300)


def grow(trees: Sequence[int], growth: Growth, classes: int, n_features: int, measure: Measure, edges: list | None = None) -> Trees:
    """The trees with these numbers. Nodes of a level are taken in parts whose sums fit in ``CELLS``."""
    many = len(trees)
    state = Trees(np.arange(many), np.full(many, -1), np.zeros(many), np.zeros(many, int), np.zeros(many, int), np.zeros((many, 0)))
    number, path = np.asarray(trees), np.ones(many, np.int64)
    ask = Request("totals", growth, trees, classes, state, state.roots)
    totals = measure(ask)
    scale = totals[:, :-1].sum(axis=1)
    of_tree = np.arange(many)
    n_bins = max((len(e) + 1 for e in edges), default=1) if edges else 0
    tries = min(growth.tries or n_features, max(1, int(growth.columns * n_features)))
    opened = np.arange(many)
    for _ in range(growth.depth):
        opened = opened[totals[opened, -1] >= max(growth.min_split, 2 * growth.min_leaf, 2)]
        if not growth.boosted:
            opened = opened[totals[opened, :-1].max(axis=1) < totals[opened, :-1].sum(axis=1)]
        if not len(opened):
            break
        part = max(1, CELLS // (tries * max(n_bins, 1) * (ask.channels + 1)))
        first = len(state.feature)
        for slots in np.split(opened, range(part, len(opened), part)):
            tried = _tried(growth, number[slots], path[slots], n_features, tries)
            ask = replace(ask, kind="bins", state=state, slots=slots, tried=tried, edges=edges, n_bins=n_bins)
            whole = totals[slots][:, None]
            if growth.random_cuts:
                low, high = measure(replace(ask, kind="range")).reshape(len(slots), tries, 2).transpose(2, 0, 1)
                span = np.where(np.isfinite(low), high - low, 0.0)
                cuts = np.where(span > 0, low + draw(growth.seed, 2, number[slots][:, None], path[slots][:, None], tried) * span, -np.inf)
                cuts = np.where(cuts >= high, low, cuts)
                side = measure(replace(ask, kind="sides", cuts=cuts)).reshape(len(slots), tries, 1, -1)
            else:
                side = measure(ask).reshape(len(slots), tries, n_bins, -1).cumsum(axis=2)
                cuts = None
            other = whole[:, None] - side
            gain = _purity(side[..., :-1], growth) + _purity(other[..., :-1], growth) - _purity(whole[:, None, :, :-1], growth)
            fits = (side[..., -1] >= max(1, growth.min_leaf)) & (other[..., -1] >= max(1, growth.min_leaf))
            if growth.boosted:
                fits &= (side[..., 1] >= growth.min_weight * _UNIT) & (other[..., 1] >= growth.min_weight * _UNIT)
                gain = gain / 2 - growth.min_gain
                good = fits & (gain > 1e-9)
            else:
                gain = gain / scale[of_tree[slots]][:, None, None]
                good = fits & (gain >= max(growth.min_gain, 1e-12))
            gain = np.where(good, np.round(gain, 12), -np.inf).reshape(len(slots), -1)
            best = gain.argmax(axis=1)
            split = np.flatnonzero(np.isfinite(gain[np.arange(len(slots)), best]))
            k, b = np.divmod(best[split], side.shape[2])
            nodes, f = slots[split], tried[split, k]
            cut = cuts[split, k] if cuts is not None else np.array([edges[i][j] if j < len(edges[i]) else np.inf for i, j in zip(f, b)])
            new = len(state.feature) + np.arange(2 * len(split))
            state.feature[nodes], state.threshold[nodes] = f, cut
            state.left[nodes], state.right[nodes] = new[0::2], new[1::2]
            state = replace(state, **{n: np.concatenate([getattr(state, n), np.full(len(new), v)]) for n, v in
                                      (("feature", -1), ("threshold", 0.0), ("left", 0), ("right", 0))})
            halves = np.stack([side[split, k, b], other[split, k, b]], axis=1).reshape(-1, totals.shape[1])
            totals = np.concatenate([totals, halves])
            number, of_tree = (np.concatenate([a, np.repeat(a[nodes], 2)]) for a in (number, of_tree))
            path = np.concatenate([path, (np.repeat(path[nodes], 2) * 2 + np.tile([0, 1], len(split)))])
        opened = np.arange(first, len(state.feature))
    sums = totals[:, :-1]
    if growth.boosted:
        g, h = sums[:, 0] / _UNIT, sums[:, 1] / _UNIT
        value = (-growth.rate * np.sign(g) * np.maximum(np.abs(g) - growth.l1, 0) / np.maximum(h + growth.l2, 1e-300))[:, None]
    else:
        value = sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-300)
    return replace(state, value=value)


def _tried(growth: Growth, tree: np.ndarray, path: np.ndarray, n_features: int, tries: int) -> np.ndarray:
    """[slot, try] ascending features: a share drawn for the tree, of which each node draws ``tries``."""
    features = np.arange(n_features)
    if tries >= n_features:
        return np.tile(features, (len(tree), 1))
    order = draw(growth.seed, 3, tree[:, None], path[:, None], features)
    if growth.columns < 1:
        mine, some = draw(growth.seed, 4, tree[:, None], features), max(1, int(growth.columns * n_features))
        order = np.where(mine <= np.sort(mine, axis=1)[:, some - 1:some], order, 2.0)
    return np.sort(np.argsort(order, axis=1, kind="stable")[:, :tries], axis=1)


def join(parts: Sequence[Trees]) -> Trees:
    """Trees of all parts, one after another."""
    at = np.cumsum([0, *(len(p.feature) for p in parts)])[:-1]
    shifted = [replace(p, roots=p.roots + o, left=p.left + o, right=p.right + o) for p, o in zip(parts, at)]
    return Trees(*(np.concatenate([getattr(p, n) for p in shifted]) for n in ("roots", "feature", "threshold", "left", "right", "value")))


# ---- tables ----

_PARTS = {"x": np.float64, "y": np.int64, "w": np.float64, "key": np.int64, "stop": np.bool_, "margin": np.float64}
_BLOCKS = "part long, n long, " + ", ".join(f"{c} binary" for c in _PARTS)


def to_row(block: Block, part: int) -> dict:
    return {"part": part, "n": len(block.y), **{c: None if getattr(block, c) is None else getattr(block, c).astype(t).tobytes() for c, t in _PARTS.items()}}


def from_row(row: dict) -> Block:
    parts = {c: None if row[c] is None else np.frombuffer(row[c], t) for c, t in _PARTS.items()}
    for c in ("x", "margin"):
        if parts[c] is not None:
            parts[c] = parts[c].reshape(row["n"], -1)
    return Block(**parts)


def _schema() -> pa.Schema:
    return pa.schema([("part", pa.int64()), ("n", pa.int64()), *[(c, pa.binary()) for c in _PARTS]])


def blocks_of(rows: DataFrame, label: str, weight: str, stop: str = "") -> DataFrame:
    """Rows with ``features`` packed in blocks, written once. Draws go by row_id, or by the row where that is missing."""
    key = F.xxhash64("row_id") if "row_id" in rows.columns else F.xxhash64(vector_to_array("features"), label)
    flag = F.coalesce(F.col(stop).cast("boolean"), F.lit(False)) if stop else F.lit(False)
    given = rows.select(vector_to_array("features").alias("x"), F.col(label).cast("long").alias("y"),
                        (F.col(weight).cast("double") if weight in rows.columns else F.lit(1.0)).alias("w"), key.alias("key"), flag.alias("stop"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(at, BLOCK_ROWS)
                x = np.array(some["x"].to_pylist(), np.float64).reshape(some.num_rows, -1)
                block = Block(x, *(some[c].to_numpy(zero_copy_only=False) for c in ("y", "w", "key", "stop")))
                yield pa.RecordBatch.from_pylist([to_row(block, part)], _schema())
                part += 1

    return workdir.materialize(given.mapInArrow(pack, _BLOCKS), "tree-blocks")


def over_table(blocks: DataFrame) -> Measure:
    """Answers a request by one job: each task adds up its blocks, equal cells meet in one aggregate."""
    spark = blocks.sparkSession

    def measure(request: Request) -> np.ndarray:
        sent = spark.sparkContext.broadcast(request)
        width = request.empty().shape[1]
        columns = [f"v{i}" for i in range(width)]

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ask = sent.value
            out = ask.empty()
            for batch in batches:
                for row in batch.to_pylist():
                    out = ask.merge(out, ask.of(from_row(row)))
            cell = np.flatnonzero(np.isfinite(out[:, 0]) if ask.kind == "range" else out[:, -1])
            yield pa.RecordBatch.from_arrays([pa.array(cell), *(pa.array(out[cell, i]) for i in range(width))], ["cell", *columns])

        told = blocks.mapInArrow(add, "cell long, " + ", ".join(f"{c} double" for c in columns))
        how = [F.min, F.max] if request.kind == "range" else [F.sum] * width
        found = told.groupBy("cell").agg(*[h(c).alias(c) for h, c in zip(how, columns)]).toArrow()
        out = request.empty()
        out[found["cell"].to_numpy()] = np.stack([found[c].to_numpy() for c in columns], axis=1)
        sent.unpersist()
        return out

    return measure


@dataclass
class Table:
    """Blocks, their shape, and for a table of up to ``WHOLE`` values its blocks at hand."""

    blocks: DataFrame
    rows: int
    features: int
    classes: int
    held: list[dict] | None = None

    @classmethod
    def of(cls, blocks: DataFrame, whole: int) -> Table:
        def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    block = from_row(row)
                    yield pa.RecordBatch.from_pydict({"n": [len(block.y)], "f": [block.x.shape[1]], "top": [int(block.y.max(initial=0))]})

        found = blocks.mapInArrow(shape, "n long, f long, top long").agg(F.sum("n").alias("n"), F.max("f").alias("f"), F.max("top").alias("top")).first()
        if not found["n"]:
            raise ValueError("no rows to learn from")
        table = cls(blocks, found["n"], found["f"], found["top"] + 1)
        if table.rows * table.features <= whole:
            table.held = [r.asDict() for r in blocks.orderBy("part").collect()]
        return table

    def edges(self, bins: int) -> list[np.ndarray]:
        if self.held is not None:
            return quantile_edges(np.concatenate([from_row(r).x for r in self.held]), bins)

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    x = from_row(row).x
                    yield pa.RecordBatch.from_pydict({"f": np.tile(np.arange(x.shape[1]), len(x)), "v": x.ravel()})

        at = [float(q) for q in np.linspace(0, 1, bins + 1)[1:-1]]
        rows = self.blocks.mapInArrow(spread, "f long, v double").groupBy("f").agg(F.percentile_approx("v", at, 10_000).alias("e")).collect()
        out: list = [np.zeros(0)] * self.features
        for r in rows:
            out[r["f"]] = np.unique(r["e"])
        return out


def number_of_tries(tries: int | float | str, features: int) -> int:
    if tries in ("sqrt", "log2"):
        return max(1, int(math.sqrt(features) if tries == "sqrt" else math.log2(features)))
    return max(1, int(float(tries) * features)) if 0 < float(tries) < 1 else int(tries)


def fit_forest(rows: DataFrame, growth: Growth, trees: int, label: str, weight: str, bins: int = 32, whole: int = WHOLE) -> tuple[Trees, int]:
    """All trees of a forest, and the number of classes.

    A table of up to ``whole`` values is sent to the tasks, and the trees are dealt among them. Beyond that the trees
    grow together in level-wise jobs over the blocks, as many at a time as ``CELLS`` allows.
    """
    table = Table.of(blocks_of(rows, label, weight), whole)
    growth = replace(growth, tries=number_of_tries(growth.tries, table.features))
    edges = None if growth.random_cuts else table.edges(bins)
    if table.held is None:
        step = 64
        return join([grow(list(range(t, min(t + step, trees))), growth, table.classes, table.features, over_table(table.blocks), edges)
                     for t in range(0, trees, step)]), table.classes
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((table.held, growth, table.classes, table.features, edges))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, growth, classes, features, edges = sent.value
        measure = None
        for batch in batches:
            for t in batch["id"].to_pylist():
                measure = measure or over([from_row(r) for r in held])
                yield pa.RecordBatch.from_pylist([tree_row(t, grow([t], growth, classes, features, measure, edges))], _TREE)

    jobs = min(trees, 4 * spark.sparkContext.defaultParallelism)
    made = spark.range(0, trees, 1, jobs).mapInArrow(some, _TREE_COLUMNS).toArrow().sort_by("tree").to_pylist()
    sent.unpersist()
    return join([row_tree(r) for r in made]), table.classes


_TREE_COLUMNS = "tree long, feature array<long>, threshold array<double>, left array<long>, right array<long>, value array<double>"
_TREE = pa.schema([("tree", pa.int64()), ("feature", pa.list_(pa.int64())), ("threshold", pa.list_(pa.float64())),
                   ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64())), ("value", pa.list_(pa.float64()))])


def tree_row(number: int, tree: Trees) -> dict:
    return {"tree": number, "feature": tree.feature, "threshold": tree.threshold, "left": tree.left, "right": tree.right, "value": tree.value.ravel()}


def row_tree(row: dict) -> Trees:
    n = len(row["feature"])
    return Trees(np.zeros(1, int), np.array(row["feature"], int), np.array(row["threshold"], float), np.array(row["left"], int), np.array(row["right"], int),
                 np.array(row["value"], float).reshape(n, -1))


def single(trees: Trees) -> Iterator[Trees]:
    """Each tree alone."""
    for root in trees.roots:
        keep, at = [], [int(root)]
        while at:
            node = at.pop()
            keep.append(node)
            if trees.feature[node] >= 0:
                at += [int(trees.right[node]), int(trees.left[node])]
        keep = np.array(keep)
        place = np.zeros(len(trees.feature), int)
        place[keep] = np.arange(len(keep))
        inner = trees.feature[keep] >= 0
        yield Trees(np.zeros(1, int), trees.feature[keep], trees.threshold[keep], np.where(inner, place[trees.left[keep]], 0),
                    np.where(inner, place[trees.right[keep]], 0), trees.value[keep])


# ---- boosting ----


def _loss(blocks: Iterable[Block]) -> tuple[float, float]:
    """Sum and weight of the log loss of the rows that tell when to stop."""
    total = whole = 0.0
    for b in blocks:
        m = b.margin[b.stop]
        if len(m):
            top = m.max(axis=1, keepdims=True)
            logs = m - top - np.log(np.exp(m - top).sum(axis=1, keepdims=True))
            total -= float(logs[np.arange(len(m)), b.y[b.stop]].sum())
            whole += len(m)
    return total, whole


class _Held:
    """Boosting rounds on blocks at hand."""

    def __init__(self, held: list[dict], classes: int):
        self.blocks = [from_row(r) for r in held]
        for b in self.blocks:
            b.margin = np.zeros((len(b.y), classes))

    def measure(self) -> Measure:
        return over(self.blocks)

    def add(self, trees: Trees, classes: int) -> tuple[float, float]:
        for b in self.blocks:
            b.margin = b.margin + trees.sum(b.x, classes)
        return _loss(self.blocks)


class _Written:
    """Boosting rounds on a table: margins are part of the blocks and written anew each round."""

    def __init__(self, blocks: DataFrame, classes: int):
        self.blocks = self._changed(blocks, lambda b: np.zeros((len(b.y), classes)))

    def _changed(self, blocks: DataFrame, margin: Callable[[Block], np.ndarray]) -> DataFrame:
        def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    block = from_row(row)
                    block.margin = margin(block)
                    yield pa.RecordBatch.from_pylist([to_row(block, row["part"])], _schema())

        return workdir.materialize(blocks.mapInArrow(change, _BLOCKS), "tree-margins")

    def measure(self) -> Measure:
        return over_table(self.blocks)

    def add(self, trees: Trees, classes: int) -> tuple[float, float]:
        self.blocks = self._changed(self.blocks, lambda b: b.margin + trees.sum(b.x, classes))

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                total, whole = _loss(from_row(r) for r in batch.to_pylist())
                yield pa.RecordBatch.from_pydict({"total": [total], "whole": [whole]})

        row = self.blocks.mapInArrow(told, "total double, whole double").agg(F.sum("total"), F.sum("whole")).first()
        return row[0] or 0.0, row[1] or 0.0


def boost(state: _Held | _Written, growth: Growth, rounds: int, patience: int, classes: int, features: int, edges: list) -> Trees:
    """A tree for each class and round; after ``patience`` rounds without gain on the stopping rows, those after the best go."""
    made: list[Trees] = []
    best, best_at = math.inf, 0
    for r in range(rounds):
        trees = grow([r * classes + c for c in range(classes)], replace(growth, boosted=True), classes, features, state.measure(), edges)
        made.append(trees)
        total, whole = state.add(trees, classes)
        if whole:
            if total / whole < best - 1e-12:
                best, best_at = total / whole, r + 1
            elif r + 1 - best_at >= patience:
                break
    return join(made[:best_at] if math.isfinite(best) else made)


def fit_boosted(rows: DataFrame, growth: Growth, rounds: int, label: str, weight: str, stop: str = "", patience: int = 30,
                bins: int = 64, whole: int = WHOLE) -> tuple[Trees, int]:
    """Softmax boosting; ``stop`` names a flag of rows that only tell when to stop.

    On a table of up to ``whole`` values the rounds run in one task, since each needs the one before; beyond that each
    level of a round is one job over the blocks.
    """
    table = Table.of(blocks_of(rows, label, weight, stop), whole)
    edges = table.edges(bins)
    if table.held is None:
        return boost(_Written(table.blocks, table.classes), growth, rounds, patience, table.classes, table.features, edges), table.classes
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((table.held, table.classes, table.features, edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _ in range(batch.num_rows):
                held, classes, features, edges = sent.value
                trees = boost(_Held(held, classes), growth, rounds, patience, classes, features, edges)
                yield pa.RecordBatch.from_pylist([tree_row(i, t) for i, t in enumerate(single(trees))], _TREE)

    made = spark.range(0, 1, 1, 1).mapInArrow(run, _TREE_COLUMNS).toArrow().sort_by("tree").to_pylist()
    sent.unpersist()
    return join([row_tree(r) for r in made]), table.classes


# ---- estimators ----


def learn_forest(growth: Growth, trees: int, bins: int, blocks: list[Block], classes: int) -> Callable[[np.ndarray], np.ndarray]:
    """A forest from blocks at hand, as a function from rows to class probabilities."""
    features = blocks[0].x.shape[1]
    growth = replace(growth, tries=number_of_tries(growth.tries, features))
    edges = None if growth.random_cuts else quantile_edges(np.concatenate([b.x for b in blocks]), bins)
    measure = over(blocks)
    made = join([grow([t], growth, classes, features, measure, edges) for t in range(trees)])
    return TreesModel(made, classes).probabilities


def learn_boosted(growth: Growth, rounds: int, patience: int, bins: int, blocks: list[Block], classes: int) -> Callable[[np.ndarray], np.ndarray]:
    edges = quantile_edges(np.concatenate([b.x for b in blocks]), bins)
    made = boost(_Held([to_row(b, 0) for b in blocks], classes), growth, rounds, patience, classes, blocks[0].x.shape[1], edges)
    return TreesModel(made, classes, True).probabilities


class TreesModel(Model, MLWritable, MLReadable):
    """Adds probability and prediction: the mean of the trees' class shares, or the softmax of their sums."""

    def __init__(self, trees: Trees | None = None, classes: int = 0, boosted: bool = False):
        super().__init__()
        self.trees, self.classes, self.boosted = trees, classes, boosted

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if not self.boosted:
            return self.trees.sum(x) / max(1, len(self.trees.roots))
        margin = self.trees.sum(x, self.classes) if len(self.trees.roots) else np.zeros((len(x), self.classes))
        e = np.exp(margin - margin.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spark = dataset.sparkSession
        sent = spark.sparkContext.broadcast((self.trees, self.classes, self.boosted))

        @F.arrow_udf("array<double>")
        def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = TreesModel(*sent.value)
            for batch in batches:
                x = np.array(batch.to_pylist(), np.float64).reshape(len(batch), -1)
                p = model.probabilities(x) if len(x) else np.zeros((0, model.classes))
                yield pa.array(list(p), pa.list_(pa.float64()))

        held = max(dataset.columns, key=len) + "_p"
        out = dataset.withColumn(held, scored(vector_to_array("features")))
        return out.withColumns({"probability": array_to_vector(held),
                                "prediction": (F.array_position(held, F.array_max(held)) - 1).cast("double")}).drop(held)

    def write(self) -> MLWriter:
        return _TreesWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TreesReader()


class _TreesWriter(MLWriter):
    def __init__(self, model: TreesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        model = self.model
        DefaultParamsWriter.saveMetadata(model, path, self.sparkSession, {"classes": model.classes, "boosted": model.boosted})
        rows = pa.Table.from_pylist([tree_row(i, t) for i, t in enumerate(single(model.trees))], _TREE)
        self.sparkSession.createDataFrame(rows).repartition(max(1, len(model.trees.feature) >> 20)).write.parquet(f"{path}/trees")


class _TreesReader(MLReader):
    def load(self, path: str) -> TreesModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.parquet(f"{path}/trees").toArrow().sort_by("tree").to_pylist()
        return TreesModel(join([row_tree(r) for r in rows]), meta["classes"], meta["boosted"])


class ForestClassifier(Estimator):
    """Trees on resampled rows with the best cuts of binned features, or on all rows with random cuts."""

    def __init__(self, growth: Growth, trees: int, label: str, weight: str, whole: int = WHOLE):
        super().__init__()
        self.growth, self.trees, self.label, self.weight, self.whole = growth, trees, label, weight, whole

    def _fit(self, dataset: DataFrame) -> TreesModel:
        return TreesModel(*fit_forest(dataset, self.growth, self.trees, self.label, self.weight, whole=self.whole))

    def learner(self) -> Callable:
        """Learns from (blocks, classes) at hand, for many fits in one job."""
        return partial(learn_forest, self.growth, self.trees, 32)


class BoostedClassifier(Estimator):
    """Softmax boosting with L1 and L2, rows drawn a round, features drawn a tree, and early stopping."""

    def __init__(self, growth: Growth, rounds: int, label: str, weight: str, stop: str = "", patience: int = 30, whole: int = WHOLE):
        super().__init__()
        self.growth, self.rounds, self.label, self.weight = growth, rounds, label, weight
        self.stop, self.patience, self.whole = stop, patience, whole

    def _fit(self, dataset: DataFrame) -> TreesModel:
        return TreesModel(*fit_boosted(dataset, self.growth, self.rounds, self.label, self.weight, self.stop, self.patience, whole=self.whole), True)

    def learner(self) -> Callable:
        """Learns from (blocks, classes) at hand, for many fits in one job."""
        return partial(learn_boosted, self.growth, self.rounds, self.patience, 64)
