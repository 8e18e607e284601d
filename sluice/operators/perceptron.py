"""Multilayer perceptron trained by Adam on mini-batches, with L2 and early stopping.

A table of up to ``WHOLE`` values is learned from in one task, in batches of rows. Beyond that every step is one job: the
blocks of the step, chosen by hash, give the sums of their gradients, and the sums meet in one aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, functions as F

from sluice.operators.trees import WHOLE, Block, Table, blocks_of, draw, from_row


@dataclass(frozen=True)
class Learning:
    hidden: tuple[int, ...] = (128, 64)
    l2: float = 1e-3
    rate: float = 1e-3
    batch: int = 200
    epochs: int = 300
    patience: int = 15
    tolerance: float = 1e-4
    held: float = 0.15
    steps: int = 32  # of an epoch over a large table
    seed: int = 42


class Network:
    """Layers with rectified units and a softmax; parameters in one flat array."""

    def __init__(self, widths: tuple[int, ...], theta: np.ndarray):
        self.widths, self.theta = widths, theta

    @classmethod
    def start(cls, widths: tuple[int, ...], seed: int) -> Network:
        rng, parts = np.random.default_rng(seed), []
        for i, (a, b) in enumerate(zip(widths, widths[1:])):
            bound = math.sqrt(6 / (a + b))
            parts += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
        return cls(widths, np.concatenate(parts))

    def layers(self, flat: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at = 0
        for a, b in zip(self.widths, self.widths[1:]):
            yield flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]
            at += a * b + b

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[-1]

    def _forward(self, x: np.ndarray) -> list[np.ndarray]:
        out, last = [x], len(self.widths) - 2
        for i, (w, b) in enumerate(self.layers(self.theta)):
            z = out[-1] @ w + b
            if i < last:
                out.append(np.maximum(z, 0))
            else:
                e = np.exp(z - z.max(axis=1, keepdims=True))
                out.append(e / e.sum(axis=1, keepdims=True))
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Gradient of the weighted sum of log losses."""
        acts, out = self._forward(x), np.zeros_like(self.theta)
        delta = (acts[-1] - (np.arange(self.widths[-1]) == y[:, None])) * w[:, None]
        for (weight, _), (gw, gb), act in reversed(list(zip(self.layers(self.theta), self.layers(out), acts))):
            gw[:], gb[:] = act.T @ delta, delta.sum(axis=0)
            delta = (delta @ weight.T) * (act > 0)
        return out

    def decay(self) -> np.ndarray:
        """The parameters that L2 pulls to zero: weights, not offsets."""
        out = np.zeros_like(self.theta)
        for (w, _), (gw, _) in zip(self.layers(self.theta), self.layers(out)):
            gw[:] = w
        return out


class Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, network: Network, gradient: np.ndarray) -> None:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient * gradient
        rate = self.rate * math.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        network.theta = network.theta - rate * self.m / (np.sqrt(self.v) + 1e-8)


def held_rows(block: Block, learning: Learning) -> np.ndarray:
    return draw(learning.seed, 5, block.key) < learning.held


def train(widths: tuple[int, ...], learning: Learning, steps, score) -> Network:
    """``steps(epoch, network)`` gives (gradient sum, weight sum) of each step, ``score(network)`` the share of held rows it gets right.

    Training ends after ``patience`` epochs that do not better the score; the best network is returned. Without held
    rows there is no score and the last network counts.
    """
    network = Network.start(widths, learning.seed)
    adam, best, kept, idle = Adam(len(network.theta), learning.rate), -math.inf, network.theta, 0
    for epoch in range(learning.epochs):
        for gradient, weight in steps(epoch, network):
            if weight > 0:
                adam.step(network, gradient / weight + learning.l2 * network.decay() / weight)
        now = score(network)
        if now is None:
            kept = network.theta
        elif now > best + learning.tolerance:
            best, kept, idle = now, network.theta, 0
        else:
            idle += 1
            if idle >= learning.patience:
                break
    return Network(widths, kept)


def train_held(blocks: list[Block], widths: tuple[int, ...], learning: Learning) -> Network:
    """In batches of rows, in an order drawn anew each epoch."""
    x, y, w, key = (np.concatenate([getattr(b, n) for b in blocks]) for n in ("x", "y", "w", "key"))
    held = np.concatenate([held_rows(b, learning) for b in blocks])
    rows = np.flatnonzero(~held)
    # Rows in the order of their keys, so that it does not matter how they were dealt to blocks.
    rows = rows[np.lexsort((y[rows], key[rows]))]

    def steps(epoch: int, network: Network):
        order = rows[np.argsort(draw(learning.seed, 6, epoch, np.arange(len(rows))), kind="stable")]
        for at in range(0, len(order), learning.batch):
            some = order[at:at + learning.batch]
            yield network.gradient(x[some], y[some], w[some]), float(w[some].sum())

    def score(network: Network) -> float | None:
        return float((network.probabilities(x[held]).argmax(axis=1) == y[held]).mean()) if held.any() else None

    return train(widths, learning, steps, score)


def train_written(blocks: DataFrame, widths: tuple[int, ...], learning: Learning) -> Network:
    """Step by step over the blocks of a table; the step of a block in an epoch is drawn from its number."""
    spark = blocks.sparkSession

    def summed(network: Network, some: DataFrame, scoring: bool) -> np.ndarray:
        sent = spark.sparkContext.broadcast((widths, network.theta, learning))

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            widths, theta, learning = sent.value
            net, total = Network(widths, theta), np.zeros(2 if scoring else len(theta) + 1)
            for batch in batches:
                for row in batch.to_pylist():
                    b = from_row(row)
                    held = held_rows(b, learning)
                    if scoring:
                        total += [float((net.probabilities(b.x[held]).argmax(axis=1) == b.y[held]).sum()), float(held.sum())]
                    else:
                        fit = ~held
                        total[:-1] += net.gradient(b.x[fit], b.y[fit], b.w[fit])
                        total[-1] += b.w[fit].sum()
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "v"])

        found = some.mapInArrow(told, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros(2 if scoring else len(network.theta) + 1)
        out[found["at"].to_numpy()] = found["v"].to_numpy()
        sent.unpersist()
        return out

    def steps(epoch: int, network: Network):
        for step in range(learning.steps):
            of = F.pmod(F.xxhash64(F.lit(learning.seed), F.lit(epoch), "part"), F.lit(learning.steps))
            total = summed(network, blocks.where(of == step), False)
            yield total[:-1], float(total[-1])

    def score(network: Network) -> float | None:
        right, many = summed(network, blocks, True)
        return right / many if many else None

    return train(widths, learning, steps, score)


class PerceptronModel(Model, MLWritable, MLReadable):
    def __init__(self, network: Network | None = None):
        super().__init__()
        self.network = network

    def _transform(self, dataset: DataFrame) -> DataFrame:
        sent = dataset.sparkSession.sparkContext.broadcast((self.network.widths, self.network.theta))

        @F.arrow_udf("array<double>")
        def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            network = Network(*sent.value)
            for batch in batches:
                x = np.array(batch.to_pylist(), np.float64).reshape(len(batch), -1)
                p = network.probabilities(x) if len(x) else x
                yield pa.array(list(p), pa.list_(pa.float64()))

        held = max(dataset.columns, key=len) + "_p"
        out = dataset.withColumn(held, scored(vector_to_array("features")))
        return out.withColumns({"probability": array_to_vector(held),
                                "prediction": (F.array_position(held, F.array_max(held)) - 1).cast("double")}).drop(held)

    def write(self) -> MLWriter:
        return _PerceptronWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _PerceptronReader()


class _PerceptronWriter(MLWriter):
    def __init__(self, model: PerceptronModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        network = self.model.network
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, {"widths": list(network.widths)})
        self.sparkSession.createDataFrame([(network.theta.tolist(),)], "theta array<double>").coalesce(1).write.parquet(f"{path}/network")


class _PerceptronReader(MLReader):
    def load(self, path: str) -> PerceptronModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        row = self.sparkSession.read.parquet(f"{path}/network").first()
        return PerceptronModel(Network(tuple(meta["widths"]), np.array(row["theta"])))


class PerceptronClassifier(Estimator):
    def __init__(self, learning: Learning, label: str, weight: str, whole: int = WHOLE):
        super().__init__()
        self.learning, self.label, self.weight, self.whole = learning, label, weight, whole

    def _fit(self, dataset: DataFrame) -> PerceptronModel:
        table = Table.of(blocks_of(dataset, self.label, self.weight), self.whole)
        widths, learning = (table.features, *self.learning.hidden, table.classes), self.learning
        if table.held is None:
            return PerceptronModel(train_written(table.blocks, widths, learning))
        spark = dataset.sparkSession
        sent = spark.sparkContext.broadcast(table.held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _ in range(batch.num_rows):
                    network = train_held([from_row(r) for r in sent.value], widths, learning)
                    yield pa.RecordBatch.from_arrays([pa.array([network.theta], pa.list_(pa.float64()))], ["theta"])

        theta = spark.range(0, 1, 1, 1).mapInArrow(run, "theta array<double>").first()["theta"]
        sent.unpersist()
        return PerceptronModel(Network(widths, np.array(theta)))

    def learner(self) -> Callable:
        """Learns from (blocks, classes) at hand, for many fits in one job."""
        return partial(learn_network, self.learning)


def learn_network(learning: Learning, blocks: list[Block], classes: int) -> Callable[[np.ndarray], np.ndarray]:
    return train_held(blocks, (blocks[0].x.shape[1], *learning.hidden, classes), learning).probabilities
