"""Candidate classifiers.

All read ``features``, ``label_index`` and ``weight``, and all give ``probability`` and ``prediction``.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from sluice.operators import sampling
from sluice.operators.neighbours import KnnClassifier
from sluice.operators.perceptron import Learning, PerceptronClassifier
from sluice.operators.trees import BoostedClassifier, ForestClassifier, Growth

LABEL, WEIGHT = "label_index", "weight"


def random_forest(trees: int = 300, depth: int = 18, min_split: int = 20, min_leaf: int = 8, features: str | float = "sqrt",
                  rows: float = 0.75, min_gain: float = 0.0, seed: int = 42) -> ForestClassifier:
    """Trees on rows drawn with repetition, ``rows`` of their number on average, with the best of binned cuts."""
    growth = Growth(depth=depth, min_split=min_split, min_leaf=min_leaf, min_gain=min_gain, tries=features, rows=rows, bootstrap=True, seed=seed)
    return ForestClassifier(growth, trees, LABEL, WEIGHT)


def extra_trees(trees: int = 300, depth: int = 18, min_split: int = 20, min_leaf: int = 8, features: str | float = "sqrt",
                rows: float = 1.0, min_gain: float = 0.0, bootstrap: bool = False, seed: int = 42) -> ForestClassifier:
    """Trees on all rows (or ``rows`` drawn) with one random cut for each tried feature of a node."""
    growth = Growth(random_cuts=True, depth=depth, min_split=min_split, min_leaf=min_leaf, min_gain=min_gain, tries=features,
                    rows=rows, bootstrap=bootstrap, seed=seed)
    return ForestClassifier(growth, trees, LABEL, WEIGHT)


def boosted(rounds: int = 400, depth: int = 4, rate: float = 0.04, rows: float = 0.7, columns: float = 0.7, min_weight: float = 5.0,
            min_gain: float = 0.1, l1: float = 0.01, l2: float = 5.0, patience: int = 30, stop: str = "", seed: int = 42) -> BoostedClassifier:
    """Softmax boosting; ``stop`` names a flag of rows that are not learned from but end it after ``patience`` idle rounds."""
    growth = Growth(boosted=True, depth=depth, min_gain=min_gain, columns=columns, rows=rows, rate=rate, l1=l1, l2=l2, min_weight=min_weight, seed=seed)
    return BoostedClassifier(growth, rounds, LABEL, WEIGHT, stop, patience)


def perceptron(hidden: Sequence[int] = (128, 64), l2: float = 1e-3, rate: float = 1e-3, batch: int = 200, epochs: int = 300,
               patience: int = 15, held: float = 0.15, seed: int = 42) -> PerceptronClassifier:
    return PerceptronClassifier(Learning(tuple(hidden), l2, rate, batch, epochs, patience, held=held, seed=seed), LABEL, WEIGHT)


@dataclass
class Candidate:
    """A named model: how to build it, and the settings a search draws from."""

    name: str
    base: str
    build: Callable[..., Estimator]
    grid: Mapping[str, Sequence] = field(default_factory=dict)
    oversample: bool = False


# Settings the search draws from. ``min_gain`` of the forests takes the place of pruning by cost.
FOREST_GRID = {
    "trees": [160, 220, 320], "depth": [3, 4, 5, 6, 8], "min_split": [200, 500, 1000, 1500], "min_leaf": [100, 200, 500, 800],
    "features": ["sqrt", "log2", 0.25, 0.4], "rows": [0.35, 0.45, 0.6], "min_gain": [0.001, 0.005, 0.01, 0.02],
}
EXTRA_GRID = {
    "trees": [160, 220, 320], "depth": [5, 7, 9, 12], "min_split": [80, 120, 200, 500], "min_leaf": [30, 40, 80, 120],
    "features": ["sqrt", "log2", 0.25, 0.4], "rows": [0.45, 0.6, 0.75], "bootstrap": [True], "min_gain": [0.0, 0.0001, 0.001],
}
BOOSTED_GRID = {
    "rounds": [160, 220, 320], "depth": [2, 3], "rate": [0.01, 0.03, 0.05], "min_weight": [10, 20, 25, 40], "rows": [0.55, 0.65, 0.75],
    "columns": [0.55, 0.65, 0.75], "min_gain": [0.5, 1.0, 2.0], "l1": [0.1, 0.5, 1.0], "l2": [8, 12, 20],
}


def candidates(n_classes: int, seed: int = 42, enable_smote: bool = True) -> list[Candidate]:
    """Five models, and the two forests again on oversampled rows."""
    def forest(**p):
        return random_forest(seed=seed, **p)

    def extra(**p):
        return extra_trees(seed=seed, **p)

    def gradient(**p):
        return boosted(seed=seed, **p)

    out = [Candidate("Random Forest", "Random Forest", forest, FOREST_GRID),
           Candidate("KNN", "KNN", lambda **p: KnnClassifier(nClasses=n_classes, **p)),
           Candidate("Extra Trees", "Extra Trees", extra, EXTRA_GRID),
           Candidate("MLP Classifier", "MLP Classifier", lambda **p: perceptron(seed=seed, **p)),
           Candidate("XGBoost", "XGBoost", gradient, BOOSTED_GRID)]
    if enable_smote:
        out += [Candidate(f"{c.name} + SMOTE", c.base, c.build, c.grid, True) for c in (out[0], out[2])]
    return out


def draw_settings(grid: Mapping[str, Sequence], n: int, seed: int) -> list[dict]:
    """n different random settings of a grid (all of them if it has no more)."""
    size = 1
    for values in grid.values():
        size *= len(values)
    picks = random.Random(seed).sample(range(size), min(n, size))
    return [_setting(grid, i) for i in picks]


def _setting(grid: Mapping[str, Sequence], index: int) -> dict:
    out = {}
    for name, values in grid.items():
        index, at = divmod(index, len(values))
        out[name] = values[at]
    return out


def with_early_stopping_rows(df: DataFrame, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Flags 15 % of the rows, by class, to tell boosting when to stop."""
    return sampling.mark_holdout(df, LABEL, 0.15, keys, seed, "stopping")


def as_predictions(scored: DataFrame, **tags: str | int) -> DataFrame:
    """(label, prediction, probability) plus tags, the input of the metrics."""
    fixed = [F.lit(v).alias(k) for k, v in tags.items()]
    return scored.select(*fixed, F.col(LABEL).cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"),
                         vector_to_array("probability").alias("probability"))
