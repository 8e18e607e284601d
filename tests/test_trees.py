"""Trees, boosting and the perceptron: sums against plain ways, the same model from one task and from level-wise jobs."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sluice.operators import models, perceptron, trees as T


def sample(n=600, features=6, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.standard_normal((n, features)), 2)
    y = (x[:, 0] > 0).astype(int) + 2 * (x[:, 1] + x[:, 2] > 0.4)
    return x, y


def frame(spark, x, y, w=None, stop=None):
    rows = [(i, [float(v) for v in a], int(b), 1.0 if w is None else float(w[i]), False if stop is None else bool(stop[i])) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_id long, v array<double>, label_index int, weight double, stop boolean").repartition(3).withColumn("features", array_to_vector("v"))


def block(x, y, w=None, stop=None, key=None):
    n = len(y)
    return T.Block(x, y, np.ones(n) if w is None else w, np.arange(n) if key is None else key, np.zeros(n, bool) if stop is None else stop)


def parts(b, cuts=(100, 350)):
    at = [0, *cuts, len(b.y)]
    return [block(b.x[i:j], b.y[i:j], b.w[i:j], b.stop[i:j], b.key[i:j]) for i, j in zip(at, at[1:])]


def same(a, b):
    return len(a.roots) == len(b.roots) and all(
        (u.feature == v.feature).all() and (u.threshold == v.threshold).all() and np.allclose(u.value, v.value) for u, v in zip(T.single(a), T.single(b)))


GROWTHS = [T.Growth(depth=6, min_leaf=4, tries=3, rows=0.75, bootstrap=True), T.Growth(random_cuts=True, depth=60, tries=2),
           T.Growth(random_cuts=True, depth=5, tries=2, rows=0.6)]


@pytest.mark.parametrize("growth", GROWTHS)
def test_trees_do_not_depend_on_blocks(growth):
    x, y = sample()
    edges = None if growth.random_cuts else T.quantile_edges(x, 16)
    whole = block(x, y, w=np.where(y == 1, 1.7, 0.3))
    together = T.grow(list(range(9)), growth, 4, 6, T.over(parts(whole)), edges)
    alone = T.join([T.grow([t], growth, 4, 6, T.over([whole]), edges) for t in range(9)])
    assert same(together, alone)


@pytest.mark.parametrize("growth", GROWTHS)
def test_small_table_and_level_wise_jobs_give_one_forest(spark, growth):
    x, y = sample(300)
    rows = frame(spark, x, y)
    a, b = (T.fit_forest(rows, growth, 6, "label_index", "weight", bins=8, whole=whole)[0] for whole in (1 << 20, 0))
    if growth.random_cuts:
        assert same(a, b)
    probability = [T.TreesModel(t, 4).probabilities(x) for t in (a, b)]
    assert np.allclose(probability[0].sum(axis=1), 1) and np.mean(probability[0].argmax(1) == probability[1].argmax(1)) > 0.9


def test_first_cuts_of_extra_trees_follow_from_the_hash():
    """Root of a tree by hand: features of the least draws, a cut between their extremes, the best by Gini."""
    x, y = sample(200)
    growth = T.Growth(random_cuts=True, depth=1, tries=3, seed=9)
    for tree in range(10):
        got = T.grow([tree], growth, 4, 6, T.over([block(x, y)]))
        order = [T.draw(9, 3, [tree], [1], [f])[0] for f in range(6)]
        best = None
        for f in sorted(np.argsort(order)[:3]):
            low, high = x[:, f].min(), x[:, f].max()
            cut = low + T.draw(9, 2, [tree], [1], [f])[0] * (high - low)
            gini = 0
            for side in (x[:, f] <= cut, x[:, f] > cut):
                share = np.bincount(y[side], minlength=4) / side.sum()
                gini += side.mean() * (1 - (share ** 2).sum())
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, cut)
        assert (got.feature[0], got.threshold[0]) == (best[1], pytest.approx(best[2], abs=1e-12))
        assert 0 <= np.min([T.draw(9, 2, [t], [1], [0])[0] for t in range(99)]) < 0.1


def test_first_round_of_boosting_by_hand():
    x, y = sample(200)
    growth = T.Growth(boosted=True, depth=1, rate=0.3, l1=0.5, l2=2.0, min_gain=0.1, min_weight=3.0)
    edges = T.quantile_edges(x, 8)
    b = block(x, y)
    b.margin = np.zeros((200, 4))
    got = T.grow([0, 1, 2, 3], growth, 4, 6, T.over([b]), edges)
    shrink = lambda g: np.sign(g) * max(abs(g) - 0.5, 0)
    for c, tree in enumerate(T.single(got)):
        g, h = 0.25 - (y == c), np.full(200, 2 * 0.25 * 0.75)
        score = lambda s: shrink(g[s].sum()) ** 2 / (h[s].sum() + 2)  # noqa: E731,B023
        every = np.ones(200, bool)
        options = [((score(s) + score(~s) - score(every)) / 2 - 0.1, f, e) for f in range(6) for e in edges[f]
                   for s in [x[:, f] <= e] if h[s].sum() >= 3 and h[~s].sum() >= 3]
        gain, f, e = max(options, key=lambda o: o[0])
        assert gain > 0 and (tree.feature[0], tree.threshold[0]) == (f, e)
        left = x[:, f] <= e
        assert tree.value[tree.left[0], 0] == pytest.approx(-0.3 * shrink(g[left].sum()) / (h[left].sum() + 2), abs=1e-5)


def test_boosting_stops_early_and_in_both_ways_alike(spark):
    x, y = sample(400)
    y = np.where(np.random.default_rng(5).random(400) < 0.3, 0, y)
    stop = np.arange(400) % 5 == 0
    growth = T.Growth(boosted=True, depth=3, rate=0.5, rows=0.7, columns=0.7)
    rows = frame(spark, x, y, stop=stop)
    made = T.fit_boosted(rows, growth, 60, "label_index", "weight", "stop", patience=5)[0]
    assert 4 <= len(made.roots) < 4 * 60 and len(made.roots) % 4 == 0
    edges = T.quantile_edges(x, 8)
    a, b = (T.boost(state, growth, 2, 5, 4, 6, edges) for state in (
        T._Held([T.to_row(block(x, y, stop=stop, key=np.array([r[0] for r in spark.range(400).selectExpr("xxhash64(id)").collect()])), 0)], 4),
        T._Written(T.blocks_of(rows, "label_index", "weight", "stop"), 4)))
    assert same(a, b)
    assert len(T.fit_boosted(rows, growth, 3, "label_index", "weight")[0].roots) == 12


@pytest.mark.parametrize("build", [models.random_forest, models.extra_trees, lambda: models.boosted(rounds=60), models.perceptron])
def test_models_learn(spark, build):
    x, y = sample(1500)
    rows = frame(spark, x, y)
    model = build().fit(rows.where("row_id < 1000"))
    scored = models.as_predictions(model.transform(rows.where("row_id >= 1000")))
    assert scored.where("label = prediction").count() > 0.8 * 500
    assert scored.where("abs(aggregate(probability, 0D, (a, b) -> a + b) - 1) > 1e-9").count() == 0


def test_gradient_of_the_network():
    x, y = sample(30, 4)
    w = np.linspace(0.5, 2, 30)
    net = perceptron.Network.start((4, 5, 3, 4), 1)
    loss = lambda theta: -(w * np.log(perceptron.Network(net.widths, theta).probabilities(x)[np.arange(30), y])).sum()
    got = net.gradient(x, y, w)
    for i in range(0, len(got), 3):
        step = np.zeros_like(got)
        step[i] = 1e-5
        assert got[i] == pytest.approx((loss(net.theta + step) - loss(net.theta - step)) / 2e-5, abs=1e-4)


def test_perceptron_heeds_weights_and_stops(spark):
    x, y = sample(400, 4)
    wrong = np.r_[y[:200], (y[200:] + 1) % 4]
    rows = frame(spark, x, wrong, w=np.r_[np.ones(200), np.zeros(200)])
    model = models.perceptron(rate=0.01, held=0.0, epochs=80, patience=80).fit(rows)
    right = models.as_predictions(model.transform(frame(spark, x, y))).where("label = prediction").count()
    assert right > 340
    few = perceptron.Learning(epochs=40, patience=2, steps=2, batch=50, rate=0.01)
    blocks = T.blocks_of(frame(spark, x, y), "label_index", "weight")
    net = perceptron.train_written(blocks, (4, 16, 4), perceptron.Learning(hidden=(16,), epochs=12, patience=12, steps=2, rate=0.05))
    assert (net.probabilities(x).argmax(1) == y).mean() > 0.7
    epochs = []
    perceptron.train((4, 4, 4), few, lambda e, n: epochs.append(e) or [], lambda n: 0.5)
    assert epochs == [0, 1, 2]


def test_no_rows(spark):
    with pytest.raises(ValueError):
        models.random_forest().fit(frame(spark, *sample(3)).where(F.lit(False)))
