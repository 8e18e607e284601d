import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sluice import workdir
from sluice.operators import alerts, encoding, metrics, mitigation, models, monitor, neighbours
from sluice.plans import training
from sluice.schemas import EVENT_FIELDS, LEGACY_EVENT_FIELDS, PACKET_SCHEMA, FlowParams
from sluice.sources import eventlog, registry
from sluice.streaming import decisions, flows as stream_flows, runs
from test_flows import packet

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def events(spark, rows):
    return spark.createDataFrame([(i, T0 + timedelta(seconds=t), s, "UDP Flood", 0.99, True) for i, (s, t) in enumerate(rows)],
                                 "event_id long, ts timestamp, src_ip string, prediction string, confidence double, is_attack boolean")


def greedy(rows, cooldown):
    last, out = {}, set()
    for i, (s, t) in sorted(enumerate(rows), key=lambda x: (x[1][1], x[0])):
        if s not in last or t - last[s] >= cooldown:
            last[s] = t
            out.add(i)
    return out


def test_cooldown_example(spark):
    rows = [("a", t) for t in (0, 5, 14.9, 15, 20, 29.99, 30)]
    got = alerts.alerts_after_cooldown(events(spark, rows))
    assert sorted(r["id"] for r in got.collect()) == [0, 3, 6]


@pytest.mark.parametrize("rows_a_chunk, fan_in", [(40, 2), (150, 3), (900, 16), (10 ** 6, 16)])
def test_cooldown_equals_the_walk_across_chunks(spark, monkeypatch, rows_a_chunk, fan_in):
    """One source with most events, in chunks that hold from a part of a cooldown to all events."""
    monkeypatch.setattr(alerts, "CHUNK_ROWS", rows_a_chunk)
    monkeypatch.setattr(alerts, "FAN_IN", fan_in)
    rng, t, rows = random.Random(rows_a_chunk), 0.0, []
    for _ in range(4000):
        t += rng.choice([0, 0.001, 0.5, 1, 3, 14.999, 15, 40]) * rng.choice([0, 0, 1])
        rows.append(("hot" if rng.random() < 0.8 else rng.choice(["a", "b", None]), round(t, 3)))
    got = [r["id"] for r in alerts.alerts_after_cooldown(events(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == greedy(rows, 15)


@pytest.mark.parametrize("step", [0.01, 5, 15, 16])
def test_cooldown_of_even_events_whose_chains_never_meet(spark, monkeypatch, step):
    monkeypatch.setattr(alerts, "CHUNK_ROWS", 60)
    monkeypatch.setattr(alerts, "FAN_IN", 2)
    rows = [("hot", round(i * step, 3)) for i in range(2000)]
    assert {r["id"] for r in alerts.alerts_after_cooldown(events(spark, rows)).collect()} == greedy(rows, 15)


def test_without_cooldown_every_time_alerts(spark, monkeypatch):
    monkeypatch.setattr(alerts, "CHUNK_ROWS", 3)
    rows = [("a", t) for t in (0, 1, 1, 2, 3, 4, 5)] + [("b", 1)]
    got = alerts.alerts_after_cooldown(events(spark, rows), cooldown_seconds=0)
    assert sorted(r["id"] for r in got.collect()) == [0, 1, 3, 4, 5, 6, 7]


def test_cooldown_without_events_or_times(spark):
    assert alerts.alerts_after_cooldown(events(spark, [("a", 1)]).limit(0)).count() == 0
    no_time = events(spark, [("a", 1), ("a", 2)]).withColumn("ts", F.when(F.col("event_id") == 1, F.col("ts")))
    assert [r["id"] for r in alerts.alerts_after_cooldown(no_time).collect()] == [1]


def test_block_retries_until_success(spark):
    df = events(spark, [("a", 2), ("a", 1), ("a", 3), ("b", 1)]).withColumn("ok", F.col("event_id").isin(0, 2))
    got = {r["event_id"]: (r["attempted"], r["blocked"]) for r in
           mitigation.block_first_per_source(df, success="ok").collect()}
    assert got == {1: (True, False), 0: (True, True), 2: (False, False), 3: (True, False)}


def test_monitor_without_source_but_with_labels_is_empty(spark):
    assert monitor.live_events(spark.createDataFrame([("x",)], "actual_label string")).count() == 0


def test_event_log_forms(spark):
    missing = eventlog.read_events(spark, workdir.new_path(spark, "none"))
    assert missing.count() == 0 and monitor.load(missing).count() == 0
    path = workdir.new_path(spark, "legacy")
    spark.createDataFrame([tuple("x" for _ in LEGACY_EVENT_FIELDS)], LEGACY_EVENT_FIELDS).write.option("header", True).csv(path)
    row = eventlog.read_events(spark, path).first()
    assert row["dst_ports"] is None and row["src_ip"] == "x"
    assert not eventlog.ensure_log(spark, path) and eventlog.ensure_log(spark, path)
    assert spark.read.option("header", True).csv(path).columns == EVENT_FIELDS


def predictions(spark, labels, scores, n):
    rows = [(int(y), int(np.argmax(s)), [float(v) for v in s]) for y, s in zip(labels, scores)]
    return spark.createDataFrame(rows, "label int, prediction int, probability array<double>")


def brute_auc(y, s):
    pos, neg = s[y], s[~y]
    return float(np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos]))


def test_auc_with_ties(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 3, 600), rng.integers(0, 40, (600, 3)) / 40
    got = {r["class"]: r["auc"] for r in metrics.class_auc(predictions(spark, y, s, 3), 3).collect()}
    for c in range(3):
        assert got[c] == pytest.approx(brute_auc(y == c, s[:, c]), abs=1e-12)


def test_auc_undefined_without_a_class(spark):
    p = predictions(spark, [0, 1, 0], [[.5, .3, .2]] * 3, 3)
    assert metrics.roc_auc_weighted(p, 3).first()[0] is None


def test_zero_division_counts_as_zero(spark):
    p = predictions(spark, [0, 0], [[0, 1.0], [1.0, 0]], 2)
    got = {r["class"]: (r["precision"], r["recall"], r["support"]) for r in metrics.per_class(metrics.confusion(p)).collect()}
    assert got == {0: (1.0, 0.5, 2), 1: (0.0, 0.0, 0)}


@pytest.mark.parametrize("block", [20, 2000])
def test_neighbours_are_exact(spark, monkeypatch, block):
    """Clustered points, a third of them the same, cells cut into small blocks."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
    monkeypatch.setattr(neighbours, "QUERIES_PER_TASK", 40)
    rng = np.random.default_rng(2)
    refs = np.concatenate([rng.normal(c, 1, (60, 4)) for c in (0, 4, 9)] + [np.full((90, 4), 2.0)])
    queries = rng.normal(4, 4, (50, 4))

    def points(m, prefix):
        return spark.createDataFrame([("g", f"{prefix}{i:04d}", [float(x) for x in v], i % 3) for i, v in enumerate(m)],
                                     "grp string, id string, vec array<double>, tag int")

    got = {r["id"]: [n["rid"] for n in r["near"]] for r in
           neighbours.nearest(points(queries, "q"), points(refs, "r"), 7, block_rows=block).collect()}
    d = ((queries[:, None] - refs[None]) ** 2).sum(axis=2)
    for i in range(len(queries)):
        assert got[f"q{i:04d}"] == [f"r{j:04d}" for j in np.lexsort((np.arange(len(refs)), d[i]))[:7]]


def test_neighbours_of_copies_without_oneself(spark, monkeypatch):
    """Whole numbers with many ties and copies, several cells and turns: as all pairs, ties by id, oneself left out."""
    monkeypatch.setattr(neighbours, "QUERIES_PER_TASK", 40)
    rng = np.random.default_rng(5)
    m = np.concatenate([rng.integers(0, 9, (400, 3)), np.full((150, 3), 4)]).astype(float)
    grp = rng.integers(0, 2, len(m))
    rows = [(f"g{g}", f"{i:04d}", [float(x) for x in v], i % 3) for i, (g, v) in enumerate(zip(grp, m))]
    rows += [("g0", "nan", [float("nan")] * 3, 0), ("g1", "inf", [float("inf")] * 3, 0)]
    points = spark.createDataFrame(rows, "grp string, id string, vec array<double>, tag int")
    got = {r["id"]: [(n["rid"], n["dist"]) for n in r["near"]] for r in
           neighbours.nearest(points, points, 5, exclude_self=True, block_rows=20).collect()}
    assert len(got) == len(m)
    for i in range(len(m)):
        d = np.where((grp == grp[i]) & (np.arange(len(m)) != i), np.sqrt(((m - m[i]) ** 2).sum(axis=1)), np.inf)
        assert got[f"{i:04d}"] == [(f"{j:04d}", d[j]) for j in np.lexsort((np.arange(len(m)), d))[:5]]


def test_distances_of_a_query_do_not_grow_with_the_rows(monkeypatch):
    plain, seen = neighbours._squared, []

    def counted(a, b):
        seen.append(len(a) * len(b))
        return plain(a, b)

    monkeypatch.setattr(neighbours, "_squared", counted)
    rng, per_query = np.random.default_rng(6), []
    for n in (4_000, 32_000):
        seen.clear()
        m = rng.integers(0, 3_000, (n, 3)).astype(float)
        query, row, dist = neighbours._Block(m, np.arange(n), 11).nearest(m[::20], np.full(len(m[::20]), np.inf))
        assert len(query) == 11 * len(m[::20]) and (np.bincount(query[dist == 0]) >= 1).all()
        per_query.append(sum(seen) / len(m[::20]))
    assert per_query[1] < 1.5 * per_query[0] and per_query[1] < 3_000


def test_smote_fills_up_between_neighbours(spark):
    rng = np.random.default_rng(4)
    rows = [(0, f"a{i}", [float(v) for v in rng.normal(0, 1, 2)]) for i in range(60)]
    rows += [(1, f"b{i}", [float(v) for v in rng.normal(9, 1, 2)]) for i in range(12)]
    out = neighbours.smote(spark.createDataFrame(rows, "y int, id string, vec array<double>"), "y", "id")
    made = [r for r in out.collect() if r["id"].startswith("synthetic")]
    assert len(made) == 48 and out.count() == 120
    low, high = np.min([r[2] for r in rows if r[0]], axis=0), np.max([r[2] for r in rows if r[0]], axis=0)
    assert all((np.array(r["vec"]) >= low).all() and (np.array(r["vec"]) <= high).all() for r in made)
    with pytest.raises(ValueError):
        neighbours.smote(spark.createDataFrame(rows[:63], "y int, id string, vec array<double>"), "y", "id")


def flow_table(spark, n=600):
    return spark.range(n).selectExpr(
        "cast(id % 100 as double) as a", "cast(id % 100 as double) * 3 as a3", "cast(hash(id) % 50 as double) as b",
        "if(id % 9 = 0, double('Infinity'), cast(id % 13 as double)) as c", "1.0D as k", "cast(id as string) as `Flow ID`",
        "if(id % 4 = 0, null, concat('t', id % 3)) as t", "if(id % 100 < 50, 'Benign', 'UDP') as Label", "id")


def test_static_path_splits_rows_written_before(spark, monkeypatch):
    """The hold-out reads its rows several times, so they come from a table and not from the removal of duplicates."""
    from sluice.operators import sampling
    from sluice.plans import bindings as B
    marked, seen = sampling.mark_holdout, []
    monkeypatch.setattr(sampling, "mark_holdout", lambda df, *rest: seen.append(df) or marked(df, *rest))
    sf = "/root/testdata/sf0.001"
    encoding.preprocess_static(B.raw_train(spark, sf), B.raw_test(spark, sf), ["l_orderkey", "l_linenumber"], B.FEATURE_COLS)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_preprocessor_round_trip(spark):
    df = flow_table(spark)
    model = encoding.FlowPreprocessor(ignoreCols=["Label", "id"]).fit(df)
    assert model.dropped_columns() == {"leakage": ["Flow ID"], "constant": ["k"], "high_correlation": ["a3"]}
    assert model.feature_names() == ["a", "b", "c", "t_t0", "t_t1", "t_t2"]
    path = workdir.new_path(spark, "pre")
    model.save(path)
    again = encoding.FlowPreprocessorModel.load(path)
    unseen = df.withColumn("t", F.lit("new")).drop("b")
    for d in (df, unseen):
        a, b = (m.transform(d).orderBy("id").select(vector_to_array("features")).collect() for m in (model, again))
        assert a == b
    assert again.transform(unseen).select(vector_to_array("features")).first()[0][3:] == [0.0, 0.0, 0.0]


def test_models_round_trip(spark):
    rows = flow_table(spark).selectExpr("cast(id as string) as row_id", "a", "b", "if(Label = 'UDP', 1, 0) as label_index", "1.0D as weight")
    pre = encoding.FlowPreprocessor(ignoreCols=["row_id", "label_index", "weight"]).fit(rows)
    ready = pre.transform(rows)
    from pyspark.ml import PipelineModel
    for est in (models.boosted(rounds=8, rate=0.3), models.random_forest(trees=20), models.extra_trees(trees=20, min_leaf=1),
                models.perceptron(epochs=60, rate=0.01), neighbours.KnnClassifier(k=3, nClasses=2)):
        model = PipelineModel([pre, est.fit(ready)])
        folder = workdir.new_path(spark, "m")
        registry.save_model(model, "My Model!", folder)
        again = registry.load_model("my_model", folder)
        got = [sorted(r for r in m.transform(rows).select("row_id", "prediction").collect()) for m in (model, again)]
        assert got[0] == got[1]
        assert metrics.summarise(models.as_predictions(again.transform(rows))).first()["accuracy"] > 0.95


def test_settings_are_drawn_without_repetition():
    drawn = models.draw_settings(models.FOREST_GRID, 20, 1)
    assert len({tuple(d.items()) for d in drawn}) == 20 and drawn == models.draw_settings(models.FOREST_GRID, 20, 1)


def test_training_rows_keep_test_apart(spark):
    df = flow_table(spark).drop("id", "Flow ID")
    splits = training.prepare_splits(df.limit(400), df)
    features = ["a", "a3", "b", "c", "k", "t"]
    seen = {tuple(r) for r in splits.train.select(features).collect()}
    left = [tuple(r) for r in splits.test.select(features).collect()]
    assert left and not seen & set(left)
    assert splits.classes == ["Benign", "UDP Flood"]


def stream_over(spark, df, schema, n_files):
    """The frame as files that arrive one per trigger, in time order."""
    path = workdir.new_path(spark, "stream-in")
    for i in range(n_files):
        df.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
    return runs.read_files(spark, path, schema, files_per_trigger=1)


def test_stream_of_many_files_equals_batch(spark):
    rng, t, rows = random.Random(5), 0.0, []
    for i in range(300):
        t += rng.choice([0.05, 0.3, 1.0, 4.0, 12.0, 20.0])
        rows.append(packet(i, t, dport=rng.choice([80, 81])))
    df = spark.createDataFrame(rows, PACKET_SCHEMA)
    parted = df.withColumn("part", (F.col("pkt_id") / 60).cast("int"))
    params = FlowParams(min_packets=6)
    got = runs.drain(stream_flows.tick_flows(stream_over(spark, parted, PACKET_SCHEMA, 5), params), "t").collect()
    from sluice.operators.flows import aggregate_flows_on_ticks
    batch = aggregate_flows_on_ticks(df, params)
    cols = ["dst_port", "first_ts", "last_ts", "fwd_n", "fwd_iat_sum", "ended_by"]
    want = {tuple(r) for r in batch.select(cols).collect()}
    emitted = {tuple(r[c] for c in cols) for r in got}
    assert len(emitted) == len(got) and emitted <= want
    # Only the flows still open at the end are missing, at most one per endpoint pair.
    assert len(want) - len(emitted) <= 2


def test_stream_decisions_over_many_files(spark):
    rng = random.Random(6)
    rows = sorted(((rng.choice("aab"), round(rng.random() * 200, 2)) for _ in range(200)), key=lambda r: r[1])
    df = events(spark, rows)
    parted = df.withColumn("part", (F.col("event_id") / 50).cast("int"))
    alerts_out = runs.drain(decisions.alerts_after_cooldown(stream_over(spark, parted, df.schema, 4)), "a")
    assert {r["id"] for r in alerts_out.collect()} == greedy(rows, 15)
    blocks = runs.drain(decisions.block_first_per_source(stream_over(spark, parted, df.schema, 4)), "b")
    want = {r["event_id"] for r in mitigation.block_first_per_source(df).where("blocked").collect()}
    assert blocks.count() == 200 and {r["event_id"] for r in blocks.where("blocked").collect()} == want


def test_stream_alerts_with_late_events(spark):
    """Bursts of a source in any order of files alert as in the batch; mixed events never twice within a cooldown."""
    rng = random.Random(8)
    bursts = [(s, 40 * k, rng.randrange(4)) for s in "abc" for k in range(12)]
    placed = [((s, t + d), part) for s, t, part in bursts for d in (0, 4, 9)]
    df = events(spark, [row for row, _ in placed])
    part = F.element_at(F.array(*[F.lit(p) for _, p in placed]), F.col("event_id").cast("int") + 1)
    got = runs.drain(decisions.alerts_after_cooldown(stream_over(spark, df.withColumn("part", part), df.schema, 4)), "late")
    want = {r["id"] for r in alerts.alerts_after_cooldown(df).collect()}
    assert len(want) == 36 and {r["id"] for r in got.collect()} == want

    mixed = events(spark, [("a", rng.random() * 300) for _ in range(120)]).withColumn("part", (F.col("event_id") % 4).cast("int"))
    times = sorted(r["ts_us"] for r in runs.drain(decisions.alerts_after_cooldown(stream_over(spark, mixed, df.schema, 4)), "mixed").collect())
    assert len(times) > 8 and all(b - a >= 15_000_000 for a, b in zip(times, times[1:]))


def test_alerts_of_many_keys_take_few_calls(spark):
    """Keys share calls and state: two of one bucket, and one without a source, keep their own silences over triggers."""
    rows = [(f"s{i % 300}" if i % 300 else None, 7.0 * (i // 300)) for i in range(1500)]
    df = events(spark, rows).withColumn("part", (F.col("event_id") / 600).cast("int"))
    query = runs.start_table(decisions.alerts_after_cooldown(stream_over(spark, df, df.schema, 3)),
                             workdir.new_path(spark, "many"), workdir.new_path(spark, "many-checkpoint"))
    query.awaitTermination()
    told = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert 0 < max(told) <= decisions.BUCKETS < 300
    got = runs.drain(decisions.alerts_after_cooldown(stream_over(spark, df, df.schema, 3)), "many").collect()
    assert {r["id"] for r in got} == greedy(rows, 15) and len(got) == 600
    assert sum(r["src_ip"] is None for r in got) == 2
