import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.functions import copies, ranking, scalars
from sluice.functions import columns
from sluice.operators import cleaning, dedup, encoding, labels, metrics, profiling, sampling, selection, vocabulary
from sluice.schemas import EXTRACTOR_COLUMNS, FEATURES, TIME_FEATURES, TrainingConfig

INF, NAN = float("inf"), float("nan")


def labelled(spark, names):
    return spark.createDataFrame([(n,) for n in names], "Label string")


def names(df):
    return sorted(r[0] for r in df.collect())


def test_schema_sizes():
    assert len(FEATURES) == 77 and len(EXTRACTOR_COLUMNS) == 74 and len(TIME_FEATURES) == 23


def test_label_in_both_splits_without_a_name_is_dropped_from_test(spark):
    train, test = labels.harmonise(labelled(spark, ["Portmap", "Syn"]), labelled(spark, ["Portmap", "Syn", "WebDDoS", "UDP-lag"]))
    assert names(train) == ["Portmap Flood", "TCP SYN Flood"]
    assert names(test) == ["TCP SYN Flood", "UDP-Lag Flood"]


def test_category_names_survive_only_when_not_strict(spark):
    df = labelled(spark, ["UDP Flood"])
    assert labels.rename_test(df).count() == 0 and labels.rename_test(df, strict=False).count() == 1


def test_unknown_class_is_an_error(spark):
    with pytest.raises(Exception, match="unknown class"):
        labels.encode(labelled(spark, ["a", "b"]), ["a"]).collect()


def test_anti_join_matches_null_and_nan(spark):
    train = spark.createDataFrame([(None, 1.0, "x"), (NAN, 2.0, "x"), (-0.0, 3.0, "x")], "a double, b double, Label string")
    test = spark.createDataFrame([(None, 1.0, "y"), (NAN, 2.0, "y"), (0.0, 3.0, "y"), (None, 2.0, "y")], train.schema)
    assert [(r["a"], r["b"]) for r in dedup.remove_seen_in_training(train, test).collect()] == [(None, 2.0)]
    assert dedup.seen_in_training(train, test).count() == 3


def test_keep_first_prefers_training_rows(spark):
    df = spark.createDataFrame([(1.0, 1, 7, "b"), (1.0, 0, 9, "a"), (1.0, 0, 8, "c")], "f double, split_rank int, id int, Label string")
    assert dedup.keep_first(df, ["f"], ["split_rank", "id"]).first()["Label"] == "c"


@pytest.mark.parametrize("n", [1, 2, 1001, 5000])
def test_narrowed_medians_are_exact(spark, n):
    rng = np.random.default_rng(n)
    a, b, c = rng.normal(size=n), rng.integers(0, 3, n).astype(float), np.full(n, 4.0)
    rows = [(float(x), float(y), float(z), None) for x, y, z in zip(a, b, c)] + [(NAN, INF, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = cleaning.exact_medians(df, list("abcd"), middle_values=5)
    assert got == {"a": np.median(a), "b": np.median(b), "c": 4.0, "d": None}
    assert cleaning.exact_medians(df, list("abcd")) == pytest.approx(got)


def test_text_infinity_becomes_null(spark):
    df = spark.createDataFrame([("inf", "2", "x"), ("bad", "1e3", "y")], ["flow_byts_s", " flow_duration ", "Label"])
    out = cleaning.normalise_flow_rows(df)
    assert out.columns[1:] == FEATURES
    assert [r["Flow Bytes/s"] for r in out.collect()] == [None, None]
    assert sorted(r["Flow Duration"] for r in out.collect()) == [2e6, 1e9]


def test_two_notions_of_constant(spark):
    df = spark.createDataFrame([(None, 1.0, None), (1.0, 1.0, None)], "gap double, one double, void double")
    assert selection.single_value_columns(df, df.columns) == ["gap", "one"]
    assert selection.constant_columns(df, df.columns) == ["one", "void"]


def test_dropped_columns_still_count_for_correlation():
    corr = np.array([[1, .95, .2], [.95, 1, .95], [.2, .95, 1]])
    assert selection.highly_correlated(list("abc"), corr, .9) == ["b", "c"]
    assert selection.highly_correlated(list("abc"), np.full((3, 3), NAN), .9) == []


def test_leakage_names():
    cols = ["Label", "Flow-ID", "transport", "Class", "Fwd Seg Size Min", "src_ip", "__source"]
    assert selection.leakage_columns(cols) == ["Label", "Flow-ID", "transport", "Class", "src_ip"]


def test_low_cardinality_is_exact(spark):
    df = spark.range(5000).selectExpr("id % 9 as nine", "id % 10 as ten", "id as many", "id % 12 as twelve")
    assert profiling.low_cardinality(df, df.columns, 10) == {"nine": 9}
    assert profiling.column_classes(df.withColumn("t", F.lit("x"))) == (["t", "nine"], ["ten", "many", "twelve"])


def test_scaling_without_range(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 3.0)], "c double, v double")
    assert [tuple(r) for r in encoding.apply_minmax(df, encoding.fit_minmax(df, ["c", "v"])).collect()] == [(0.0, 0.0), (0.0, 1.0)]


def test_holdout_sizes():
    assert holdout({"a": 7, "b": 3}) == 2
    assert sampling.holdout_quotas({"a": 50, "b": 30, "c": 20}, 0.2) == {"a": 10, "b": 6, "c": 4}


def holdout(counts):
    return sum(sampling.holdout_quotas(counts, 0.2).values())


def test_quota_is_exact(spark):
    df = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 'x' when id % 7 = 0 then 'y' else 'hot' end as g")
    quotas = {"x": 100, "y": 10_000, "hot": 0}
    got = ranking.take_quota(df, "g", quotas, ["id"], 1)
    counts = ranking.group_counts(df, "g")
    assert ranking.group_counts(got, "g") == {"x": 100, "y": counts["y"]}
    again = {r["id"] for r in got.collect()}
    assert again == {r["id"] for r in ranking.take_quota(df.repartition(7), "g", quotas, ["id"], 1).collect()}


def test_group_rank_is_a_permutation(spark):
    df = spark.range(2000).selectExpr("id", "if(id % 3 = 0, null, 'a') as g")
    rows = ranking.with_group_rank(df, "g", ["id"], 5).collect()
    for g in (None, "a"):
        ranks = sorted(r["rank"] for r in rows if r["g"] == g)
        assert ranks == list(range(1, len(ranks) + 1))


def test_attack_quotas():
    assert sampling.attack_quotas({"a": 5, "b": 3}, 10) == {"a": 5, "b": 3}
    # 100, 10 and 100 first; of the 90 left a gets round(90 * 900 / 1200) = round(67.5) = 68, half to even.
    assert sampling.attack_quotas({"a": 1000, "b": 10, "c": 400}, 300) == {"a": 168, "b": 10, "c": 122}
    # More classes than rows to give: every class still gets one.
    assert sum(sampling.attack_quotas({c: 9 for c in "abcdef"}, 3).values()) == 6
    rng = random.Random(0)
    for _ in range(200):
        counts = {c: rng.randint(1, 900) for c in "abcde"}
        total = rng.randint(5, sum(counts.values()))
        quota = sampling.attack_quotas(counts, total)
        assert sum(quota.values()) == total and all(1 <= q <= counts[c] for c, q in quota.items())


def test_balancing_sizes(spark):
    df = spark.range(2600).selectExpr("id", "case when id < 2000 then 'Benign' when id < 2550 then 'a' else 'b' end as Label")
    config = TrainingConfig(max_group_rows=400, min_attack_class_rows=120)
    out = sampling.balance_training(df, "Label", ["id"], config)
    assert ranking.group_counts(out, "Label") == {"Benign": 400, "a": 350, "b": 120}
    alone = df.where("Label <> 'Benign'")
    assert sampling.balance_binary(alone, "Label", ["id"], config).count() == 600


def test_folds(spark):
    df = spark.range(1000).selectExpr("id", "if(id % 10 = 0, 'r', 'c') as Label", "id % 40 as ip")
    sizes = sampling.stratified_folds(df, "Label", ["id"], 4).groupBy("Label", "fold").count().collect()
    assert {r["count"] for r in sizes if r["Label"] == "r"} == {25}
    grouped = sampling.group_folds(df, "Label", "ip", 4)
    assert grouped.groupBy("ip").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    assert {r["count"] for r in grouped.groupBy("fold").count().collect()} == {250}


def test_group_folds_differ_by_a_group_at_most(spark):
    rows = [(g, "a" if g % 3 else "b") for g in range(60) for _ in range(1 + (g * 7) % 23)] + [(99, None)] * 5
    df = spark.createDataFrame(rows, "ip long, Label string")
    folds = sampling.group_folds(df, "Label", "ip", 3).collect()
    assert len(folds) == len(rows)
    for c in "ab":
        sizes = [sum(r["fold"] == f and r["Label"] == c for r in folds) for f in range(3)]
        assert max(sizes) - min(sizes) <= 23


def test_number_copies(spark):
    df = spark.createDataFrame([(1.0, "x")] * 25 + [(NAN, None)] * 3 + [(2.0, "y")], "a double, b string")
    got = copies.number_copies(df, "n", chunk=10).collect()
    assert sorted(r["n"] for r in got if r["b"] == "x") == list(range(1, 26))
    assert sorted(r["n"] for r in got if r["b"] is None) == [1, 2, 3]
    assert len(got) == 29 and copies.number_copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_copies_get_their_share_of_a_sample(spark, seed):
    """Half of a class is one row."""
    df = spark.range(4000).selectExpr("cast(greatest(id, 2000) as double) as f", "'a' as Label")
    rows = copies.number_copies(df, "_copy")
    got = sampling.sample_per_class(rows, "Label", 600, ["f", "_copy"], seed)
    assert got.count() == 600 and 230 < got.where("f = 2000").count() < 370


def test_anti_join_aligns_types(spark):
    train = spark.createDataFrame([(1, "5", "x")], "a int, b string, Label string")
    test = spark.createDataFrame([(1.0, "5", "x"), (2.0, "5", "x")], "a double, b string, Label string")
    assert [r["a"] for r in dedup.remove_seen_in_training(train, test).collect()] == [2.0]


def test_best_of_equals_is_the_first(spark):
    table = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.1), ("d", None)], "Model string, m double")
    assert tuple(metrics.best_by(table, "m").first()) == ("a", 0.5)


def test_free_text_is_no_category(spark):
    df = spark.range(30).selectExpr("cast(id as string) as c")
    with pytest.raises(ValueError):
        encoding.fit_categories(df, ["c"], most=20)
    assert len(encoding.fit_categories(df, ["c"])["c"]) == 30


def test_many_categories_are_slots_of_a_sparse_vector(spark):
    """Half of all rows hold one value; nulls and unknown values give zeros."""
    df = spark.range(40_000).selectExpr("id", "if(id % 2 = 0, 'hot', concat('v', id)) as a", "if(id % 5 = 0, null, concat('w', id % 7)) as b")
    vocab = vocabulary.fit(df, ["a", "b"])
    assert vocabulary.sizes(vocab) == {"a": 20_001, "b": 7}
    of = {(r["column"], r["value"]): r["position"] for r in vocab.collect()}
    for c in "ab":
        assert [of[c, v] for v in sorted(v for d, v in of if d == c)] == list(range(vocabulary.sizes(vocab)[c]))
    more = df.unionByName(spark.createDataFrame([(-1, "new", None)], df.schema))
    rows = vocabulary.onehot_vector(more, ["a", "b"], vocab).where("id < 300").collect()
    assert len(rows) == 301
    for r in rows:
        want = [of["a", r["a"]]] if r["a"] != "new" else []
        want += [20_001 + of["b", r["b"]]] if r["b"] is not None else []
        assert r["features"].size == 20_008 and r["features"].indices.tolist() == want and set(r["features"].values) <= {1.0}


@pytest.mark.parametrize("most", [100, 10, 3])
def test_preprocessor_gives_the_same_with_categories_in_a_table(spark, tmp_path, most):
    df = spark.range(200).selectExpr("id", "id % 13 + 0.5 as x", "if(id % 9 = 0, null, concat('p', id % 4)) as a", "concat('q', id % 11) as b")
    model = encoding.FlowPreprocessor(ignoreCols=["id"], mostCategories=most).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    model = encoding.FlowPreprocessorModel.load(str(tmp_path / "m"))
    mode = model.getOrDefault("state")["modes"]["a"]
    names = {r["slot"]: r["name"] for r in model.feature_table(spark).collect()}
    assert sorted(names) == list(range(16)) and sorted(model.getOrDefault("state")["wide"]) == {100: [], 10: ["b"], 3: ["a", "b"]}[most]
    new = df.unionByName(spark.createDataFrame([(900, 2.0, "other", "other")], "id long, x double, a string, b string"), allowMissingColumns=True)
    for r in model.transform(new).collect():
        on = {names[int(i)] for i in r["features"].toArray().nonzero()[0]} - {"x"}
        assert on == (set() if r["id"] == 900 else {f"a_{r['a'] or mode}", f"b_{r['b']}"})


def test_addresses(spark):
    ips = ["239.1.1.1", "10.0.0.255", "223.0.0.1", "ff02::fb", "bad.255", "10.0.0.256", " 10.0.0.255", None, "01.2.3.255"]
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    noise = [r[0] for r in df.select(scalars.noise_destination(F.col("ip"))).collect()]
    assert noise == [True, True, False, True, False, False, True, False, False]
    valid = [r[0] for r in df.select(scalars.valid_ipv4(F.col("ip"))).collect()]
    assert valid == [True, True, True, False, False, False, False, False, True]


def test_column_facts_of_every_type(spark):
    df = spark.sql("""select * from values
      (1, 1.5D, cast(2.50 as decimal(5,2)), 'a', true, date'2020-01-01', array(1, 2), null),
      (null, double('NaN'), null, null, null, null, null, null),
      (2, double('inf'), 2.50, repeat('long', 5000), true, date'2020-01-02', array(1, 2), null),
      (3, -0.0D, 7.25, repeat('long', 5000), true, null, array(), null),
      (9007199254740993, 0.0D, 7.25, '', true, null, array(3), null) as t(`w.n`, d, m, s, b, day, arr, void)""").repartition(3)
    facts = columns.column_facts(df, limit=3)
    assert {c: (f.missing, f.infinite, f.distinct) for c, f in facts.items()} == {
        "w.n": (1, 0, 4), "d": (1, 1, 3), "m": (1, 0, 2), "s": (1, 0, 3), "b": (1, 0, 1), "day": (3, 0, 2), "arr": (1, 0, 3), "void": (5, 0, 0)}
    assert (facts["d"].finite_lo, facts["d"].finite_hi, facts["m"].finite_hi, facts["s"].finite_lo) == (0.0, 1.5, 7.25, None)
    assert all(f.rows == 5 for f in facts.values()) and facts["void"].is_constant and not facts["b"].is_constant
    assert {f.rows for f in columns.column_facts(df.limit(0)).values()} == {0}


def test_ordered_bits_keep_order_and_value():
    x = np.array([-INF, -1e300, -2.5, -5e-324, 0.0, 5e-324, 1.0, np.nextafter(1.0, 2.0), 1e300, INF])
    bits = columns.ordered_bits(x)
    assert (np.diff(bits) > 0).all() and [columns.from_ordered_bits(int(b)) for b in bits] == list(x)
    assert columns.ordered_bits(np.array([-0.0]))[0] == columns.ordered_bits(np.array([0.0]))[0]


def test_medians_of_merged_counts(spark, monkeypatch):
    monkeypatch.setattr(columns, "PENDING", 4)
    rng = np.random.default_rng(7)
    a = np.concatenate([rng.normal(size=700), -rng.lognormal(3, 4, 801)])
    df = spark.createDataFrame([(float(v),) for v in a], "a double").repartition(5)
    assert columns.exact_medians(df, ["a"], middle_values=3) == {"a": np.median(a)}
