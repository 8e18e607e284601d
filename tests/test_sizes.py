"""Faults that show only on tables larger than sf0.01, on small tables made to have them."""

import __spark_entry__ as entry
from compare import connect, differences
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import types as T

from sluice.operators import mitigation, vocabulary

SQL, QUERIES = entry.oracle_sql(), entry.queries()


def test_sources_numbered_past_255(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr(
        "event_id", "ts", "user_id + 1200 as user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    con = connect("/nowhere")
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert differences(spark, QUERIES["drop_rules_parse"], SQL["drop_rules_parse"], str(tmp_path), con) is None
    lines = spark.createDataFrame([("1 DROP all -- 10.0.0.1200 192.168.56.1",)], "value string")
    assert [r.ip for r in mitigation.dropped_addresses(lines).collect()] == ["192.168.56.1"]


def test_slots_of_wide_vectors_are_summed_sparsely(spark):
    """Vectors of two thousand million slots: a dense sum of them would take 16 GB."""
    wide = 2_000_000_000
    rows = [(Vectors.sparse(wide, {0: 1.0, wide - 1: 2.0}),), (Vectors.sparse(wide, {wide - 1: 3.0}),), (Vectors.sparse(wide, {}),),
            (Vectors.dense([4.0, 0.0]),), (Vectors.dense([]),), (None,)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("features", VectorUDT())]))
    got = {r.slot: r["sum"] for r in vocabulary.slot_sums(df).collect()}
    assert got == {0: 5.0, 1: 0.0, wide - 1: 5.0}


def test_wide_vectors_have_no_name_for_each_slot(spark):
    """Names of slots are metadata, which the driver holds."""
    df = spark.createDataFrame([("a",), ("b",), (None,), ("z",)], "k string")
    known = vocabulary.fit(df.where("k <> 'z'"), ["k"])
    out = vocabulary.onehot_vector(df, ["k"], known)
    assert not out.schema["features"].metadata
    assert {r.k: r.features for r in out.collect()} == {
        "a": Vectors.sparse(2, {0: 1.0}), "b": Vectors.sparse(2, {1: 1.0}), None: Vectors.sparse(2, {}), "z": Vectors.sparse(2, {})}


def test_final_fits_leave_no_candidate_or_search_out(monkeypatch):
    """The query itself takes too long for a test; this holds what it asks for."""
    from sluice.plans import model_queries

    class Asked(Exception):
        pass

    def asked(*given, **more):
        raise Asked(len(given), more)

    monkeypatch.setattr(model_queries.T, "train_and_rank", asked)
    monkeypatch.setattr(model_queries, "_train_test", lambda spark, sf: (None, None))
    monkeypatch.setattr(model_queries.workdir, "new_path", lambda spark, name: name)
    try:
        QUERIES["final_fit_select"].__closure__[0].cell_contents(None, "")
    except Asked as e:
        assert e.args == (4, {})
    else:
        raise AssertionError("nothing was fitted")
    for name in ("Random Forest", "KNN", "Extra Trees", "MLP Classifier", "XGBoost", "Random Forest + SMOTE", "Extra Trees + SMOTE"):
        assert f"'{name}'" in SQL["final_fit_select"]


def test_packets_become_flows_once_for_all_files(spark, monkeypatch):
    """Scoring reads the flows by family, in two more forms, and as they are; each read made them from all packets before."""
    from sluice.plans import source_queries

    asked = []

    def flows(spark, sf):
        asked.append(sf)
        return spark.createDataFrame([("Benign", 1.0), ("UDP", 2.0), ("LDAP", 3.0)], "Label string, `Flow Duration` double").where(
            source_queries.F.udf(lambda x: read.add(1) or True, "boolean")("Label"))

    read = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(source_queries, "labelled_features", flows)
    path = source_queries._feature_files(spark, "made-up")
    assert source_queries._staged_features(spark, "made-up").count() == 3
    assert asked == ["made-up"] and read.value == 3
    assert spark.read.parquet(f"{path}/Short-training.parquet").count() == 3
    assert spark.read.parquet(f"{path}/UDP-training.parquet").collect()[0]["Flow Duration"] == 2.0
