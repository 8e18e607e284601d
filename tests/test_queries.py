"""Every registered query against its SQL equivalent, on the smallest data set."""

import pytest

import __spark_entry__ as entry
from compare import connect, differences

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
QUERIES = entry.queries()
# Queries that train models or run all of a batch take minutes; tools/check.py runs them, with all others. The same models
# are fitted on less in test_trees.py.
SLOW = {"batch_run_tables", "final_fit_select", "random_search", "score_flows", "train_live_lab", "train_extra_trees", "train_gbt",
        "train_random_forest"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_equals_sql(spark, con, name):
    assert differences(spark, QUERIES[name], SQL[name], SF, con) is None


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["protocol_no"] for r in rows} == {6, 17}


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
