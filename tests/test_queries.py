"""Every registered query against the same query in another SQL engine, and its plan."""

import __spark_entry__ as contract
import compare
import pytest

from basketlens.plans import catalog, oracle

QUERIES, ORACLES = catalog.queries(), oracle.oracle_sql()
# Iterative or approximate: covered by property tests, no SQL says the same.
ROWS_ONLY = {
    "profile_distinct_approx",
    "kmeans_segments",
    "predict_all_targets",
    "predict_all_first_slot",
    "rf_classify",
    "rf_regress",
}
MODELS = ROWS_ONLY - {"profile_distinct_approx"} | {"kmeans_invariants", "kmeans_with_id_invariants", "rf_invariants"}


@pytest.fixture(scope="module")
def duck(data):
    return compare.database(data)


def test_all_but_the_iterative_have_an_oracle():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, data, duck, name):
    got = compare.spark_table(QUERIES[name](spark, data))
    assert got[1], "a comparison of nothing proves nothing"
    assert compare.difference(got, compare.duck_table(duck, ORACLES[name])) is None


def test_approximate_distinct_counts(spark, data):
    exact = QUERIES["profile_distinct"](spark, data).first().asDict()
    for column, n in QUERIES["profile_distinct_approx"](spark, data).first().asDict().items():
        assert abs(n - exact[column]) <= max(1, 0.05 * exact[column]), column


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MODELS))
def test_plans_stay_in_the_jvm(spark, data, name):
    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    for slow in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups", "CartesianProduct"):
        assert slow not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_the_needed_columns(spark, data):
    plan = QUERIES["bin_age"](spark, data)._jdf.queryExecution().executedPlan().toString()
    for unused in ("l_extendedprice", "l_shipdate", "p_name", "c_mktsegment", "n_name"):
        assert unused not in plan


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[:4] == ["segment", "count", "pct", "avg_age"] and df.count() == 4
