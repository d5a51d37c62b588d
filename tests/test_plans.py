"""Physical-plan properties of the registered queries."""
import pytest

import __spark_entry__ as E
from lethe.registry import QUERIES

SF = "/root/testdata/sf0.001"
PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas",
            "MapInPandas", "MapInArrow")
CARTESIAN = ("CartesianProduct", "BroadcastNestedLoopJoin")
STREAMING = {"stream_suppress", "stream_audit_daily", "stream_audit_daily_exact", "stream_suppress_live"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMING))
def test_no_python_and_no_cartesian(spark, name):
    p = _plan(QUERIES[name](spark, SF))
    assert not any(n in p for n in PY_NODES), name
    assert not any(n in p for n in CARTESIAN), name


def test_filters_and_pruning_reach_the_scan(spark):
    df = E.queries()["lookback_filter"](spark, SF)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in p and "ReadSchema" in p
    # only the columns the derivation needs are read from orders
    assert "o_totalprice" not in p


def test_few_subjects_are_pushed_into_the_scan(spark):
    from lethe.operators.subjects import prefilter
    from lethe.session import scratch_path
    path = scratch_path(spark, "pushdown")
    spark.range(1000).selectExpr("concat('u', id, '@x.org') AS customer_email", "id").write.parquet(path)
    t = spark.read.parquet(path)
    subj = spark.createDataFrame([("u1@x.org",), ("u7@x.org",)], "customer_email string")
    df = prefilter(t, ["customer_email"], subj)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in p and "In(customer_email" in p
    assert sorted(r.id for r in df.collect()) == [1, 7]
