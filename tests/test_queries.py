import pytest

import __spark_entry__ as e
from oracle import connect, mismatch
from quayline.plans.registry import ORACLES, QUERIES

SF = "sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = e.queries()[name](spark, f"/root/testdata/{SF}")
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "InPandas", "InArrow"):
        assert bad not in plan
    assert mismatch(con, df, e.oracle_sql()[name]) is None


def test_entry(spark):
    rows = e.entry(spark).collect()
    counts = {r.event_type: r.rows for r in rows}
    assert set(counts) == {"click", "view", "signup", "purchase", "error", "all"}
    assert sum(counts.values()) == 2 * counts["all"] == 2000
