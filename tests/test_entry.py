"""Driver contract and plan checks over every registered query (sf0.001)."""

import pytest

import __spark_entry__ as E
from lexiforge.plans import queries as core
from tests.conftest import SF

# Queries whose operator runs Python by design (Arrow batches, not per row).
PYTHON_OK = {"dense_topk", "cell_search", "hybrid_search", "format_results", "prompt_messages", "fuzzy_match",
             "index_search", "prompt_batch", "padded_batches"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["uuid", "builder", "question", "answer"]
    assert df.count() > 0


def test_every_core_query_has_sql():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert set(core.QUERIES) <= set(q)
    assert set(core.QUERIES) <= set(s)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_plan(spark, name):
    df = E.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON_OK:
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
        assert "MapInPandas" not in plan and "PythonMapInArrow" not in plan
    assert df.count() >= 0
