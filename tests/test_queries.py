"""Registered queries: against their SQL, and their plans."""

import pytest

import __spark_entry__ as entry_module
from tests.conftest import SF_DIR
from verification.compare import compare, connect
from verification.oracles import ORACLES
from verification.queries import QUERIES


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, connection, name):
    result = compare(spark, connection, SF_DIR, name)
    assert result.startswith(("equal", "rows only")), result


def test_registry():
    assert set(ORACLES) <= set(QUERIES) <= set(entry_module.queries())
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    row = entry_module.entry(spark).first()
    assert row.n_pairs == 200 and row.f1 > 0.5


PLUGIN = {"token_encoder_run", "rewrite_options", "generation_options", "embed_model", "plugin_scoring", "rewrite_model", "generated_code", "predict_linear", "chunk_classifier_run", "generation_run"}


@pytest.mark.parametrize("name", QUERIES)
def test_plan(spark, name):
    """No cross join anywhere; Python only where a model is plugged in."""
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert ("EvalPython" in plan) == (name in PLUGIN)
    assert "pythonUDF1" not in plan  # a model is called once per row


def test_columns_are_pruned(spark):
    plan = QUERIES["text_metrics"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
