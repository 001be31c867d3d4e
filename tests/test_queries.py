"""Registered queries: SQL agreement on the smallest tables, and plan checks."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, table

SAMPLE = ["history_bundle", "timestamp_safe_split", "rule_quality", "explanations_topk", "rule_selection", "policy_candidates", "block_bootstrap"]


@pytest.fixture(scope="module")
def duck(tiny):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, tiny, name):
    df = entry.queries()[name](spark, tiny)
    cursor = duck.execute(entry.oracle_sql()[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([d[0] for d in cursor.description], cursor.fetchall())


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_truth_projection_is_one_stage_over_pruned_columns(spark, tiny):
    df = entry.queries()["rule_truth"](spark, tiny)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # The fitted category risks are a small table, joined without a shuffle of the rows.
    assert "Exchange hashpartitioning" not in plan and "BatchEvalPython" not in plan and "receiver_prior_total" not in plan


def test_plain_history_needs_two_shuffles(spark, tiny):
    from riskloom.operators.history import payment_trails, with_history
    from riskloom.plans import binding
    from riskloom.session import stage

    rows = stage(binding.transactions(spark, tiny), "rows")
    plan = with_history(rows, payment_trails())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
