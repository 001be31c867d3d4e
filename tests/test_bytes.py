"""What the audit queries shuffle and write."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators import matching, policy, predictors, ranks
from riskloom.plans import binding, model_queries, policy_queries, predictor_queries
from riskloom.sources import readers

NAMES = {"risk": "risk", "alert": "alert", "row_id": "id"}


@pytest.fixture(scope="module")
def scores(spark):
    rows = [(f"r{i}", i % 5 > 0, (i * 7 % 11) / 11, 0.5 if i % 3 else (i % 13) / 13, i % 2) for i in range(400)]
    return spark.createDataFrame(rows, "id string, alert boolean, risk double, m double, y int").cache()


def test_rows_of_a_global_rank_are_shuffled_once(scores):
    plan = ranks.with_global_rank(scores, [("m", "desc"), ("risk", "desc")], "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    # Digests are derived behind the shuffle.
    assert plan.index("md5(") < plan.index("Exchange hashpartitioning") and "__tie#" not in plan[plan.index("Exchange hashpartitioning"):]


@pytest.mark.parametrize("method", ["m", policy.SCORE_ONLY])
def test_marks_are_the_first_rows_of_the_ranking(scores, method):
    ranked = policy.ranked_alerts(scores, ["m"], **NAMES)
    marks = policy.top_marks(scores, method, [0, 1, 57, 1000], **NAMES)
    for n, mark in marks.items():
        expected = {r["id"] for r in policy.select_top(ranked, method, n).collect()}
        assert {r["id"] for r in scores.filter(mark).collect()} == expected


def test_quantiles_group_only_the_rows_of_wanted_buckets(spark, monkeypatch):
    written = []
    monkeypatch.setattr(ranks, "stage", lambda df, label="": written.append(label) or df)
    df = spark.range(1000).select((F.col("id") * 37 % 1000).cast("double").alias("x"))
    assert ranks.exact_quantiles(df, {"x": [0.5]}) == {"x": {0.5: 499.5}}
    assert not written


def test_carried_labels_equal_joined_ones(scores):
    alerts = scores.filter("alert").withColumn("chosen", F.col("m") > 0.4)
    how = {"selected": "chosen", "risk": "risk", "evidence": "m", "row_id": "id", "edges": [0.5], "caliper": 0.05}
    plain = matching.match_in_cells(alerts, **how)
    joined = matching.pair_outcomes(plain, alerts, row_id="id", label="y")
    carried = matching.match_in_cells(alerts, carry=["y"], **how).withColumnsRenamed({"selected_y": "selected_label", "control_y": "control_label"})
    assert carried.drop("selected_label", "control_label").columns == plain.columns
    assert matching.matched_summary(carried).collect() == matching.matched_summary(joined).collect()


def test_audit_table_holds_no_derived_columns(spark, tiny):
    stored = binding.measured(spark, tiny)
    assert not {"txn_id", "risk", "alert", "amount_relative_difference"} & set(stored.columns)


def test_model_columns_and_marked_alerts_are_not_copied(spark, tiny, monkeypatch):
    binding.audit(spark, tiny)
    rows = policy_queries.evidenced(spark, tiny, "test")
    written = []
    for module in (model_queries, policy_queries):
        monkeypatch.setattr(module, "stage", lambda df, label="": written.append(label) or df)
    model_queries.prepared(spark, tiny)
    policy_queries.focused(rows)
    assert not written


def test_payments_are_written_before_they_are_checked(spark, tiny, monkeypatch):
    seen = []
    check = readers.require_time
    monkeypatch.setattr(readers, "require_time", lambda df, c: seen.append(df) or check(df, c))
    raw = binding.transactions(spark, tiny).withColumnsRenamed({v: k for k, v in readers.PAYMENT_COLUMNS.items() if k not in ("Account", "Account.1")})
    readers.load_payments(raw.drop("sender_balance_before"))
    assert "Join" not in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_a_rank_within_groups_is_shuffled_once(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("id"), (F.col("id") % 2).alias("g"), F.sqrt("id").alias("m"), F.cbrt("id").alias("n"))
    plan = ranks.with_global_rank(df, [("m", "desc"), ("n", "desc")], "id", partition=["g"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_frozen_predictors_are_not_copied(spark, tiny, monkeypatch):
    written = []
    monkeypatch.setattr(predictors, "stage", lambda df, label="": written.append(label) or df)
    predictor_queries.predictor_attribution(spark, tiny)
    predictor_queries.predictor_audit(spark, tiny)
    assert not written
