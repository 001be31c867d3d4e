import pytest
from pyspark.sql import functions as F

from riskloom.functions.keys import normalize_key
from riskloom.functions.semantics import metadata_time
from riskloom.operators import contracts, counterfactual, joins, preprocess, profile, rules, sampling
from riskloom.sources import artifacts, readers, synthetic
from riskloom.streaming.score import explain_stream, write_stream


def test_key_normalisation(spark):
    df = spark.createDataFrame([(12.0, " 12 ", 12), (12.5, "   ", 7), (None, None, None)], "a double, b string, c int")
    got = df.select(*[normalize_key(df, c).alias(c) for c in df.columns]).collect()
    assert [tuple(r) for r in got] == [("12", "12", "12"), ("12.5", None, "7"), (None, None, None)]


def test_metadata_time_is_parsed_not_run(spark):
    texts = ["{'t': datetime.datetime(2024, 2, 29, 23, 59, 58, 123456)}", "datetime.datetime(2024, 1, 2)",
             "datetime.datetime(2024, 13, 2)", "__import__('os')", None]
    df = spark.createDataFrame([(t,) for t in texts], "m string")
    got = [r[0] for r in df.select(metadata_time(F.col("m")).cast("string")).collect()]
    assert got == ["2024-02-29 23:59:58.123456", "2024-01-02 00:00:00", None, None, None]


def test_payment_load_with_profiles(spark, tmp_path):
    raw = synthetic.payments(spark, 60)
    raw.coalesce(1).write.option("header", True).csv(f"{tmp_path}/tx.csv")
    out = readers.read_payments(spark, f"{tmp_path}/tx.csv", profiles=synthetic.payment_profiles(spark))
    assert out.count() == 60
    row = joins.profile_coverage(out, ["sender", "receiver"]).first()
    assert (row["sender_coverage"], row["receiver_coverage"]) == (1.0, 1.0)
    assert {"sender_prior_transaction_count", "amount_relative_difference", "cross_bank"} <= set(out.columns)


def test_duplicate_account_headers(spark, tmp_path):
    (tmp_path / "tx.csv").write_text(
        "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,"
        "Payment Format,Is Laundering\n2025-01-01 00:00:00,1,A,2,B,10,EUR,10,EUR,Wire,0\n2025-01-01 00:01:00,1,A,2,B,20,EUR,20,EUR,Wire,1\n")
    out = readers.read_payments(spark, str(tmp_path / "tx.csv"))
    assert sorted((r["sender_account_id"], r["receiver_account_id"], r["pair_prior_transaction_count"]) for r in out.collect()) == [
        ("A", "B", 0), ("A", "B", 1)]


def test_payment_errors(spark):
    raw = synthetic.payments(spark, 20)
    with pytest.raises(KeyError, match="label"):
        readers.load_payments(raw.drop("Is Laundering"))
    with pytest.raises(ValueError, match="duplicates"):
        readers.load_payments(raw.withColumn("Account", F.lit("x")))
    with pytest.raises(ValueError, match="binary"):
        readers.load_payments(raw.withColumn("Is Laundering", F.lit(2)))
    with pytest.raises(ValueError, match="not_null"):
        readers.load_payments(raw.withColumn("Timestamp", F.lit("soon")))
    person = synthetic.payment_profiles(spark)["person"]
    with pytest.raises(ValueError, match="unique"):
        joins.combine_profiles({"person": person.unionByName(person)}, readers.PROFILE_KEYS)


def test_custom_map_works_in_both_directions():
    raw = ["when", "x"]
    assert readers.effective_columns(raw, {}, {"when": "event_time"}) == {"when": "event_time"}
    assert readers.effective_columns(raw, {}, {"event_time": "when"}) == {"when": "event_time"}


def test_ledger_load(spark):
    out = readers.load_ledger(synthetic.ledger(spark, 80))
    kept = contracts.feature_columns(out.columns, contracts.LEDGER_DENYLIST)
    contracts.require_no_leakage(kept, contracts.LEDGER_DENYLIST)
    assert not {"fraud_probability", "sender_balance_after", "reported_hour", "auxiliary_fraud_label", "label"} & set(kept)
    assert out.agg(F.max("amount_to_sender_balance_fraction")).first()[0] <= 10.0
    with pytest.raises(ValueError, match="metadata"):
        readers.load_ledger(synthetic.ledger(spark, 8).withColumn("metadata", F.lit("none")))
    with pytest.raises(ValueError, match="denied"):
        contracts.require_no_leakage(["ISFRAUD"], contracts.LEDGER_DENYLIST)


def test_identity_join(spark):
    tx = spark.createDataFrame([(i, i * 10) for i in (1, 2, 3, 4)], "TransactionID long, v long")
    identity = spark.createDataFrame([(2, "a"), (4, "b")], "TransactionID long, DeviceType string")
    joined = joins.identity_join(tx, identity, "TransactionID")
    assert joined.count() == 4 and joins.coverage(joined, "has_identity").first()[0] == 0.5
    with pytest.raises(ValueError, match="must be unique"):
        joins.identity_join(tx, identity.unionByName(identity), "TransactionID")
    with pytest.raises(ValueError, match="contract"):
        joins.checked_join(tx, identity, ["TransactionID"], validate="x")


def test_card_and_application_loads(spark):
    cards = readers.load_card_transactions(synthetic.card_transactions(spark, 200), synthetic.card_identity(spark, 200))
    row = cards.agg(F.min("transaction_hour"), F.max("transaction_hour"), F.avg(F.col("has_identity").cast("int"))).first()
    assert row[0] >= 0 and row[1] <= 23 and row[2] == 0.5
    loaded = readers.load_applications(synthetic.applications(spark, 800))
    assert loaded.count() == 800
    capped = sampling.group_quota_sample(loaded, "month", 80, row_id="row_id")
    assert {r["month"]: r["count"] for r in capped.groupBy("month").count().collect()} == {m: 10 for m in range(8)}


def test_sentinels_are_counted_apart(spark):
    df = spark.createDataFrame([(0.1,), (-1.0,), (0.9,), (None,), (float("nan"),)], "income double")
    row = profile.missingness(df, ["income"], {"income": -1.0}).first()
    assert (row["missing_cells"], row["sentinel_cells"]) == (2, 1)
    assert profile.exact_duplicates(spark.createDataFrame([(1,), (1,), (2,)], "a int")).first()["duplicate_rows"] == 1


def test_contract_violations(spark):
    df = spark.createDataFrame([(1, 0.5, True, True), (2, 1.5, True, False), (None, None, False, False)], "y int, p double, s boolean, a boolean")
    got = {r["contract"]: r["violations"] for r in contracts.contract_violations(
        df, binary=["y"], unit_interval=["p"], not_null=["y"], subset={"s": "a"}).collect()}
    assert got == {"binary:y": 2, "unit_interval:p": 2, "not_null:y": 1, "subset:s<=a": 1}


def test_fingerprints_ignore_order_and_see_changes(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("txn_id"), (F.col("id") % 2).alias("v"))
    a = artifacts.table_fingerprint(df).first()
    assert a == artifacts.table_fingerprint(df.orderBy(F.desc("txn_id")).repartition(7)).first()
    changed = df.withColumn("v", F.when(F.col("txn_id") == "3", 9).otherwise(F.col("v")))
    assert a != artifacts.table_fingerprint(changed).first()
    one = df.withColumn("coverage", F.lit(0.5))
    before, after = (artifacts.selection_signature(x) for x in (one, one.filter("txn_id <> '3'")))
    assert artifacts.changed_selections(before, before).count() == 0
    assert artifacts.changed_selections(before, after).count() == 1


def test_stored_scores_are_verified(spark, tmp_path):
    scores = spark.range(20).select(
        F.col("id").cast("string").alias("txn_id"), F.lit("test").alias("split"), (F.col("id") % 2).cast("int").alias("y"),
        F.lit(0.5).alias("raw"), F.lit(0.5).alias("calibrated"))
    artifacts.write_scores(scores, f"{tmp_path}/s", {"scorer": "x"})
    assert artifacts.read_scores(spark, f"{tmp_path}/s").count() == 20
    artifacts.write_table(scores.withColumn("raw", F.lit(0.6)), f"{tmp_path}/s/scores")
    with pytest.raises(ValueError, match="do not match"):
        artifacts.read_scores(spark, f"{tmp_path}/s")
    rows = scores.select("txn_id", (1 - F.col("y")).alias("label")).filter("txn_id <> '0'")
    assert artifacts.alignment_mismatches(scores, rows).count() == 20


def test_lineage_finds_changed_outputs(spark, tmp_path):
    outputs = {"a": spark.range(5).toDF("x"), "b": spark.range(3).toDF("x")}
    artifacts.write_outputs(outputs, str(tmp_path))
    assert artifacts.changed_outputs(spark, str(tmp_path)) == []
    artifacts.write_table(spark.range(4).toDF("x"), f"{tmp_path}/b")
    assert artifacts.changed_outputs(spark, str(tmp_path)) == ["b"]


def test_reports_of_several_runs(spark, tmp_path):
    for run, columns in (("r1", "metric,value\nauc,0.5\n"), ("r2", "metric,value,extra\nauc,0.6,1\n")):
        (tmp_path / run).mkdir()
        (tmp_path / run / "predictive_metrics.csv").write_text(columns)
    out = readers.collect_reports(spark, [f"{tmp_path}/{r}/predictive_metrics.csv" for r in ("r1", "r2")])
    assert sorted((r["run"], r["extra"]) for r in out.collect()) == [("r1", None), ("r2", "1")]


def test_json_safe(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "v double")
    assert [r[0] for r in artifacts.json_safe(df).collect()] == [None, None, 1.0]


def test_counterfactual_contracts(spark):
    columns = ["a", "a_log"]
    counterfactual.check_contract({"a": [{"output": "a_log", "formula": "log1p_nonnegative", "inputs": ["a"]}]}, columns)
    for spec, text in (
        ({"output": "a_log", "formula": "other", "inputs": ["a"]}, "unknown formula"),
        ({"output": "a_log", "formula": "log1p_nonnegative", "inputs": ["a", "a"]}, "takes 1"),
        ({"output": "a_log", "formula": "log1p_nonnegative", "inputs": ["a"], "apply": len}, "not a function"),
        ({"output": "zzz", "formula": "log1p_nonnegative", "inputs": ["a"]}, "unknown columns"),
    ):
        with pytest.raises(ValueError, match=text):
            counterfactual.check_contract({"a": [spec]}, columns)


def test_counterfactual_tail_is_found(spark):
    train = spark.range(200).select(
        F.col("id").cast("double").alias("a"), F.log1p(F.col("id").cast("double")).alias("a_log"), F.lit(1.0).alias("flat"))
    contract = {"a": [{"output": "a_log", "formula": "log1p_nonnegative", "inputs": ["a"]}]}
    tails = counterfactual.counterfactual_tails(
        train, lambda v: v["a"] / 1000 + v["a_log"] / 10, ["a", "flat", "none"], inputs=["a", "a_log", "flat"],
        contract=contract, min_tail_rows=5)
    got = {r["feature"]: r for r in tails.collect()}
    assert got["a"]["selected"] and got["a"]["direction"] == "high" and got["a"]["train_median"] == 99.5
    assert got["flat"]["reason"] == "non_varying_or_non_numeric" and got["none"]["reason"] == "missing_from_training_frame"
    assert counterfactual.counterfactual_definitions(tails)[0]["name"] == "counterfactual_high_a"
    with pytest.raises(ValueError, match="cannot be set"):
        counterfactual.counterfactual_tails(train, lambda v: v["a"], ["pair_prior_transaction_count"], inputs=["a"])


def test_preprocessor(spark):
    train = spark.createDataFrame([(1.0, "b"), (3.0, "a"), (None, "a"), (5.0, None)], "n double, c string")
    fitted = preprocess.fit_preprocessor(train, ["n", "c"])
    later = spark.createDataFrame([(None, None), (5.0, "zzz")], "n double, c string")
    got = later.select(*[c.alias(k) for k, c in fitted.columns().items()]).collect()
    assert got[0]["x_n"] == pytest.approx(0.0) and got[0]["x_c"] == 0.0 and got[1]["x_c"] == -1.0
    assert got[1]["x_n"] == pytest.approx(2 / 2**0.5)


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(40).select(F.col("id"), (F.col("id") * 3.0).alias("amount"), (F.col("id") % 2).cast("int").alias("y"))
    rows.write.parquet(f"{tmp_path}/in")
    base = rules.fit_rules(rows, [{"name": "big", "conditions": [{"feature": "amount", "operator": "greater_quantile", "value": 0.5}]}], "y")
    stream = explain_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), base)
    query = write_stream(stream.select("id", "rule__big", "active_rule_count"), f"{tmp_path}/out", f"{tmp_path}/ckpt")
    query.awaitTermination(120)
    batch = explain_stream(rows, base).select("id", "rule__big", "active_rule_count")
    assert spark.read.parquet(f"{tmp_path}/out").exceptAll(batch).count() == 0
