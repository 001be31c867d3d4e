import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskloom.operators.history import Trail, ledger_trails, payment_trails, with_history
from riskloom.sources import readers, synthetic
from riskloom.session import stage

LIMITS = [10**9, 0]  # plain windows, and the two-level plan


def rows_of(spark, rows):
    return stage(
        spark.createDataFrame(rows, "txn_id string, event_time timestamp, sender_account_id string, "
                                    "receiver_account_id string, amount double"), "rows")


@pytest.mark.parametrize("limit", LIMITS)
def test_hand_computed_case(spark, limit):
    start = datetime(2025, 1, 1)
    df = rows_of(spark, [("a", start, "s", "r", 10.0), ("b", start, "s", "r", 20.0),
                         ("c", start + timedelta(hours=1), "s", "r", 30.0)])
    got = {r["txn_id"]: r for r in with_history(df, ledger_trails(), plain_limit=limit).collect()}
    assert [got[i]["sender_prior_transaction_count"] for i in "abc"] == [0, 0, 2]
    assert [got[i]["receiver_prior_total_amount"] for i in "abc"] == [0, 0, 30]
    assert [got[i]["pair_prior_transaction_count"] for i in "abc"] == [0, 0, 2]
    assert [got[i]["sender_seconds_since_previous"] for i in "abc"] == [None, None, 3600.0]


@pytest.mark.parametrize("limit", LIMITS)
def test_hot_key_matches_brute_force(spark, limit):
    """One sender holds a third of the rows, many of them at one timestamp; some keys are null."""
    rng = random.Random(5)
    start = datetime(2025, 1, 1)
    rows = []
    for i in range(600):
        sender = "hot" if i % 3 == 0 else (None if i % 17 == 0 else f"s{rng.randint(0, 20)}")
        minute = 100 if i % 6 == 0 else rng.randint(0, 200)
        amount = None if i % 29 == 0 else rng.randint(1, 9999) / 100
        rows.append((f"t{i}", start + timedelta(minutes=minute), sender, f"r{rng.randint(0, 3)}", amount))
    got = {r["txn_id"]: r for r in with_history(rows_of(spark, rows), ledger_trails(), plain_limit=limit).collect()}
    assert len(got) == len(rows)
    for txn, time, sender, receiver, _ in rows:
        past = [r for r in rows if r[2] == sender and r[1] < time]
        assert got[txn]["sender_prior_transaction_count"] == len(past)
        assert got[txn]["sender_prior_total_amount"] == pytest.approx(sum(r[4] or 0.0 for r in past))
        last = max((r[1] for r in past), default=None)
        assert got[txn]["sender_seconds_since_previous"] == (None if last is None else (time - last).total_seconds())
        assert got[txn]["pair_prior_transaction_count"] == len([r for r in past if r[3] == receiver])


def test_labels_do_not_enter_history(spark):
    raw = synthetic.payments(spark, 120)
    flipped = raw.withColumn("Is Laundering", 1 - F.col("Is Laundering"))
    columns = ["txn_id", "sender_prior_transaction_count", "sender_prior_total_amount_paid",
               "receiver_seconds_since_previous", "pair_prior_transaction_count"]
    key = F.md5(F.concat_ws("|", "Timestamp", "From Account", "Amount Paid"))
    a, b = (readers.load_payments(x.withColumn("txn_id", key)).select(columns) for x in (raw, flipped))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_mixed_plan_uses_both_paths(spark):
    start = datetime(2025, 1, 1)
    rows = [(f"t{i}", start + timedelta(minutes=i % 40), "hot" if i % 2 else f"s{i}", f"r{i}", 1.0) for i in range(200)]
    df = rows_of(spark, rows)
    mixed = with_history(df, ledger_trails(), plain_limit=50)
    plain = with_history(df, ledger_trails())
    assert mixed.select(sorted(mixed.columns)).exceptAll(plain.select(sorted(plain.columns))).count() == 0
    assert payment_trails()[0].keys and Trail(("a",)).count is None
