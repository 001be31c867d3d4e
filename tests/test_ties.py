"""Scores that differ in a last place only, and quantiles between equal values."""

import hashlib
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from riskloom.plans import metric_queries, policy_queries

CLOSE = (0.65, math.nextafter(0.65, 1))


def test_neighbouring_doubles_are_one_threshold(spark, monkeypatch):
    rows = spark.createDataFrame([(1, CLOSE[0]), (0, CLOSE[1]), (0, 0.2)], "label int, risk double")
    monkeypatch.setattr(metric_queries, "_test", lambda *_: rows)
    curve = {round(r["threshold"], 6): r["precision"] for r in metric_queries.pr_curve(spark, "").collect()}
    assert curve == {0.65: pytest.approx(0.5), 0.2: pytest.approx(1 / 3)}


def test_curve_rounds_half_way_values_like_its_sql(spark, monkeypatch):
    # Thresholds half-way between two places of six decimals, and precisions such as 1/640 and 3/3200.
    rows = [(i % 639 // 638, 0.5000005 + i / 1e6) for i in range(4000)]
    made = spark.createDataFrame(rows, "label int, risk double")
    monkeypatch.setattr(metric_queries, "_test", lambda *_: made)
    duck = duckdb.connect()
    duck.execute("create table roled (label int, risk double, role varchar)")
    duck.execute("insert into roled select (i % 639) // 638, 0.5000005::double + i / 1e6::double, 'test' from range(4000) r(i)")
    text = entry.oracle_sql()["pr_curve"]
    expected = duck.execute("with " + text[text.index("\n  s as materialized (select"):]).fetchall()
    got = [tuple(r) for r in entry.queries()["pr_curve"](spark, "").collect()]
    assert sorted(got) == sorted(expected)


def test_sweep_sql_keeps_ties_at_their_quantile(spark, monkeypatch):
    scores = [math.sqrt(i) / 20 for i in range(1, 60) for _ in range(60)]
    labels = [i % 3 // 2 for i in range(len(scores))]
    rows = spark.createDataFrame(list(zip(labels, scores)), "label int, risk double")
    monkeypatch.setattr(metric_queries, "_test", lambda *_: rows)
    duck = duckdb.connect()
    duck.execute("create table roled (label int, risk double, role varchar, txn_id varchar, alert boolean)")
    duck.executemany("insert into roled values (?, ?, 'test', '', true)", list(zip(labels, scores)))
    text = entry.oracle_sql()["threshold_sweep"]
    expected = duck.execute("with " + text[text.index("s as materialized (select"):]).fetchall()
    got = [(round(r["threshold"], 6), r["tp"], r["fp"]) for r in metric_queries.threshold_sweep(spark, "").collect()]
    assert sorted(got) == sorted(expected)


def test_last_places_do_not_decide_about_partners(spark, monkeypatch):
    ids = sorted("abcd", key=lambda i: hashlib.md5(i.encode()).hexdigest())
    # By digest the first selected row meets the first control; the last places would turn one side around.
    rows = spark.createDataFrame(
        [(ids[0], True, CLOSE[1]), (ids[1], True, CLOSE[0]), (ids[2], False, CLOSE[0]), (ids[3], False, CLOSE[1])],
        "txn_id string, selected boolean, risk double",
    ).withColumns({policy_queries.FOCUS: F.lit(0.5), "alert": F.lit(True), "label": F.lit(1)})
    both = rows.withColumn("role", F.lit("test")).union(rows.withColumn("role", F.lit("policy_select")))
    monkeypatch.setattr(policy_queries, "evidenced", lambda *_: both)
    monkeypatch.setattr(policy_queries, "focused", lambda found: found)
    pairs = {r["selected_id"]: r["control_id"] for r in policy_queries.matched_cells(spark, "").collect()}
    assert pairs == {ids[0]: ids[2], ids[1]: ids[3]}
