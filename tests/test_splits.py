
import pytest
from pyspark.sql import functions as F

from riskloom.operators import sampling, splits


def timeline(spark, n=600, step=1, tie=1):
    base = F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / tie) * step)
    return spark.range(n).select(
        F.col("id").cast("string").alias("txn_id"), base.alias("event_time"), (F.col("id") % 2).cast("int").alias("label")
    )


def nearest(boundaries, desired, low, high):
    return min((b for b in boundaries if low <= b <= high), key=lambda b: (abs(b - desired), b))


@pytest.mark.parametrize("tie", [1, 7])
def test_timestamp_safe_cuts(spark, tie):
    n = 600
    cuts = splits.timestamp_safe_cuts(timeline(spark, n, tie=tie))
    edges = [i for i in range(1, n) if i % tie == 0]
    a = nearest(edges, round(n * 0.6), 1, n - 2)
    b = nearest(edges, round(n * 0.8), a + 1, n - 1)
    inner, low, m = [], 1, b - a
    for left, share in zip((3, 2, 1), (0.25, 0.5, 0.75)):
        cut = nearest([e - a for e in edges if a < e < b], round(m * share), low, m - left)
        inner.append(a + cut)
        low = cut + 1
    assert list(cuts.rows_before) == [a, *inner, b]
    rows = splits.with_roles(timeline(spark, n, tie=tie), cuts)
    per = {r["role"]: r for r in rows.groupBy("role").agg(F.min("event_time").alias("lo"), F.max("event_time").alias("hi")).collect()}
    for earlier, later in zip(splits.ROLES, splits.ROLES[1:]):
        assert per[earlier]["hi"] < per[later]["lo"]


def test_too_few_rows_or_timestamps(spark):
    with pytest.raises(ValueError, match="40 rows"):
        splits.timestamp_safe_cuts(timeline(spark, 39))
    with pytest.raises(ValueError, match="distinct timestamps"):
        splits.timestamp_safe_cuts(timeline(spark, 100, tie=100))
    with pytest.raises(ValueError, match="sum to 1"):
        splits.timestamp_safe_cuts(timeline(spark), (0.5, 0.2, 0.2))


def test_row_split_shares(spark):
    out = splits.temporal_rows_split(timeline(spark, 600), (0.5, 0.25, 0.25), time="event_time", row_id="txn_id")
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {
        "train": 300, "validation": 150, "test": 150}
    summary = {r["split"]: r for r in splits.split_integrity(out, time="event_time").collect()}
    assert summary["train"]["time_group_count"] == 300
    assert all(r["group_disjoint"] for r in summary.values())


def test_overlap_is_reported(spark):
    df = spark.createDataFrame([(1, "train"), (2, "train"), (2, "test"), (3, "test")], "m int, split string")
    summary = {r["split"]: r for r in splits.split_integrity(df, time="m").collect()}
    assert not summary["test"]["group_disjoint"]
    assert {(r["time_group"], r["split"]) for r in splits.split_groups(df, time="m").where("shared").collect()} == {(2, "train"), (2, "test")}


def test_rows_without_a_class_or_group_stay(spark):
    df = spark.range(400).select(F.col("id").alias("i"), F.when(F.col("id") % 4 > 0, F.col("id") % 2).alias("y"))
    out = splits.stratified_split(df, (0.6, 0.2, 0.2), target="y", row_id="i")
    assert {(r["y"], r["split"]): r["count"] for r in out.groupBy("y", "split").count().collect()} == {
        (y, s): n for y, k in ((None, 100), (0, 100), (1, 200)) for s, n in (("train", k * 6 // 10), ("validation", k // 5), ("test", k // 5))}
    sample = sampling.group_quota_sample(df, "y", 9, row_id="i")
    assert {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()} == {None: 3, 0: 3, 1: 3}


def test_time_groups_from_a_table(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(9)], "i int, m int")
    table = spark.createDataFrame([(0, "train"), (1, "validation"), (2, "test")], "m int, split string")
    out = splits.time_group_split(df, table, time="m")
    assert {(r["m"], r["split"]) for r in out.collect()} == {(0, "train"), (1, "validation"), (2, "test")}


def test_stratified_split_keeps_class_shares(spark):
    df = spark.range(1000).select(F.col("id").alias("i"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    out = splits.stratified_split(df, (0.6, 0.2, 0.2), target="y", row_id="i")
    counts = {(r["split"], r["y"]): r["count"] for r in out.groupBy("split", "y").count().collect()}
    assert counts[("train", 1)] == 120 and counts[("validation", 1)] == 40 and counts[("test", 0)] == 160


def test_group_split_errors(spark):
    df = spark.createDataFrame([(m,) for m in (0, 1, 2, 3)], "month int")
    with pytest.raises(ValueError, match="unassigned"):
        splits.time_group_split(df, {"train": [0], "validation": [1], "test": [2]}, time="month")
    with pytest.raises(ValueError, match="absent"):
        splits.time_group_split(df, {"train": [0, 1], "validation": [2], "test": [3, 9]}, time="month")
    with pytest.raises(ValueError, match="disjoint"):
        splits.time_group_split(df, {"train": [0], "validation": [0], "test": [1]}, time="month")
    with pytest.raises(ValueError, match="None"):
        splits.time_group_split(df.union(df.limit(1).selectExpr("cast(null as int)")), {"train": [0, 1], "validation": [2], "test": [3]}, time="month")


def test_class_guard(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1)], "role string, y int")
    with pytest.raises(ValueError, match="b"):
        splits.require_both_classes(df, role="role", target="y")


def test_systematic_sample_keeps_both_ends(spark):
    out = sampling.systematic_sample(timeline(spark, 500), 37, time="event_time", row_id="txn_id")
    got = sorted(int(r["txn_id"]) for r in out.collect())
    assert got == [i * 499 // 36 for i in range(37)] == sampling.systematic_positions(500, 37)
    with pytest.raises(ValueError):
        sampling.systematic_sample(timeline(spark, 10), 1, time="event_time", row_id="txn_id")


def test_group_quota_with_a_dominant_group(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 900, 0).otherwise(F.col("id") % 4).alias("m"))
    out = sampling.group_quota_sample(df, "m", 42, row_id="id")
    assert {r["m"]: r["count"] for r in out.groupBy("m").count().collect()} == {0: 11, 1: 11, 2: 10, 3: 10}


def test_halves_and_thirds(spark):
    df = timeline(spark, 100)
    halves = splits.chronological_halves(df, time="event_time", row_id="txn_id")
    assert halves.filter("partition = 'fit'").agg(F.max("event_time")).first()[0] < halves.filter("partition = 'select'").agg(
        F.min("event_time")).first()[0]
    thirds = splits.chronological_thirds(df, time="event_time", row_id="txn_id")
    assert {r["partition"]: r["count"] for r in thirds.groupBy("partition").count().collect()} == {
        "calibrator_fit": 40, "calibrator_selection": 30, "threshold_selection": 30}
