import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators.metrics import average_ranks, rank_correlation, ranking_metrics, score_cells
from riskloom.operators.ranks import _cuts_from_quantiles, exact_quantiles, prefix_sums, with_global_rank
from riskloom.session import stage


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one first key, a third of those one second key."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        a = 5.0 if i % 3 == 0 else round(rng.uniform(0, 10), 3)
        b = 1.0 if i % 9 == 0 else rng.randint(0, 50) / 10
        rows.append((f"id{i}", a, b, rng.randint(0, 1), rng.randint(0, 3)))
    return stage(spark.createDataFrame(rows, "id string, a double, b double, y int, w int"), "skewed")


def by_hand(rows, key):
    return {r["id"]: i + 1 for i, r in enumerate(sorted(rows, key=key))}


def digest(text):
    from hashlib import md5

    return md5(text.encode()).hexdigest()


def test_cuts_give_heavy_values_their_own_bucket():
    cuts = _cuts_from_quantiles([1.0, 2.0, 2.0, 2.0, 5.0])
    assert cuts.splits[0] == -math.inf and cuts.splits[-1] == math.inf
    (point,) = cuts.points
    assert cuts.splits[point] == 2.0 and cuts.splits[point + 1] == math.nextafter(2.0, math.inf)


def test_global_rank_is_exact_under_skew(skewed):
    rows = skewed.collect()
    wanted = by_hand(rows, lambda r: (-r["a"], r["b"], digest(r["id"])))
    got = {r["id"]: r["rank"] for r in with_global_rank(skewed, [("a", "desc"), ("b", "asc")], "id").collect()}
    assert got == wanted


def test_hot_first_key_is_subdivided(skewed):
    """No window group of the ranking plan holds much more than its share."""
    from riskloom.operators import ranks

    seen = {}
    original = ranks.Window.partitionBy

    def spy(*columns):
        seen["columns"] = columns
        return original(*columns)

    ranks.Window.partitionBy = spy
    try:
        with_global_rank(skewed, [("a", "desc"), ("b", "asc")], "id")
    finally:
        ranks.Window.partitionBy = original
    assert [c for c in seen["columns"] if isinstance(c, str)] == ["__k0_l", "__k1_l", "__tie_l"]


@pytest.mark.parametrize("partitions", [1, 4, 32])
def test_rank_does_not_depend_on_partitions(spark, skewed, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        ranked = with_global_rank(skewed.repartition(partitions), [("a", "asc")], "id", partition=["y"])
        got = ranked.agg(F.sum(F.col("rank") * F.pmod(F.xxhash64("id"), F.lit(1000)))).first()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    rows = skewed.collect()
    wanted = {}
    for y in (0, 1):
        wanted |= by_hand([r for r in rows if r["y"] == y], lambda r: (r["a"], digest(r["id"])))
    again = with_global_rank(skewed, [("a", "asc")], "id", partition=["y"])
    assert {r["id"]: r["rank"] for r in again.collect()} == wanted
    assert got == again.agg(F.sum(F.col("rank") * F.pmod(F.xxhash64("id"), F.lit(1000)))).first()[0]


def test_weighted_rank_counts_earlier_weight(skewed):
    rows = sorted(skewed.collect(), key=lambda r: (-r["a"], digest(r["id"])))
    wanted, total = {}, 0
    for r in rows:
        wanted[r["id"]] = total
        total += r["w"]
    got = with_global_rank(skewed, [("a", "desc")], "id", weight="w").collect()
    assert {r["id"]: r["rank_before"] for r in got} == wanted


def test_prefix_sums(spark):
    cells = stage(spark.createDataFrame([(float(i % 50) + i / 100, i) for i in range(200)], "k double, n int"), "cells")
    got = {r["k"]: (r["n_before"], r["n_total"]) for r in prefix_sums(cells, "k", {"n": "n"}).collect()}
    rows = sorted((r["k"], r["n"]) for r in cells.collect())
    total = sum(n for _, n in rows)
    running = 0
    for k, n in rows:
        assert got[k] == (running, total)
        running += n


def test_exact_quantiles_match_numpy(skewed):
    rows = skewed.toPandas()
    levels = [0.0, 0.1, 0.5, 0.975, 1.0]
    got = exact_quantiles(skewed, {"a": levels, "b": levels})
    for c in ("a", "b"):
        assert [got[c][q] for q in levels] == pytest.approx(list(np.quantile(rows[c], levels)), abs=1e-12)


def test_quantiles_skip_missing_values(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (1.0,), (3.0,)], "x double")
    assert exact_quantiles(df, {"x": [0.5]}) == {"x": {0.5: 2.0}}
    assert exact_quantiles(df.filter("x is null"), {"x": [0.5]}) == {"x": {0.5: None}}


def brute_ranking(y, p, limit=0.01):
    order = sorted(set(p), reverse=True)
    pos, neg = sum(y), len(y) - sum(y)
    ap, best, last = 0.0, 0.0, 0.0
    for t in order:
        tp = sum(1 for a, b in zip(y, p) if b >= t and a)
        fp = sum(1 for a, b in zip(y, p) if b >= t and not a)
        ap += (tp / pos - last) * tp / (tp + fp)
        last = tp / pos
        if fp / neg <= limit + 1e-12:
            best = max(best, tp / pos)
    wins = sum((a > b) + 0.5 * (a == b) for a, u in zip(p, y) if u for b, v in zip(p, y) if not v)
    return ap, wins / pos / neg, best


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ranking_metrics_match_brute_force(spark, seed):
    rng = random.Random(seed)
    y = [rng.randint(0, 1) for _ in range(120)]
    p = [round(rng.random() * 0.6 + 0.3 * a, 1 if seed == 1 else 3) for a in y]
    df = spark.createDataFrame(list(zip(y, p)), "y int, p double")
    got = ranking_metrics(score_cells(df, "p", "y"), target_fpr=0.05).first()
    assert (got["pr_auc"], got["roc_auc"], got["recall_at_fpr"]) == pytest.approx(brute_ranking(y, p, 0.05))


def test_one_class_has_no_roc(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, p double")
    got = ranking_metrics(score_cells(df, "p", "y")).first()
    assert got["roc_auc"] is None and got["recall_at_fpr"] is None and got["pr_auc"] == 1.0


def test_rank_correlation(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 9) / 10, rng.randint(0, 9) / 10) for _ in range(80)]
    df = spark.createDataFrame(rows, "a double, b double")
    import pandas as pd

    wanted = pd.DataFrame(rows).rank().corr().iloc[0, 1]
    assert rank_correlation(df, "a", "b").first()[0] == pytest.approx(wanted)
    assert rank_correlation(df.withColumn("b", F.lit(1.0)), "a", "b").first()[0] is None
    ranks = {r["a"]: r["a_rank"] for r in average_ranks(df, "a").collect()}
    assert ranks == pytest.approx(dict(zip(pd.Series([a for a, _ in rows]), pd.Series([a for a, _ in rows]).rank())))


def test_null_partitions_are_partitions_of_their_own(spark):
    df = spark.createDataFrame([(i, (None, "a", "b")[i % 3], float(i % 7)) for i in range(60)], "id int, g string, v double")
    out = with_global_rank(df, [("v", "asc")], "id", partition=["g"]).collect()
    assert len(out) == 60 and all(sorted(r["rank"] for r in out if r["g"] == g) == list(range(1, 21)) for g in (None, "a", "b"))
    cells = df.groupBy("g", "v").count()
    sums = prefix_sums(cells, "v", {"n": "count"}, partition=["g"]).collect()
    assert len(sums) == 21 and {r["n_total"] for r in sums} == {20}
