import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import metrics, scoring, trees
from riskloom.session import stage


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for i in range(400):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        y = int(rng.random() < 1 / (1 + np.exp(-(1.5 * a - b))))
        data.append((f"r{i}", a, b, y))
    return stage(spark.createDataFrame(data, "id string, a double, b double, y int"), "rows")


def test_linear_scorer_matches_newton(rows):
    scorer = scoring.train_scorer(rows, ["a", "b"], "y", family="linear")
    pdf = rows.toPandas()
    x = np.column_stack([pdf["a"], pdf["b"], np.ones(len(pdf))])
    y = pdf["y"].to_numpy()
    w = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    # The weighted sum of losses, c = 1, plus half the squared coefficients.
    lam = np.array([1.0, 1.0, 0.0])
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        gradient = x.T @ (w * (p - y)) + lam * beta
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(lam)
        beta -= np.linalg.solve(hessian, gradient)
    coefficients, intercept = scorer.linear_coefficients()
    assert [coefficients["a"], coefficients["b"], intercept] == pytest.approx(list(beta), abs=1e-4)


def test_tree_contributions_add_up_to_the_margin(rows):
    scorer = scoring.train_scorer(rows, ["a", "b"], "y", family="boosted_trees", trees=4, depth=3)
    nodes, weights = scorer.trees()
    out = trees.contribution_rows(rows, "id", ["a", "b"], nodes, weights).toPandas().set_index("id")
    margin = scorer.model.transform(scoring._assembled(rows, ["a", "b"]))
    from pyspark.ml.functions import vector_to_array

    raw = margin.select("id", vector_to_array("rawPrediction")[1].alias("m")).toPandas().set_index("id")["m"]
    assert np.allclose(out["raw_margin"], raw.loc[out.index])
    assert np.allclose(out["base"] + out["contribution_a"] + out["contribution_b"], out["raw_margin"])


def test_calibrators(rows):
    scored = rows.withColumn("p", 1 / (1 + F.exp(-(3 * F.col("a") - 2 * F.col("b")))))
    fitted, table = scoring.compare_calibrators(scored, scored, "p", "y")
    got = {r["method"]: r for r in table.collect()}
    assert got["isotonic"]["brier"] <= got["none"]["brier"] and got["platt"]["nll"] < got["none"]["nll"]
    assert scoring.best_method(table, "brier") == "isotonic"
    assert fitted["platt"].slope > 0
    with pytest.raises(ValueError):
        scoring.fit_calibrator(scored, "p", "y", "other")


def test_threshold_prefers_the_larger_of_equal_scores(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y int, p double")
    threshold, score = metrics.select_threshold(df, "y", "p")
    assert score == 1.0 and 0.79 < threshold <= 0.8


def test_null_baselines(spark):
    df = spark.createDataFrame([(y, 0.1 * i) for i, y in enumerate((0, 0, 0, 0, 1, 1))], "y int, p double")
    got = metrics.prediction_report(df, "y", "p", 0.35).first()
    assert got["null_prevalence"] == pytest.approx(1 / 3) and got["null_pr_auc"] == pytest.approx(1 / 3)
    assert got["null_roc_auc"] == 0.5 and got["pr_auc"] == 1.0 and got["recall_at_fpr"] == 1.0


def test_surrogate_rules_cover_each_row_once(rows):
    scored = rows.withColumn("score", 1 / (1 + F.exp(-(F.col("a")))))
    chosen, stats, fidelity = trees.fit_surrogate(scored, ["a", "b"], "score", max_rules=20)
    total = sum((r.truth() for r in chosen), F.lit(0.0))
    assert {r[0] for r in scored.select(total).distinct().collect()} == {1.0}
    assert fidelity.first()["r2"] > 0.8 and stats.agg(F.sum("rows")).first()[0] == 400


def test_reference_choice(spark):
    table = spark.createDataFrame(
        [("x", 1, 0.5, 0.2), ("x", 2, 0.7, 0.3), ("z", 1, 0.65, 0.1)], "family string, seed int, pr_auc double, brier double")
    assert scoring.reference_predictor(table) == ("x", 2) and scoring.reference_family(table) == "z"
    assert scoring.seed_summary(table, ["family"], ["pr_auc"]).filter("family = 'x'").first()["pr_auc_mean"] == pytest.approx(0.6)
