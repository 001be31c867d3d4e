"""Ranking, calibration and threshold metrics of a scored table."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.fuzzy import clip_probability
from riskloom.operators.ranks import exact_quantiles, prefix_sums
from riskloom.session import stage, with_constants


def score_cells(
    df: DataFrame, score: str, label: str, *, partition: Sequence[str] = (), weight: Column | None = None
) -> DataFrame:
    """Positives and negatives per distinct score, written once."""
    w = F.lit(1) if weight is None else weight
    y = F.col(label)
    cells = df.groupBy(*partition, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(y == 1, w).otherwise(0)).cast("bigint").alias("pos"),
        F.sum(F.when(y == 1, 0).otherwise(w)).cast("bigint").alias("neg"),
    )
    return stage(cells, "score-cells")


def cumulative_counts(cells: DataFrame, *, partition: Sequence[str] = ()) -> DataFrame:
    """Running true and false positives as the threshold falls; tied scores move together."""
    running = prefix_sums(cells, "score", {"pos": "pos", "neg": "neg"}, partition=partition, descending=True)
    return running.select(
        *partition,
        "score",
        "pos",
        "neg",
        (F.col("pos_before") + F.col("pos")).alias("tp"),
        (F.col("neg_before") + F.col("neg")).alias("fp"),
        F.col("pos_total").alias("positives"),
        F.col("neg_total").alias("negatives"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def ranking_metrics(
    cells: DataFrame, *, partition: Sequence[str] = (), target_fpr: float = 0.01
) -> DataFrame:
    """Average precision, ROC-AUC (ties half) and recall at a false-positive rate."""
    c = cumulative_counts(cells, partition=partition)
    pos, neg, tp, fp = (F.col(x).cast("double") for x in ("pos", "neg", "tp", "fp"))
    all_pos, all_neg = F.col("positives").cast("double"), F.col("negatives").cast("double")
    precision_step = pos * tp / (tp + fp)
    pairs = pos * (all_neg - fp + neg / 2)
    recall = F.when((all_neg > 0) & (fp / all_neg <= target_fpr + 1e-12), tp / all_pos)
    per = c.groupBy(*partition).agg(
        F.max("positives").alias("positives"),
        F.max("negatives").alias("negatives"),
        F.sum(F.when(tp + fp > 0, precision_step)).alias("__ap"),
        F.sum(pairs).alias("__pairs"),
        F.max(recall).alias("__recall"),
    )
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return per.select(
        *partition,
        "positives",
        "negatives",
        _ratio(F.col("__ap"), F.col("positives")).alias("pr_auc"),
        F.when(both, F.col("__pairs") / F.col("positives") / F.col("negatives")).alias("roc_auc"),
        F.when(both, F.coalesce(F.col("__recall"), F.lit(0.0))).alias("recall_at_fpr"),
    )


def pr_curve(cells: DataFrame) -> DataFrame:
    """Precision and recall at every distinct threshold."""
    c = cumulative_counts(cells)
    return c.select(
        F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        _ratio(F.col("tp"), F.col("positives")).alias("recall"),
    )


def roc_points(cells: DataFrame) -> DataFrame:
    c = cumulative_counts(cells)
    return c.select(
        F.col("score").alias("threshold"),
        _ratio(F.col("fp"), F.col("negatives")).alias("fpr"),
        _ratio(F.col("tp"), F.col("positives")).alias("tpr"),
    )


def equal_width_bin(probability: Column, bins: int) -> Column:
    """0..bins-1; the last bin includes 1."""
    return F.when(probability.isNotNull(), F.least(F.floor(probability * bins), F.lit(bins - 1))).cast("int")


def calibration_bins(df: DataFrame, label: str, probability: str, bins: int = 15) -> DataFrame:
    return df.groupBy(equal_width_bin(F.col(probability), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col(label).cast("double")).alias("observed"),
        F.avg(probability).alias("predicted"),
    )


def calibration_error(df: DataFrame, label: str, probability: str, bins: int = 15) -> DataFrame:
    per = calibration_bins(df, label, probability, bins)
    return per.agg(
        (F.sum(F.col("n") * F.abs(F.col("observed") - F.col("predicted"))) / F.sum("n")).alias("ece")
    )


def reliability_curve(df: DataFrame, label: str, probability: str, bins: int = 10) -> DataFrame:
    """Observed rate against mean probability on equal-count bins."""
    levels = [i / bins for i in range(1, bins)]
    edges = exact_quantiles(df.select(probability), {probability: levels})[probability]
    limits = sorted({e for e in edges.values() if e is not None})
    place = F.lit(0)
    for edge in limits:
        place = place + (F.col(probability) >= edge).cast("int")
    return df.groupBy(place.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col(label).cast("double")).alias("observed"),
        F.avg(probability).alias("predicted"),
    )


def confusion_counts(df: DataFrame, label: str, decision: Column) -> DataFrame:
    y = F.col(label) == 1
    return df.agg(
        F.count_if(decision & y).alias("tp"),
        F.count_if(decision & ~y).alias("fp"),
        F.count_if(~decision & y).alias("fn"),
        F.count_if(~decision & ~y).alias("tn"),
    )


def f_beta(tp: Column, fp: Column, fn: Column, beta: float) -> Column:
    b = beta * beta
    bottom = (1 + b) * tp + b * fn + fp
    return F.when(bottom > 0, (1 + b) * tp / bottom).otherwise(F.lit(0.0))


def threshold_metrics(
    df: DataFrame, label: str, probability: str, threshold: float, *, beta: float = 2.0,
    partition: Sequence[str] = (),
) -> DataFrame:
    """Decision metrics (0 where undefined) and proper scores, in one aggregate."""
    y, p = F.col(label).cast("double"), F.col(probability)
    hit = p >= threshold
    q = clip_probability(p)
    counts = df.groupBy(*partition).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col(label)).cast("bigint").alias("n_positive"),
        F.count_if(hit & (y == 1)).alias("tp"),
        F.count_if(hit & (y == 0)).alias("fp"),
        F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("nll"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("n_positive") - F.col("tp")
    zero = F.lit(0.0)
    return counts.select(
        *partition,
        "n_rows",
        "n_positive",
        (F.col("n_positive") / F.col("n_rows")).alias("prevalence"),
        F.coalesce(_ratio(tp, tp + fp), zero).alias("precision"),
        F.coalesce(_ratio(tp, F.col("n_positive")), zero).alias("recall"),
        f_beta(tp, fp, fn, 1.0).alias("f1"),
        f_beta(tp, fp, fn, beta).alias("f_beta"),
        "brier",
        "nll",
        ((tp + fp) / F.col("n_rows")).alias("predicted_positive_rate"),
    )


def with_null_baselines(metrics: DataFrame, beta: float = 2.0) -> DataFrame:
    """Add what a constant prevalence score and an all-positive decision would reach."""
    prevalence = F.col("prevalence")
    q = clip_probability(prevalence)
    tp = F.col("n_positive")
    fp = F.col("n_rows") - F.col("n_positive")
    both = (tp > 0) & (fp > 0)
    b = beta * beta
    return metrics.withColumns(
        {
            "null_prevalence": prevalence,
            "null_pr_auc": prevalence,
            "null_roc_auc": F.when(both, 0.5),
            "null_f_beta": F.when(tp > 0, (1 + b) * tp / ((1 + b) * tp + fp)).otherwise(F.lit(0.0)),
            "null_precision": prevalence,
            "null_recall": F.when(tp > 0, 1.0).otherwise(0.0),
            "null_recall_at_fpr": F.when(both, 0.0),
            "null_brier": prevalence * (1 - q) * (1 - q) + (1 - prevalence) * q * q,
            "null_ece": F.abs(prevalence - q),
            "null_nll": -(prevalence * F.log(q) + (1 - prevalence) * F.log(1 - q)),
        }
    )


def prediction_report(
    df: DataFrame, label: str, probability: str, threshold: float, *, beta: float = 2.0, bins: int = 15,
    target_fpr: float = 0.01,
) -> DataFrame:
    """The full metric row of one frozen score: decision, ranking, calibration, nulls and lifts."""
    decision = threshold_metrics(df, label, probability, threshold, beta=beta)
    ranking = ranking_metrics(score_cells(df, probability, label), target_fpr=target_fpr).drop(
        "positives", "negatives"
    )
    ece = calibration_error(df, label, probability, bins)
    row = with_constants(with_constants(decision, ranking), ece)
    return with_null_baselines(row, beta).withColumns(
        {
            "pr_auc_lift_over_null": F.col("pr_auc") - F.col("null_pr_auc"),
            "f_beta_lift_over_null": F.col("f_beta") - F.col("null_f_beta"),
            "brier_improvement_over_null": F.col("null_brier") - F.col("brier"),
            "nll_improvement_over_null": F.col("null_nll") - F.col("nll"),
        }
    )


def threshold_counts(df: DataFrame, label: str, probability: str, grid_size: int = 501) -> list[tuple[float, int, int]]:
    """(threshold, TP, FP) for each candidate: 0, the score quantiles, 1."""
    levels = [i / (grid_size - 1) for i in range(grid_size)]
    quantiles = exact_quantiles(df.select(probability), {probability: levels})[probability]
    grid = sorted({0.0, 1.0, *[q for q in quantiles.values() if q is not None]})
    placed = Bucketizer(
        splits=[-math.inf, *grid, math.inf], inputCol="__p", outputCol="__at", handleInvalid="keep"
    ).transform(df.select(F.col(probability).cast("double").alias("__p"), F.col(label).alias("__y")))
    per = placed.groupBy("__at").agg(
        F.count_if(F.col("__y") == 1).alias("pos"), F.count_if(F.col("__y") != 1).alias("neg")
    )
    counts = {int(r["__at"]): (int(r["pos"]), int(r["neg"])) for r in per.collect()}
    rows, tp, fp = [], 0, 0
    # bucket i + 1 starts at grid[i]; a threshold keeps its own bucket and all later ones
    for i in reversed(range(len(grid))):
        pos, neg = counts.get(i + 1, (0, 0))
        tp, fp = tp + pos, fp + neg
        rows.append((grid[i], tp, fp))
    return rows[::-1]


def select_threshold(
    df: DataFrame, label: str, probability: str, *, beta: float = 2.0, grid_size: int = 501
) -> tuple[float, float]:
    """The threshold with the best F-beta; near-ties go to the larger threshold."""
    rows = threshold_counts(df, label, probability, grid_size)
    positives = df.agg(F.count_if(F.col(label) == 1)).first()[0]
    b = beta * beta
    best, best_score = 0.5, -math.inf
    for threshold, tp, fp in rows:
        bottom = (1 + b) * tp + b * (positives - tp) + fp
        score = (1 + b) * tp / bottom if bottom else 0.0
        close = math.isfinite(best_score) and abs(score - best_score) <= 1e-8 + 1e-5 * abs(best_score)
        if score > best_score or (close and threshold > best):
            best, best_score = threshold, score
    return best, best_score


def average_ranks(df: DataFrame, column: str, *, partition: Sequence[str] = ()) -> DataFrame:
    """Average rank of every distinct value (ties share the mean of their positions)."""
    cells = stage(
        df.groupBy(*partition, F.col(column).cast("double").alias(column)).agg(F.count(F.lit(1)).alias("n")),
        "rank-cells",
    )
    return prefix_sums(cells, column, {"n": "n"}, partition=partition).select(
        *partition, column, (F.col("n_before") + (F.col("n") + 1) / 2).alias(f"{column}_rank")
    )


def rank_correlation(df: DataFrame, left: str, right: str, *, partition: Sequence[str] = ()) -> DataFrame:
    """Spearman correlation; null below three rows or for a constant right column."""
    pairs = stage(
        df.groupBy(*partition, F.col(left).cast("double").alias(left), F.col(right).cast("double").alias(right)).agg(
            F.count(F.lit(1)).alias("__n")
        ),
        "rank-pairs",
    )
    ranks = []
    for column in (left, right):
        cells = stage(pairs.groupBy(*partition, column).agg(F.sum("__n").alias("n")), "rank-cells")
        ranks.append(
            prefix_sums(cells, column, {"n": "n"}, partition=partition).select(
                *partition, column, (F.col("n_before") + (F.col("n") + 1) / 2).alias(f"{column}_rank")
            )
        )
    joined = pairs.join(ranks[0], [*partition, left]).join(ranks[1], [*partition, right])
    n, x, y = F.col("__n").cast("double"), F.col(f"{left}_rank"), F.col(f"{right}_rank")
    rows = F.sum(n)
    middle = (F.lit(0.0) + rows + 1) / 2
    sums = joined.groupBy(*partition).agg(
        rows.alias("__rows"),
        (F.sum(n * x * y) - rows * middle * middle).alias("__xy"),
        (F.sum(n * x * x) - rows * middle * middle).alias("__xx"),
        (F.sum(n * y * y) - rows * middle * middle).alias("__yy"),
    )
    usable = (F.col("__rows") >= 3) & (F.col("__xx") > 0) & (F.col("__yy") > 0)
    return sums.select(
        *partition,
        F.when(usable, F.col("__xy") / F.sqrt(F.col("__xx") * F.col("__yy"))).alias("rank_correlation"),
    )
