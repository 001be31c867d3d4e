"""Explanation quality and rule-subset ablations from activation counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.metrics import ranking_metrics, score_cells


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def rule_cells(
    df: DataFrame, truths: Mapping[str, str], label: str, *, by: Sequence[str] = ()
) -> DataFrame:
    """Label counts per rule and distinct truth value (long form), written once."""
    entries = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(c).alias("truth")) for r, c in truths.items()])
    long = df.select(*by, label, F.explode(entries).alias("e")).select(*by, label, "e.rule", "e.truth")
    return score_cells(long, "truth", label, partition=[*by, "rule"])


def rule_counts(
    df: DataFrame, truths: Mapping[str, str], label: str, activation: float, *, by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Rows, positives, active rows, active positives and truth sum per rule, in one pass."""
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    y = F.col(label).cast("bigint") * w
    aggregates = []
    for i, column in enumerate(truths.values()):
        on = F.col(column) >= activation
        aggregates += [
            F.sum(F.when(on, w).otherwise(0)).alias(f"a{i}"),
            F.sum(F.when(on, y).otherwise(0)).alias(f"p{i}"),
            F.sum(F.col(column) * w).alias(f"s{i}"),
        ]
    wide = df.groupBy(*by).agg(F.sum(w).alias("rows"), F.sum(y).alias("positives"), *aggregates)
    entries = F.array(
        *[
            F.struct(
                F.lit(r).alias("rule"),
                F.col(f"a{i}").alias("active"),
                F.coalesce(F.col(f"p{i}"), F.lit(0)).alias("active_positives"),
                F.col(f"s{i}").alias("truth_sum"),
            )
            for i, r in enumerate(truths)
        ]
    )
    return wide.select(
        *by, "rows", F.coalesce("positives", F.lit(0)).alias("positives"), F.explode(entries).alias("e")
    ).select(*by, "rows", "positives", "e.*")


def rule_quality(
    df: DataFrame, truths: Mapping[str, str], label: str, *, activation: float = 0.6, by: Sequence[str] = ()
) -> DataFrame:
    """Coverage, precision, lift, mean truth and AUC of each rule."""
    counts = rule_counts(df, truths, label, activation, by=by)
    auc = ranking_metrics(rule_cells(df, truths, label, by=by), partition=[*by, "rule"]).select(
        *by, "rule", F.col("roc_auc").alias("rule_auc")
    )
    base = _share(F.col("positives"), F.col("rows"))
    precision = _share(F.col("active_positives"), F.col("active"))
    # One row per rule on both sides.
    return counts.join(auc, [*by, "rule"], "left").select(
        *by,
        "rule",
        F.col("rows").alias("evaluated_rows"),
        _share(F.col("active"), F.col("rows")).alias("coverage"),
        F.col("active").alias("active_count"),
        precision.alias("precision"),
        F.when(base > 0, precision / base).alias("lift"),
        (F.col("truth_sum") / F.col("rows")).alias("mean_truth"),
        "rule_auc",
    )


def explanation_quality(
    df: DataFrame,
    label: str,
    alert: Column,
    *,
    explained: str = "explained",
    active: str = "active_rule_count",
    displayed: str = "displayed_rule_count",
    available: str = "available_rule_count",
    by: Sequence[str] = (),
) -> DataFrame:
    """Counts and rates of rule evidence among alerts and non-alerts; null where undefined."""
    e, y = F.col(explained), F.col(label) == 1
    fraction = F.when(F.col(available) > 0, F.col(active) / F.col(available))
    c = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("test_rows"),
        F.count_if(alert).alias("predicted_alert_count"),
        F.count_if(~alert).alias("non_alert_count"),
        F.count_if(alert & y).alias("predicted_alert_fraud_count"),
        F.count_if(e).alias("explained_count"),
        F.count_if(~e).alias("zero_rule_count"),
        F.count_if(e & alert).alias("explained_alert_count"),
        F.count_if(e & alert & y).alias("explained_alert_fraud_count"),
        F.count_if(~e & alert).alias("unsupported_alert_count"),
        F.count_if(e & ~alert).alias("rule_evidence_without_alert_count"),
        F.avg(F.col(active).cast("double")).alias("mean_active_rule_count"),
        F.avg(F.col(displayed).cast("double")).alias("mean_displayed_rule_count"),
        F.avg(fraction).alias("mean_active_rule_fraction"),
    )

    def rate(a: str, b: str) -> Column:
        return _share(F.col(a), F.col(b))

    agree = (
        F.col("explained_alert_count") + F.col("non_alert_count") - F.col("rule_evidence_without_alert_count")
    )
    out = c.withColumns(
        {
            "explanation_coverage_all": rate("explained_count", "test_rows"),
            "zero_rule_fraction": rate("zero_rule_count", "test_rows"),
            "explanation_coverage_alerts": rate("explained_alert_count", "predicted_alert_count"),
            "unsupported_alert_rate": rate("unsupported_alert_count", "predicted_alert_count"),
            "rule_evidence_without_alert_rate": rate("rule_evidence_without_alert_count", "non_alert_count"),
            "prediction_rule_consistency": _share(agree, F.col("test_rows")),
            "contradiction_rate": _share(F.col("test_rows") - agree, F.col("test_rows")),
            "explained_alert_precision": rate("explained_alert_fraud_count", "explained_alert_count"),
            "all_alert_precision": rate("predicted_alert_fraud_count", "predicted_alert_count"),
        }
    )
    return out.withColumns(
        {
            "rule_sparsity": 1 - F.col("mean_active_rule_fraction"),
            "balanced_prediction_rule_consistency": (
                F.col("explanation_coverage_alerts") + 1 - F.col("rule_evidence_without_alert_rate")
            )
            / 2,
            "explained_alert_precision_gain": F.col("explained_alert_precision") - F.col("all_alert_precision"),
        }
    )


def support_summary(df: DataFrame, alert: Column, *, active: str = "active_rule_count", top_k: int = 3,
                    available: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Rule support on alerts: supported, unsupported, displayed counts, sparsity, contradictions."""
    n = F.col(active)
    on = alert & (n > 0)
    shown = F.least(n, F.lit(top_k))
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(alert).alias("alert_rows"),
        F.count_if(on).alias("supported_alerts"),
        F.count_if(alert & (n == 0)).alias("unsupported_alerts"),
        F.count_if(alert != (n > 0)).alias("contradictions"),
        F.avg(F.when(alert, n.cast("double"))).alias("mean_active_rules"),
        F.avg(F.when(alert, shown.cast("double"))).alias("mean_displayed_rules"),
    )
    out = out.withColumn("alert_support_rate", _share(F.col("supported_alerts"), F.col("alert_rows")))
    out = out.withColumn("contradiction_rate", _share(F.col("contradictions"), F.col("rows")))
    if available:
        out = out.withColumn("rule_sparsity", 1 - F.col("mean_active_rules") / F.lit(float(available)))
    return out


# --- activation patterns ---------------------------------------------------------------------


def activation_pattern(truths: Sequence[str], activation: float) -> Column:
    """Which rules are active, as a string of 0 and 1 in rule order."""
    return F.concat(*[F.when(F.col(t) >= activation, "1").otherwise("0") for t in truths])


def pattern_histogram(
    df: DataFrame, truths: Sequence[str], thresholds: Sequence[float], label: str, alert: Column,
    *, by: Sequence[str] = (), weight: str | None = None,
) -> DataFrame:
    """Row counts per activation pattern, alert and label: all ablations read only this."""
    patterns = F.array(
        *[
            F.struct(F.lit(float(t)).alias("activation"), activation_pattern(truths, t).alias("pattern"))
            for t in thresholds
        ]
    )
    return (
        df.select(
            *by,
            F.explode(patterns).alias("p"),
            alert.alias("alert"),
            F.col(label).alias("y"),
            (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("__w"),
        )
        .groupBy(*by, "p.activation", "p.pattern", "alert", "y")
        .agg(F.sum("__w").alias("n"))
    )


def rule_ablation(histogram: DataFrame, rules: Sequence[str], *, main: float = 0.6) -> DataFrame:
    """Alert support and precision of rule subsets: full, none, one only, all but one.

    The full set is also scored at every other activation threshold of the histogram.
    """
    every = list(range(len(rules)))
    variants = [("full", every), ("none", [])]
    variants += [(f"only:{r}", [i]) for i, r in enumerate(rules)]
    variants += [(f"without:{r}", [j for j in every if j != i]) for i, r in enumerate(rules)]
    masks = F.array(
        *[
            F.struct(
                F.lit(name).alias("variant"),
                F.array(*[F.lit(i + 1) for i in keep]).cast("array<int>").alias("keep"),
            )
            for name, keep in variants
        ]
    )
    allowed = (F.col("activation") == main) | (F.col("v.variant") == "full")
    cells = histogram.select("*", F.explode(masks).alias("v")).filter(allowed)
    on = F.exists("v.keep", lambda i: F.substring(F.col("pattern"), i, F.lit(1)) == "1")
    cells = cells.withColumn("on", F.coalesce(on, F.lit(False)))

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    sums = cells.groupBy("activation", F.col("v.variant").alias("variant")).agg(
        F.sum("n").alias("rows"),
        total(F.col("alert")).alias("alerts"),
        total(F.col("alert") & (F.col("y") == 1)).alias("alert_positives"),
        total(F.col("on")).alias("explained"),
        total(F.col("on") & F.col("alert")).alias("explained_alerts"),
        total(F.col("on") & F.col("alert") & (F.col("y") == 1)).alias("explained_alert_positives"),
    )
    precision = _share(F.col("explained_alert_positives"), F.col("explained_alerts"))
    base = _share(F.col("alert_positives"), F.col("alerts"))
    return sums.withColumns(
        {
            "explanation_coverage_alerts": _share(F.col("explained_alerts"), F.col("alerts")),
            "explained_alert_precision": precision,
            "explained_alert_precision_gain": precision - base,
        }
    )


def rule_overlap(histogram: DataFrame, rules: Sequence[str], *, by: Sequence[str] = ()) -> DataFrame:
    """Jaccard overlap of every rule pair from pattern counts; two empty rules overlap fully."""
    pairs = F.array(
        *[
            F.struct(F.lit(a).alias("rule_a"), F.lit(b).alias("rule_b"), F.lit(i + 1).alias("i"), F.lit(j + 1).alias("j"))
            for i, a in enumerate(rules)
            for j, b in enumerate(rules)
            if i < j
        ]
    )
    cells = histogram.groupBy(*by, "pattern").agg(F.sum("n").alias("n")).select("*", F.explode(pairs).alias("q"))
    first = F.substring(F.col("pattern"), F.col("q.i"), F.lit(1)) == "1"
    second = F.substring(F.col("pattern"), F.col("q.j"), F.lit(1)) == "1"
    sums = cells.groupBy(*by, "q.rule_a", "q.rule_b").agg(
        F.sum(F.when(first & second, F.col("n")).otherwise(0)).alias("both"),
        F.sum(F.when(first | second, F.col("n")).otherwise(0)).alias("either"),
    )
    return sums.withColumn(
        "jaccard", F.when(F.col("either") > 0, F.col("both") / F.col("either")).otherwise(F.lit(1.0))
    )
