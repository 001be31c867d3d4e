"""Rule audit on alerts, redundancy removal and rule weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.operators.metrics import ranking_metrics
from riskloom.operators.quality import rule_cells, rule_counts
from riskloom.session import stage

# Limits and weights of the audit.
CRITERIA: dict[str, float] = {
    "min_active_count": 10,
    "min_coverage": 0.001,
    "max_coverage": 0.80,
    "min_precision_gain": 0.0,
    "min_lift": 1.0,
    "min_tp_fp_gap": 0.0,
    "max_fp_activation": 0.90,
    "max_coverage_shift": 0.20,
    "max_lift_log_shift": 1.50,
    "min_attribution_hit_rate": 0.0,
    "min_attribution_share": 0.0,
}
BENEFIT_WEIGHTS = {"gain": 0.30, "gap": 0.25, "lift": 0.15, "hit": 0.15, "share": 0.15}
PENALTY_WEIGHTS = {"coverage_shift": 0.15, "lift_shift": 0.10, "fp_activation": 0.10}
LIFT_GUARD = 1e-8

STATISTICS = (
    "rows", "active_count", "coverage", "precision", "precision_gain", "lift", "tp_activation",
    "fp_activation", "tp_fp_gap", "rule_auc", "mean_truth",
)


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def alert_statistics(
    df: DataFrame, truths: Mapping[str, str], label: str, alert: str, part: str, *, activation: float = 0.6,
    auc: bool = True, by: Sequence[str] = (),
) -> DataFrame:
    """Rule statistics per part (and ``by``), once over all rows and once over alerts.

    Counts come from one pass grouped by (part, alert); AUCs, which no check uses, from value counts.
    """
    counts = rule_counts(df, truths, label, activation, by=[*by, part, alert])
    scopes = F.when(F.col(alert), F.array(F.lit("population"), F.lit("alert"))).otherwise(
        F.array(F.lit("population"))
    )
    keys = [*by, part, "scope", "rule"]
    sums = (
        counts.select("*", F.explode(scopes).alias("scope"))
        .groupBy(*keys)
        .agg(*[F.sum(c).alias(c) for c in ("rows", "positives", "active", "active_positives", "truth_sum")])
    )
    if not auc:
        return weighted_statistics(sums, [*by, part, "scope"])
    cells = rule_cells(df, truths, label, by=[*by, part, alert])
    merged = (
        cells.select("*", F.explode(scopes).alias("scope"))
        .groupBy(*keys, "score")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    areas = ranking_metrics(stage(merged, "rule-cells"), partition=keys).select(
        *keys, F.col("roc_auc").alias("rule_auc")
    )
    return weighted_statistics(sums, [*by, part, "scope"]).drop("rule_auc").join(areas, keys, "left")


def weighted_statistics(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The statistics of each rule from (weighted) counts; the AUC stays empty."""
    n, pos, act, act_pos = (F.col(c) for c in ("rows", "positives", "active", "active_positives"))
    base, precision = _share(pos, n), _share(act_pos, act)
    tp_act, fp_act = _share(act_pos, pos), _share(act - act_pos, n - pos)
    return counts.select(
        *by,
        "rule",
        n.alias("rows"),
        pos.alias("positives"),
        act.alias("active_count"),
        _share(act, n).alias("coverage"),
        precision.alias("precision"),
        (precision - base).alias("precision_gain"),
        F.when(base > 0, precision / base).alias("lift"),
        tp_act.alias("tp_activation"),
        fp_act.alias("fp_activation"),
        (tp_act - fp_act).alias("tp_fp_gap"),
        F.lit(None).cast("double").alias("rule_auc"),
        _share(F.col("truth_sum"), n).alias("mean_truth"),
    )


def attribution_rates(
    df: DataFrame, truths: Mapping[str, str], hits: Mapping[str, Column], shares: Mapping[str, Column],
    *, activation: float = 0.6, weight: Column | None = None, by: Sequence[str] = (),
) -> DataFrame:
    """Mean attribution hit and share of each rule over its active rows of ``df`` (alerts), per ``by``."""
    aggregates = []
    w = F.lit(1.0) if weight is None else weight.cast("double")
    for i, (rule, column) in enumerate(truths.items()):
        on = F.col(column) >= activation
        total = F.sum(F.when(on, w))
        for name, source in (("h", hits), ("s", shares)):
            value = source.get(rule, F.lit(None)).cast("double")
            aggregates.append(F.when(total > 0, F.sum(F.when(on, w * value)) / total).alias(f"{name}{i}"))
    entries = F.array(
        *[
            F.struct(F.lit(r).alias("rule"), F.col(f"h{i}").alias("hit_rate"), F.col(f"s{i}").alias("share"))
            for i, r in enumerate(truths)
        ]
    )
    totals = df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)
    return totals.select(*by, F.explode(entries).alias("e")).select(*by, "e.*")


def audit_rules(
    statistics: DataFrame,
    *,
    part: str,
    train: str,
    audit: str,
    attribution: DataFrame | None = None,
    registry: DataFrame | None = None,
    criteria: Mapping[str, float] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Pass/fail checks and the composite score of each rule, from ``alert_statistics``.

    ``by`` names further keys of all inputs, such as a seed or a predictor.  All inputs hold one row per rule (and scope), so the joins here are small.
    """
    limits = {**CRITERIA, **(criteria or {})}
    cells = []
    for role, name in ((train, "train"), (audit, "audit")):
        for scope in ("population", "alert"):
            here = (F.col(part) == role) & (F.col("scope") == scope)
            cells += [
                F.max(F.when(here, F.col(c))).alias(f"{name}_{scope}_{c}") for c in (*STATISTICS, "positives")
            ]
    table = statistics.groupBy(*by, "rule").agg(*cells)
    if attribution is None:
        table = table.withColumns({"hit_rate": F.lit(None).cast("double"), "share": F.lit(None).cast("double")})
    else:
        table = table.join(attribution, [*by, "rule"], "left")
    for role in ("train", "audit"):
        for c in ("rows", "positives", "active_count"):
            table = table.withColumn(f"{role}_alert_{c}", F.coalesce(F.col(f"{role}_alert_{c}"), F.lit(0)))

    a = {c: F.col(f"audit_alert_{c}") for c in STATISTICS}
    coverage_shift = F.abs(a["coverage"] - F.col("train_alert_coverage"))
    lift_shift = F.abs(F.log((a["lift"] + LIFT_GUARD) / (F.col("train_alert_lift") + LIFT_GUARD)))
    hit, share = F.col("hit_rate"), F.col("share")

    def holds(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    failures: list[tuple[Column, str]] = []
    for role in ("train", "audit"):
        rows, pos = F.col(f"{role}_alert_rows"), F.col(f"{role}_alert_positives")
        failures.append((rows == 0, f"{role}_alert_empty"))
        failures.append(((rows > 0) & ((pos == 0) | (pos == rows)), f"{role}_alert_one_class"))
    checks = [
        (a["active_count"] >= limits["min_active_count"], "audit_alert_active_count"),
        (a["coverage"] >= limits["min_coverage"], "audit_alert_min_coverage"),
        (a["coverage"] <= limits["max_coverage"], "audit_alert_max_coverage"),
        (a["precision_gain"] >= limits["min_precision_gain"], "audit_alert_precision_gain"),
        (a["lift"] >= limits["min_lift"], "audit_alert_lift"),
        (a["tp_fp_gap"] >= limits["min_tp_fp_gap"], "audit_alert_tp_fp_gap"),
        (a["fp_activation"] <= limits["max_fp_activation"], "audit_alert_fp_activation"),
        (coverage_shift <= limits["max_coverage_shift"], "alert_coverage_shift"),
        (lift_shift <= limits["max_lift_log_shift"], "alert_lift_log_shift"),
    ]
    if limits["min_attribution_hit_rate"] > 0:
        checks.append((hit >= limits["min_attribution_hit_rate"], "audit_alert_attribution_hit_rate"))
    if limits["min_attribution_share"] > 0:
        checks.append((share >= limits["min_attribution_share"], "audit_alert_attribution_share"))
    failures += [(~holds(passed), token) for passed, token in checks]
    text = F.concat_ws(";", *[F.when(failed, F.lit(token)) for failed, token in failures])

    zero = F.lit(0.0)

    def benefit(value: Column) -> Column:
        return F.coalesce(F.greatest(value, zero), zero)

    score = (
        BENEFIT_WEIGHTS["gain"] * benefit(a["precision_gain"])
        + BENEFIT_WEIGHTS["gap"] * benefit(a["tp_fp_gap"])
        + BENEFIT_WEIGHTS["lift"] * benefit(F.log1p(F.greatest(a["lift"] - 1, zero)))
        + BENEFIT_WEIGHTS["hit"] * F.coalesce(hit, zero)
        + BENEFIT_WEIGHTS["share"] * F.coalesce(share, zero)
        - PENALTY_WEIGHTS["coverage_shift"] * F.coalesce(coverage_shift, F.lit(1.0))
        - PENALTY_WEIGHTS["lift_shift"] * F.coalesce(F.least(lift_shift, F.lit(5.0)), F.lit(5.0))
        - PENALTY_WEIGHTS["fp_activation"] * F.coalesce(a["fp_activation"], F.lit(1.0))
    )
    audited = table.withColumns(
        {
            "alert_coverage_shift": coverage_shift,
            "alert_lift_log_shift": lift_shift,
            "audit_alert_attribution_hit_rate": hit,
            "audit_alert_attribution_share": share,
            "audit_alert_score": score,
            "audit_failures": text,
            "audit_pass": text == "",
        }
    ).drop("hit_rate", "share", "train_population_positives", "audit_population_positives")
    if registry is not None:
        info = registry.select("rule", "tier", "description", "features").dropDuplicates(["rule"])
        audited = audited.join(info, "rule", "left").withColumns(
            {
                "tier": F.coalesce("tier", F.lit("unspecified")),
                "description": F.coalesce("description", F.regexp_replace("rule", "_", " ")),
            }
        )
    return audited


def audit_order(audited: DataFrame) -> DataFrame:
    return audited.orderBy(F.col("audit_pass").desc(), F.col("audit_alert_score").desc(), "rule")


@dataclass(frozen=True)
class Decision:
    rule: str
    status: str
    redundant_with: str | None
    max_jaccard: float | None


def greedy_decisions(
    scores: Sequence[tuple[str, bool, float]],
    overlap: Mapping[tuple[str, str], float],
    *,
    max_jaccard: float = 0.85,
    max_rules: int = 12,
) -> list[Decision]:
    """Keep rules by score unless they overlap a kept one; works on one row per rule."""
    if not 0.0 <= max_jaccard <= 1.0:
        raise ValueError("max_jaccard must lie in [0, 1]")
    if max_rules < 1:
        raise ValueError("max_rules must be at least one")
    kept: list[str] = []
    out = []
    for rule, passed, _ in sorted(scores, key=lambda s: (not s[1], -s[2], s[0])):
        if not passed:
            out.append(Decision(rule, "audit_failed", None, None))
            continue
        shared = [(k, overlap[min(rule, k), max(rule, k)]) for k in kept]
        blocker = next((k for k, j in shared if j > max_jaccard), None)
        if blocker:
            status = "redundant"
        elif len(kept) < max_rules:
            status = "selected"
            kept.append(rule)
        else:
            status = "rule_budget_exceeded"
        out.append(Decision(rule, status, blocker, max((j for _, j in shared), default=0.0)))
    return out


def remove_redundant(
    audited: DataFrame,
    overlap: DataFrame,
    *,
    rules: Sequence[str] | None = None,
    max_jaccard: float = 0.85,
    max_rules: int = 12,
) -> DataFrame:
    """Audit table plus selection status; ``rules`` restricts the pool for an ablation."""
    pool = audited if rules is None else audited.filter(F.col("rule").isin(list(rules)))
    scores = [
        (r["rule"], bool(r["audit_pass"]), float(r["audit_alert_score"]))
        for r in pool.select("rule", "audit_pass", "audit_alert_score").collect()
    ]
    pairs = {
        (min(r["rule_a"], r["rule_b"]), max(r["rule_a"], r["rule_b"])): float(r["jaccard"])
        for r in overlap.select("rule_a", "rule_b", "jaccard").collect()
    }
    decisions = greedy_decisions(scores, pairs, max_jaccard=max_jaccard, max_rules=max_rules)
    table = audited.sparkSession.createDataFrame(
        [(d.rule, d.status, d.redundant_with, d.max_jaccard) for d in decisions],
        "rule string, selection_status string, redundant_with string, max_jaccard_with_selected double",
    )
    joined = pool.join(table, "rule", "left")
    return joined.withColumn(
        "selection_status", F.coalesce("selection_status", F.lit("audit_failed"))
    ).withColumn("selected", F.col("selection_status") == "selected")


def rule_weights(completed: DataFrame, *, fp_penalty: float = 1.0) -> DataFrame:
    """Score-share and false-positive-penalised weights of the selected rules."""
    # One row per rule reaches this window.
    every = Window.partitionBy(F.lit(0))
    lowest = F.least(F.min("audit_alert_score").over(every), F.lit(0.0))
    out = completed.filter("selected").withColumn(
        "component", F.greatest(F.col("audit_alert_score") - lowest, F.lit(0.0)) + F.lit(LIFT_GUARD)
    )
    out = out.withColumn("audit_weight", F.col("component") / F.sum("component").over(every))
    edge = F.greatest(
        F.col("audit_alert_tp_activation") - F.lit(fp_penalty) * F.col("audit_alert_fp_activation"), F.lit(0.0)
    )
    out = out.withColumn("__penalised", F.col("audit_weight") * (edge + F.lit(LIFT_GUARD)))
    return out.select(
        "rule",
        "audit_weight",
        (F.col("__penalised") / F.sum("__penalised").over(every)).alias("fp_penalized_weight"),
        F.col("component").alias("audit_alert_score_component"),
    )


@dataclass(frozen=True)
class Weights:
    """Frozen weights as driver values, one entry per selected rule."""

    audit: Mapping[str, float]
    penalised: Mapping[str, float]

    @property
    def rules(self) -> list[str]:
        return list(self.audit)


def collect_weights(weights: DataFrame) -> Weights:
    rows = sorted(weights.collect(), key=lambda r: r["rule"])
    return Weights(
        {r["rule"]: float(r["audit_weight"]) for r in rows},
        {r["rule"]: float(r["fp_penalized_weight"]) for r in rows},
    )


def selected_jaccard(left: Sequence[str], right: Sequence[str]) -> float:
    a, b = set(left), set(right)
    return len(a & b) / len(a | b) if a | b else 1.0


def empty_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [], "rule string, audit_weight double, fp_penalized_weight double, audit_alert_score_component double"
    )
