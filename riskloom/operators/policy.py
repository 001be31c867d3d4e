"""Budgeted alert selection, the locked policy, and its reports.

Every method's alerts are ranked once with a bucketed global rank.  All budgets are
then plain comparisons with that rank, so several coverages cost no further sort.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.evidence import METHOD_PRECEDENCE
from riskloom.operators.metrics import rank_correlation, ranking_metrics, score_cells
from riskloom.operators.ranks import nth_row, up_to, with_global_rank
from riskloom.session import stage

SCORE_ONLY = "__score_only"


def budget_count(alerts: int, coverage: float) -> int:
    """How many alerts a review budget covers."""
    if not 0.0 < coverage <= 1.0:
        raise ValueError("coverage must lie in (0, 1]")
    if alerts <= 0:
        return 0
    return min(alerts, max(1, math.ceil(coverage * alerts)))


def ranked_alerts(
    rows: DataFrame,
    methods: Sequence[str],
    *,
    risk: str,
    alert: str,
    row_id: str,
    label: str | None = None,
    weight: Sequence[str] | None = None,
    score_only: bool = True,
    by: Sequence[str] = (),
) -> DataFrame:
    """Long table (method, row id, evidence, risk, rank) of the eligible alerts; ``rows`` should be a staged table.

    ``by`` names keys, such as a predictor, that are ranked apart.  Eligible alerts have positive evidence; ``SCORE_ONLY`` ranks all alerts by risk.  With
    ``weight`` columns (rows drawn more than once, one column a replicate) ``rank_before_<i>`` is
    the weight ranked ahead of a row: one order serves all replicates.
    """
    entries = [F.struct(F.lit(m).alias("method"), F.col(m).cast("double").alias("evidence")) for m in methods]
    if score_only:
        entries.append(F.struct(F.lit(SCORE_ONLY).alias("method"), F.col(risk).alias("evidence")))
    keep = [*map(F.col, by), F.col(row_id), F.col(risk).alias("risk")]
    keep += [F.col(c) for c in (label, *(weight or ())) if c]
    long = (
        rows.filter(F.col(alert))
        .select(*keep, F.explode(F.array(*entries)).alias("e"))
        .select("*", "e.method", "e.evidence")
        .drop("e")
        .filter((F.col("method") == SCORE_ONLY) | (F.col("evidence") > 0))
    )
    return with_global_rank(
        long, [("evidence", "desc"), ("risk", "desc")], row_id, partition=[*by, "method"], weight=weight
    )


def top_marks(rows: DataFrame, method: str, counts: Sequence[int], *, risk: str, alert: str, row_id: str) -> dict[int, Column]:
    """For every count, whether a row is among the first so many of ``ranked_alerts``: a comparison with the last one selected."""
    order = [(risk, "desc")] if method == SCORE_ONLY else [(method, "desc"), (risk, "desc")]
    eligible = F.col(alert) if method == SCORE_ONLY else F.col(alert) & (F.col(method) > 0)
    known = rows.filter(eligible)
    support = known.count()
    return {
        n: eligible & up_to(nth_row(known, order, row_id, min(n, support)), order, row_id) for n in counts
    }


def select_top(ranked: DataFrame, method: str, count: int) -> DataFrame:
    """The selected rows of one method; never filled up with unsupported alerts."""
    return ranked.filter((F.col("method") == method) & (F.col("rank") <= count))


@dataclass(frozen=True)
class Guardrails:
    minimum_delta: float = 0.0
    minimum_support: float = 0.01
    minimum_gap: float = 0.0
    minimum_fidelity: float | None = None
    require_full_budget: bool = True


@dataclass(frozen=True)
class LockedPolicy:
    coverage: float
    method: str | None
    abstain: bool
    reason: str
    validation_alert_count: int
    validation_selected_count: int
    validation_all_alert_precision: float | None
    validation_score_only_precision: float | None
    validation_selected_precision: float | None
    validation_delta_vs_score_only: float | None
    validation_evidence_cutoff: float | None
    minimum_score_only_delta: float


POLICY_SCHEMA = (
    "coverage double, method string, abstain boolean, reason string, validation_alert_count bigint, "
    "validation_selected_count bigint, validation_all_alert_precision double, "
    "validation_score_only_precision double, validation_selected_precision double, "
    "validation_delta_vs_score_only double, validation_evidence_cutoff double, minimum_score_only_delta double"
)


def policy_table(spark: SparkSession, policies: Sequence[LockedPolicy]) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(p).values()) for p in policies], POLICY_SCHEMA)


def policies_from_table(table: DataFrame) -> list[LockedPolicy]:
    """One policy per coverage comes back to the driver."""
    return [LockedPolicy(**r.asDict()) for r in table.orderBy("coverage").collect()]


def _taken(count: int, weight: str | None, before: str) -> Column:
    """How much of a row lies inside the first ``count`` ranked rows."""
    if weight is None:
        return F.when(F.col("rank") <= count, 1).otherwise(0).cast("bigint")
    return F.greatest(F.lit(0), F.least(F.col(weight), F.lit(count) - F.col(before))).cast("bigint")


def policy_candidates(
    rows: DataFrame,
    methods: Sequence[str],
    coverages: Sequence[float],
    *,
    label: str,
    risk: str,
    alert: str,
    row_id: str,
    weight: str | None = None,
    fidelity: bool = True,
    ranked: DataFrame | None = None,
) -> DataFrame:
    """One row per (method, coverage): counts, precisions, deltas, evidence gap and fidelity."""
    names = {"label": label, "risk": risk, "alert": alert, "row_id": row_id}
    weights = None if weight is None else [weight]
    return replicate_candidates(rows, methods, coverages, weights, fidelity=fidelity, ranked=ranked, **names).drop("replicate")


def replicate_candidates(
    rows: DataFrame,
    methods: Sequence[str],
    coverages: Sequence[float],
    weights: Sequence[str] | None,
    *,
    label: str,
    risk: str,
    alert: str,
    row_id: str,
    fidelity: bool = True,
    ranked: DataFrame | None = None,
) -> DataFrame:
    """The candidates of every replicate, whose row weights are the columns ``weights``; none means one unweighted one.

    All replicates share one ranking and the same passes over the rows, however many there are.
    """
    spark = rows.sparkSession
    replicates: list[str | None] = list(weights) if weights is not None else [None]
    y = F.col(label)
    on = F.col(alert)
    aggregates = []
    for r, weight in enumerate(replicates):
        w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
        aggregates += [
            F.sum(F.when(on, w).otherwise(0)).alias(f"alerts_{r}"),
            F.sum(F.when(on & (y == 1), w).otherwise(0)).alias(f"positives_{r}"),
        ]
        for i, m in enumerate(methods):
            e = F.col(m).cast("double")
            aggregates += [
                F.sum(F.when(on & (e > 0), w).otherwise(0)).alias(f"s{i}_{r}"),
                F.sum(F.when(on & (y == 1), w * e)).alias(f"t{i}_{r}"),
                F.sum(F.when(on & (y == 0), w * e)).alias(f"f{i}_{r}"),
                F.min(F.when(on & (w > 0), e)).alias(f"lo{i}_{r}"),
                F.max(F.when(on & (w > 0), e)).alias(f"hi{i}_{r}"),
            ]
    facts = rows.agg(*aggregates).first()
    if ranked is None:
        ranked = stage(
            ranked_alerts(rows, methods, risk=risk, alert=alert, row_id=row_id, label=label, weight=weights),
            "ranked-alerts",
        )
    # One pass over the ranked rows gives, per method, replicate and count, the selected rows, positives and
    # cut-off; the counts are the requested ones and, for the comparator, every realised one.
    plans, sums = [], []
    for r, weight in enumerate(replicates):
        alerts = int(facts[f"alerts_{r}"] or 0)
        requested = {c: budget_count(alerts, c) for c in coverages}
        realised = {(m, c): min(requested[c], int(facts[f"s{i}_{r}"] or 0)) for i, m in enumerate(methods) for c in coverages}
        counts = sorted({*requested.values(), *realised.values()})
        plans.append((alerts, requested, realised, {n: i for i, n in enumerate(counts)}))
        for i, n in enumerate(counts):
            taken = _taken(n, weight, f"rank_before_{r}")
            sums += [
                F.sum(taken).alias(f"n{i}_{r}"),
                F.sum(F.when(y == 1, taken).otherwise(0)).alias(f"y{i}_{r}"),
                F.min(F.when(taken > 0, F.col("evidence"))).alias(f"c{i}_{r}"),
            ]
    per = {r["method"]: r for r in ranked.groupBy("method").agg(*sums).collect()}
    score_row = per.get(SCORE_ONLY)

    def share(a: float, b: float) -> float | None:
        return a / b if b else None

    def minus(a: float | None, b: float | None) -> float | None:
        return None if a is None or b is None else a - b

    table = []
    for r, (alerts, requested, realised, at) in enumerate(plans):
        positives = int(facts[f"positives_{r}"] or 0)
        all_precision = share(positives, alerts)
        for i, m in enumerate(methods):
            support = int(facts[f"s{i}_{r}"] or 0)
            tp_mean = share(facts[f"t{i}_{r}"] or 0.0, positives)
            fp_mean = share(facts[f"f{i}_{r}"] or 0.0, alerts - positives)
            varies = facts[f"lo{i}_{r}"] is not None and facts[f"hi{i}_{r}"] > facts[f"lo{i}_{r}"]
            for c in coverages:
                n = realised[m, c]
                mine = per.get(m)
                chosen = int(mine[f"n{at[n]}_{r}"]) if mine and n else 0
                hits = int(mine[f"y{at[n]}_{r}"]) if mine and n else 0
                cutoff = float(mine[f"c{at[n]}_{r}"]) if mine and n else None
                precision = share(hits, chosen)
                score_hits = int(score_row[f"y{at[n]}_{r}"]) if score_row and n else 0
                score_precision = share(score_hits, n)
                full = requested[c]
                full_hits = int(score_row[f"y{at[full]}_{r}"]) if score_row and full else 0
                table.append(
                    (
                        r, m, float(c), alerts, chosen, full, share(chosen, alerts), chosen < full, support,
                        share(support, alerts), all_precision, precision, minus(precision, all_precision), n,
                        score_precision, share(full_hits, full), minus(precision, score_precision),
                        minus(1.0, score_precision), tp_mean, fp_mean, minus(tp_mean, fp_mean), cutoff, varies,
                    )
                )
    candidates = spark.createDataFrame(
        table,
        "replicate int, method string, coverage double, alert_count bigint, selected_count bigint, "
        "requested_selected_count bigint, realized_alert_coverage double, support_shift_underfill boolean, "
        "supported_alert_count bigint, supported_alert_fraction double, all_alert_precision double, "
        "selected_precision double, precision_gain_vs_all_alerts double, score_only_selected_count bigint, "
        "score_only_precision double, score_only_requested_budget_precision double, delta_vs_score_only double, "
        "headroom_after_score_only double, evidence_tp_mean double, evidence_fp_mean double, "
        "evidence_tp_fp_gap double, evidence_cutoff double, evidence_varies boolean",
    )
    if not fidelity:
        return candidates.withColumns(
            {
                "positive_region_fidelity": F.lit(None).cast("double"),
                "alert_conditional_rank_fidelity": F.lit(None).cast("double"),
            }
        )
    # At most one fidelity row per method and replicate.
    if weights is None:
        return candidates.join(F.broadcast(method_fidelity(rows, methods, risk=risk, alert=alert)), "method", "left")
    return candidates.join(
        F.broadcast(replicate_fidelity(rows, methods, weights, alert=alert)), ["replicate", "method"], "left"
    )


def replicate_fidelity(rows: DataFrame, methods: Sequence[str], weights: Sequence[str], *, alert: str) -> DataFrame:
    """AUC of evidence for being an alert, per replicate; rows are summed once, with a column per weight."""
    entries = F.array(
        *[F.struct(F.lit(m).alias("method"), F.col(m).cast("double").alias("score")) for m in methods]
    )
    long = rows.select(F.col(alert).alias("on"), *weights, F.explode(entries).alias("e")).select("*", "e.*").drop("e")
    sums = long.groupBy("method", "score").agg(
        F.array(*[F.sum(F.when(F.col("on"), F.col(w)).otherwise(0)).cast("bigint") for w in weights]).alias("pos"),
        F.array(*[F.sum(F.when(F.col("on"), 0).otherwise(F.col(w))).cast("bigint") for w in weights]).alias("neg"),
    )
    cells = sums.select("method", "score", F.posexplode(F.arrays_zip("pos", "neg")).alias("replicate", "n"))
    cells = stage(cells.select("replicate", "method", "score", "n.pos", "n.neg"), "replicate-cells")
    return ranking_metrics(cells, partition=["replicate", "method"]).select(
        "replicate", "method", F.col("roc_auc").alias("positive_region_fidelity"),
        F.lit(None).cast("double").alias("alert_conditional_rank_fidelity"),
    )


def method_fidelity(
    rows: DataFrame, methods: Sequence[str], *, risk: str, alert: str, by: Sequence[str] = ()
) -> DataFrame:
    """AUC of evidence for being an alert, and its rank correlation with risk among alerts, per ``by``."""
    keys = [*by, "method"]
    entries = F.array(
        *[F.struct(F.lit(m).alias("method"), F.col(m).cast("double").alias("evidence")) for m in methods]
    )
    keep = [*by, F.col(risk).alias("risk"), F.col(alert).cast("int").alias("alert")]
    long = rows.select(*keep, F.explode(entries).alias("e")).select("*", "e.method", "e.evidence").drop("e")
    cells = score_cells(long, "evidence", "alert", partition=keys)
    region = ranking_metrics(cells, partition=keys).select(
        *keys, F.col("roc_auc").alias("positive_region_fidelity")
    )
    agree = rank_correlation(long.filter("alert = 1"), "risk", "evidence", partition=keys).select(
        *keys, F.col("rank_correlation").alias("alert_conditional_rank_fidelity")
    )
    return region.join(agree, keys, "left")


def with_eligibility(candidates: DataFrame, rails: Guardrails) -> DataFrame:
    """Eligibility of each candidate and the reasons against it."""
    c = {n: F.col(n) for n in candidates.columns}

    def holds(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    low_support = holds(c["supported_alert_fraction"] < rails.minimum_support)
    short = (
        c["supported_alert_count"] < c["requested_selected_count"] if rails.require_full_budget else F.lit(False)
    )
    gap_ok = holds(c["evidence_tp_fp_gap"] > rails.minimum_gap)
    faithful = (
        F.lit(True)
        if rails.minimum_fidelity is None
        else holds(c["positive_region_fidelity"] >= rails.minimum_fidelity)
    )
    better = holds(c["delta_vs_score_only"] > rails.minimum_delta)
    no_alerts = c["alert_count"] == 0
    constant = no_alerts | ~c["evidence_varies"]
    reasons = F.concat_ws(
        ";",
        F.when(no_alerts, F.lit("no_validation_alerts")),
        F.when(constant, F.lit("constant_evidence")),
        F.when(low_support, F.lit("insufficient_rule_support")),
        F.when(short, F.lit("insufficient_active_rules_for_fixed_budget")),
        F.when(~gap_ok, F.lit("tp_fp_evidence_guardrail_not_met")),
        F.when(~faithful, F.lit("fidelity_guardrail_not_met")),
        F.when(~better, F.lit("score_only_guardrail_not_met")),
    )
    enough = holds(c["supported_alert_fraction"] >= rails.minimum_support)
    eligible = ~constant & c["selected_precision"].isNotNull() & enough & ~short & gap_ok & faithful & better
    return candidates.withColumns({"eligible": eligible, "ineligible_reasons": reasons})


def lock_policies(
    candidates: DataFrame, rails: Guardrails, precedence: Sequence[str] = METHOD_PRECEDENCE
) -> list[LockedPolicy]:
    """Choose one method per coverage, or abstain; reads one row per (method, coverage)."""
    return choose_policies(with_eligibility(candidates, rails).collect(), rails, precedence)


def choose_policies(
    rows: Sequence[Row], rails: Guardrails, precedence: Sequence[str] = METHOD_PRECEDENCE
) -> list[LockedPolicy]:
    """The choice itself, on collected candidate rows."""
    order = {m: i for i, m in enumerate(precedence)}
    policies = []
    for coverage in sorted({r["coverage"] for r in rows}):
        mine = [r for r in rows if r["coverage"] == coverage]
        good = [r for r in mine if r["eligible"]]
        if good:
            best = min(
                good,
                key=lambda r: (
                    -r["delta_vs_score_only"], -r["selected_precision"], -r["evidence_tp_fp_gap"],
                    order.get(r["method"], len(order)), r["method"],
                ),
            )
            policies.append(
                LockedPolicy(
                    coverage, best["method"], False, "validation_guardrails_passed", best["alert_count"],
                    best["selected_count"], best["all_alert_precision"], best["score_only_precision"],
                    best["selected_precision"], best["delta_vs_score_only"], best["evidence_cutoff"],
                    rails.minimum_delta,
                )
            )
        else:
            any_row = mine[0]
            reason = (
                "no_validation_alerts" if not any_row["alert_count"] else "no_method_beats_score_only_guardrail"
            )
            policies.append(
                LockedPolicy(
                    coverage, None, True, reason, any_row["alert_count"], 0, any_row["all_alert_precision"],
                    any_row["score_only_requested_budget_precision"], None, None, None, rails.minimum_delta,
                )
            )
    return policies


def apply_policies(
    rows: DataFrame, policies: Sequence[LockedPolicy], *, risk: str, alert: str, row_id: str,
    ranked: DataFrame | None = None,
) -> DataFrame:
    """Selected rows (coverage, method, row id, ...) of every locked policy; reads no label."""
    active = [p for p in policies if not p.abstain]
    methods = sorted({p.method for p in active})
    if ranked is None:
        ranked = stage(
            ranked_alerts(rows, methods, risk=risk, alert=alert, row_id=row_id, score_only=False), "ranked-alerts"
        )
    alerts = rows.agg(F.count_if(alert)).first()[0]
    choices = [(float(p.coverage), p.method, budget_count(alerts, p.coverage)) for p in active]
    table = rows.sparkSession.createDataFrame(choices, "coverage double, method string, take bigint")
    # One row per coverage.
    return ranked.join(F.broadcast(table), "method").filter(F.col("rank") <= F.col("take"))


def policy_report(
    rows: DataFrame,
    policies: Sequence[LockedPolicy],
    *,
    label: str,
    risk: str,
    alert: str,
    row_id: str,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Outcome of every locked policy on later rows, with both score-only comparators.

    ``names`` tells policies of several variants apart in a ``variant`` column.
    """
    spark = rows.sparkSession
    methods = sorted({p.method for p in policies if not p.abstain})
    facts = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(label) == 1).alias("positives"),
        F.count_if(alert).alias("alerts"),
        F.count_if(F.col(alert) & (F.col(label) == 1)).alias("alert_positives"),
    ).first()
    ranked = stage(
        ranked_alerts(rows, methods, risk=risk, alert=alert, row_id=row_id, label=label), "ranked-alerts"
    )
    supports = {r["method"]: r["n"] for r in ranked.groupBy("method").agg(F.count(F.lit(1)).alias("n")).collect()}
    alerts = facts["alerts"]
    plan = []
    for p in policies:
        full = budget_count(alerts, p.coverage)
        plan.append((p, full, 0 if p.abstain else min(full, supports.get(p.method, 0))))
    counts = sorted({n for _, full, real in plan for n in (full, real)})
    hits = {
        r["method"]: r
        for r in ranked.groupBy("method")
        .agg(*[F.count_if((F.col("rank") <= n) & (F.col(label) == 1)).alias(f"y{i}") for i, n in enumerate(counts)])
        .collect()
    }
    at = {n: i for i, n in enumerate(counts)}

    def count(method: str | None, n: int) -> int:
        return int(hits[method][f"y{at[n]}"]) if n and method in hits else 0

    variants = list(names) if names else [""] * len(plan)
    base = [
        (
            name, float(p.coverage), p.method, p.abstain, p.reason, facts["rows"], alerts, full, real,
            count(p.method, real), count(SCORE_ONLY, real), count(SCORE_ONLY, full), facts["positives"],
            facts["alert_positives"],
        )
        for name, (p, full, real) in zip(variants, plan)
    ]
    table = spark.createDataFrame(
        base,
        "variant string, coverage_budget double, method string, abstain boolean, abstention_reason string, test_rows bigint, "
        "alert_count bigint, requested_selected_count bigint, selected_count bigint, "
        "selected_positive_count bigint, score_only_positive_count bigint, "
        "score_only_requested_budget_positive_count bigint, test_positive_count bigint, "
        "alert_positive_count bigint",
    )

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b))

    out = table.withColumns(
        {
            "support_shift_underfill": F.col("selected_count") < F.col("requested_selected_count"),
            "unexplained_alert_count": F.col("alert_count") - F.col("selected_count"),
            "explanation_coverage": share("selected_count", "alert_count"),
            "selected_recall_test_positives": share("selected_positive_count", "test_positive_count"),
            "selected_recall_alert_positives": share("selected_positive_count", "alert_positive_count"),
            "score_only_recall_test_positives": share("score_only_positive_count", "test_positive_count"),
            "score_only_recall_alert_positives": share("score_only_positive_count", "alert_positive_count"),
            "score_only_requested_budget_recall_test_positives": share(
                "score_only_requested_budget_positive_count", "test_positive_count"
            ),
            "score_only_requested_budget_recall_alert_positives": share(
                "score_only_requested_budget_positive_count", "alert_positive_count"
            ),
            "all_alert_precision": share("alert_positive_count", "alert_count"),
            "selected_alert_precision": share("selected_positive_count", "selected_count"),
            "score_only_precision": share("score_only_positive_count", "selected_count"),
            "score_only_requested_budget_precision": share(
                "score_only_requested_budget_positive_count", "requested_selected_count"
            ),
        }
    )
    out = out.withColumns(
        {
            "abstention_rate": share("unexplained_alert_count", "alert_count"),
            "precision_gain_vs_all_alerts": F.col("selected_alert_precision") - F.col("all_alert_precision"),
            "alert_triage_lift": F.when(
                F.col("all_alert_precision") > 0, F.col("selected_alert_precision") / F.col("all_alert_precision")
            ),
            "delta_vs_score_only": F.col("selected_alert_precision") - F.col("score_only_precision"),
            "score_only_headroom": 1 - F.col("score_only_precision"),
            "score_only_requested_budget_headroom": 1 - F.col("score_only_requested_budget_precision"),
        }
    )
    if methods:
        out = out.join(
            F.broadcast(method_fidelity(rows, methods, risk=risk, alert=alert)), "method", "left"
        )
    return out if names else out.drop("variant")


def selection_jaccard(selected: DataFrame, left: str, right: str) -> Column:
    """Aggregate: overlap of two boolean selections; two empty selections overlap fully."""
    either = F.count_if(F.col(left) | F.col(right))
    return F.when(either > 0, F.count_if(F.col(left) & F.col(right)) / either).otherwise(F.lit(1.0))


def shuffle_mapping(names: Sequence[str], seed: int) -> Mapping[str, str]:
    """Deterministic permutation of names (weight-shuffle control)."""
    from hashlib import md5

    order = sorted(names, key=lambda n: md5(f"{seed}|{n}".encode()).hexdigest())
    return dict(zip(sorted(names), order))
