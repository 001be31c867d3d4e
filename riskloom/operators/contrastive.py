"""Contrastive evidence: how rule truths separate true from false alerts at equal risk."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.evidence import supported
from riskloom.session import stage

RISK_STD_FLOOR = math.sqrt(2.220446049250313e-16)


@dataclass(frozen=True)
class ContrastiveModel:
    """Frozen logistic evidence; ``reason`` tells why it is unavailable."""

    rules: tuple[str, ...]
    reason: str | None = None
    coefficients: Mapping[str, float] = field(default_factory=dict)
    risk_coefficient: float = 0.0
    intercept: float = 0.0
    risk_mean: float = 0.0
    risk_std: float = 0.0
    activation: float = 0.6
    facts: Mapping[str, int] = field(default_factory=dict)

    @property
    def available(self) -> bool:
        return self.reason is None

    def evidence(self, truths: Mapping[str, str], risk: str) -> Column:
        """Evidence of later rows: zero where no rule is active or the model is unavailable."""
        if not self.available:
            return F.lit(0.0)
        margin = F.lit(self.intercept) + F.lit(self.risk_coefficient) * (
            (F.col(risk) - F.lit(self.risk_mean)) / F.lit(self.risk_std)
        )
        for rule in self.rules:
            margin = margin + F.lit(self.coefficients[rule]) * F.col(truths[rule])
        chance = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
        return F.when(supported(truths, self.rules, self.activation), chance).otherwise(F.lit(0.0))

    def coefficient_table(self, spark: SparkSession) -> DataFrame:
        """Coefficients with odds ratios, ranked by absolute size."""
        pairs = [*self.coefficients.items(), ("risk_z", self.risk_coefficient)] if self.available else []
        ordered = sorted(enumerate(pairs), key=lambda p: (-abs(p[1][1]), p[0]))
        rows = [(f, float(c), math.exp(c), abs(c), i + 1) for i, (_, (f, c)) in enumerate(ordered)]
        return spark.createDataFrame(
            rows, "feature string, coefficient double, odds_ratio double, absolute_coefficient double, rank int"
        )


def fit_contrastive(
    audit: DataFrame,
    truths: Mapping[str, str],
    rules: Sequence[str],
    *,
    label: str,
    risk: str,
    alert: str,
    activation: float = 0.6,
    min_alerts: int = 20,
    min_class: int = 5,
    c: float = 1.0,
    max_iter: int = 50,
) -> ContrastiveModel:
    """Balanced logistic regression of the label on rule truths and standardised risk, alerts only."""
    limits = {"min_alerts": min_alerts, "min_class": min_class, "c": c, "max_iter": max_iter}
    keyed = audit.withColumn("__key", F.lit(""))
    names = {"label": label, "risk": risk, "alert": alert, "activation": activation}
    return fit_contrastive_by(keyed, "__key", [""], truths, rules, **names, **limits)[""]


def fit_contrastive_by(
    audit: DataFrame,
    by: str,
    keys: Sequence[str],
    truths: Mapping[str, str],
    rules: Sequence[str],
    *,
    label: str,
    risk: str,
    alert: str,
    activation: float = 0.6,
    min_alerts: int = 20,
    min_class: int = 5,
    c: float = 1.0,
    max_iter: int = 50,
) -> dict[str, ContrastiveModel]:
    """One model for each of ``keys``, the values of column ``by``, such as predictors with their own alerts.

    All keys share the passes: facts and every Newton step are one aggregate with a row per key.
    """
    if min_alerts < 1 or min_class < 1:
        raise ValueError("minimum row counts must be positive")
    if not c > 0:
        raise ValueError("c must be positive")
    rules = tuple(rules)
    frozen = {"rules": rules, "activation": activation}
    if not rules:
        return {k: ContrastiveModel(reason="no_audited_rules", **frozen) for k in keys}
    slim = audit.filter(alert).select(
        F.col(by).alias("key"), F.col(label).cast("double").alias("label"), F.col(risk).alias("risk"),
        *[F.col(truths[r]) for r in rules],
    )
    rows = stage(slim, "contrastive")
    ranges = [e for r in rules for e in (F.min(truths[r]), F.max(truths[r]))]
    facts = {
        r["key"]: r[1:]
        for r in rows.groupBy("key").agg(
            F.count(F.lit(1)),
            F.sum("label"),
            F.avg("risk"),
            F.stddev_pop("risk"),
            F.count_if(supported(truths, rules, activation)),
            *ranges,
        ).collect()
    }
    models: dict[str, ContrastiveModel] = {}
    for key in keys:
        found = facts.get(key, [0, 0, 0.0, 0.0, 0, *[None] * len(ranges)])
        n, positives = int(found[0]), int(found[1] or 0)
        mean, std, support = float(found[2] or 0.0), float(found[3] or 0.0), int(found[4])
        counts = {"alert_rows": n, "tp_alert_rows": positives, "fp_alert_rows": n - positives,
                  "supported_alert_rows": support}
        varies = any(
            found[5 + 2 * i] is not None and found[6 + 2 * i] > found[5 + 2 * i] for i in range(len(rules))
        )
        guards = [
            (n < min_alerts, "insufficient_predictor_alerts"),
            (min(positives, n - positives) < min_class, "insufficient_tp_or_fp_alerts"),
            (support == 0, "no_active_rule_support_among_alerts"),
            (not varies, "non_varying_rule_evidence_among_alerts"),
            (std <= RISK_STD_FLOOR, "non_varying_frozen_risk_among_alerts"),
        ]
        reason = next((r for failed, r in guards if failed), None)
        models[key] = ContrastiveModel(reason=reason, risk_mean=mean, risk_std=std, facts=counts, **frozen)
    fitting = [k for k, m in models.items() if m.available]
    if not fitting:
        return models

    def per_key(value: Callable[[ContrastiveModel], float]) -> Column:
        return by_key("key", {k: value(models[k]) for k in fitting})

    def balance(count: str) -> Column:
        return per_key(lambda m: m.facts["alert_rows"] / (2.0 * m.facts[count]))

    balanced = F.when(F.col("label") == 1, balance("tp_alert_rows")).otherwise(balance("fp_alert_rows"))
    z = (F.col("risk") - per_key(lambda m: m.risk_mean)) / per_key(lambda m: m.risk_std)
    design = [F.col(truths[r]) for r in rules] + [z, F.lit(1.0)]
    ridge = [1.0 / c] * (len(rules) + 1) + [0.0]
    fitted = newton_logistic_by(rows, "key", fitting, design, F.col("label"), balanced, ridge, max_iter)
    for key, values in fitted.items():
        # Numbers that ran away mean no evidence; an error of the cluster is none of these and rises.
        if values is None:
            models[key] = replace(models[key], reason="logistic_fit_failed")
        else:
            models[key] = replace(
                models[key], coefficients=dict(zip(rules, values)), risk_coefficient=values[-2], intercept=values[-1]
            )
    return models


def by_key(key: str, values: Mapping[str, float]) -> Column:
    """The number that belongs to a row's key."""
    out = F.lit(None).cast("double")
    for k, v in values.items():
        out = F.when(F.col(key) == k, F.lit(float(v))).otherwise(out)
    return out


class _Steps:
    """One fit between its passes."""

    def __init__(self, ridge: Sequence[float]) -> None:
        d = len(ridge)
        self.penalty = np.array(ridge)
        self.at, self.step = np.zeros(d), np.zeros(d)
        self.lowest = math.inf
        self.done = self.failed = False

    def advance(self, sums: Sequence[float], upper: Sequence[tuple[int, int]]) -> None:
        d = len(self.at)
        loss = sums[0] + float(self.penalty @ (self.at * self.at)) / 2
        if not math.isfinite(loss):
            self.failed = True
            return
        if loss > self.lowest + 1e-9 * abs(self.lowest):
            self.step = self.step / 2
            self.at = self.at - self.step
            return
        self.lowest = loss
        curve = np.diag(self.penalty)
        for (i, j), v in zip(upper, sums[1 + d :]):
            curve[i, j] += v
            curve[j, i] = curve[i, j]
        self.step = -np.linalg.solve(curve, np.array(sums[1 : 1 + d]) + self.penalty * self.at)
        if not np.isfinite(self.step).all():
            self.failed = True
            return
        self.at = self.at + self.step
        self.done = bool(np.abs(self.step).max() < 1e-11)


def newton_logistic_by(
    rows: DataFrame, by: str, keys: Sequence[str], design: Sequence[Column], label: Column, weight: Column,
    ridge: Sequence[float], max_iter: int,
) -> dict[str, list[float] | None]:
    """Weighted logistic regressions with a ridge per coefficient, one per key; one aggregate pass per Newton step.

    Slope and curvature are sums over rows, so a pass returns one row per key whatever the
    number of rows.  A step that raises the loss is halved.  None if the numbers
    are not finite or no step is small after ``max_iter`` passes.
    """
    d = len(design)
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    fits = {k: _Steps(ridge) for k in keys}
    chance = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("__m")))
    for _ in range(max_iter):
        open_fits = {k: f for k, f in fits.items() if not (f.done or f.failed)}
        if not open_fits:
            break
        margin = F.lit(0.0)
        for i, x in enumerate(design):
            margin = margin + by_key(by, {k: f.at[i] for k, f in open_fits.items()}) * x
        sums = (
            rows.filter(F.col(by).isin(list(open_fits)))
            .select(by, margin.alias("__m"), label.alias("__y"), weight.alias("__w"), *[x.alias(f"__x{i}") for i, x in enumerate(design)])
            .groupBy(by)
            .agg(
                F.sum(F.col("__w") * (F.greatest("__m", F.lit(0.0)) + F.log1p(F.exp(-F.abs("__m"))) - F.col("__y") * F.col("__m"))),
                *[F.sum(F.col("__w") * (chance - F.col("__y")) * F.col(f"__x{i}")) for i in range(d)],
                *[F.sum(F.col("__w") * chance * (1 - chance) * F.col(f"__x{i}") * F.col(f"__x{j}")) for i, j in upper],
            )
        )
        for row in sums.collect():
            open_fits[row[0]].advance(row[1:], upper)
    return {k: [float(b) for b in f.at] if f.done else None for k, f in fits.items()}


def newton_logistic(
    rows: DataFrame, design: Sequence[Column], label: Column, weight: Column, ridge: Sequence[float], max_iter: int
) -> list[float] | None:
    """One regression over all rows."""
    keyed = rows.withColumn("__key", F.lit(""))
    return newton_logistic_by(keyed, "__key", [""], design, label, weight, ridge, max_iter)[""]
