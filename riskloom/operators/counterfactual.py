"""Candidate rules from counterfactual tails of a frozen score, and recomputed features."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.keys import to_number
from riskloom.functions.semantics import EPSILON, log_amount
from riskloom.operators.ranks import exact_quantiles

# Approved formulas with their number of inputs, and features that cannot be set directly.
FORMULAS = {
    "log1p_nonnegative": 1,
    "absolute_relative_difference": 2,
    "amount_to_absolute_balance_fraction": 2,
}
HISTORY_DERIVED = (
    "sender_seconds_since_previous",
    "receiver_seconds_since_previous",
    "pair_prior_transaction_count",
)
SEMANTIC_DERIVED = (
    "amount_paid_log",
    "amount_received_log",
    "amount_relative_difference",
    "amount_log",
    "amount_to_sender_balance_fraction",
)

Score = Callable[[Mapping[str, Column]], Column]


def check_contract(contract: Mapping[str, Sequence[Mapping[str, Any]]], columns: Sequence[str]) -> None:
    """Derived features are declared by formula name; anything callable or unknown is refused."""
    for source, specs in contract.items():
        for spec in specs:
            if any(callable(v) for v in spec.values()):
                raise ValueError(f"{source}: a derived feature is a named formula, not a function")
            formula = spec.get("formula")
            if formula not in FORMULAS:
                raise ValueError(f"{source}: unknown formula {formula!r}")
            inputs = list(spec.get("inputs", ()))
            if len(inputs) != FORMULAS[formula]:
                raise ValueError(f"{source}: {formula} takes {FORMULAS[formula]} inputs")
            if source not in inputs:
                raise ValueError(f"{source}: the formula of {spec.get('output')!r} does not use it")
            missing = [c for c in [*inputs, spec.get("output")] if c not in columns]
            if missing:
                raise ValueError(f"{source}: unknown columns {missing}")


def formula_column(formula: str, inputs: Sequence[Column]) -> Column:
    x = [to_number(c) for c in inputs]
    if formula == "log1p_nonnegative":
        return log_amount(x[0])
    if formula == "absolute_relative_difference":
        return F.abs(x[0] - x[1]) / (F.abs(x[0]) + F.abs(x[1]) + F.lit(EPSILON))
    if formula == "amount_to_absolute_balance_fraction":
        share = x[0] / F.greatest(F.abs(x[1]), F.lit(EPSILON))
        share = F.when(x[1].isNull() | (F.abs(share) == F.lit(float("inf"))), F.lit(0.0)).otherwise(share)
        return F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.coalesce(share, F.lit(0.0))))
    raise ValueError(f"unknown formula {formula!r}")


def recomputed(values: Mapping[str, Column], specs: Sequence[Mapping[str, Any]]) -> dict[str, Column]:
    """Column values after the derived features of a contract are computed again."""
    out = dict(values)
    for spec in specs:
        out[spec["output"]] = formula_column(spec["formula"], [out[i] for i in spec["inputs"]])
    return out


def counterfactual_tails(
    train: DataFrame,
    score: Score,
    features: Sequence[str],
    *,
    inputs: Sequence[str],
    quantile: float = 0.9,
    min_drop: float = 0.005,
    material_drop: float | None = None,
    min_affected: float = 0.05,
    min_tail_rows: int = 25,
    max_candidates: int = 8,
    contract: Mapping[str, Sequence[Mapping[str, Any]]] | None = None,
    blocked: Sequence[str] = (*HISTORY_DERIVED, *SEMANTIC_DERIVED),
) -> DataFrame:
    """Score drop in both tails when a feature is set to its training median.

    All rescored columns stand side by side, so the table is read once for the quantiles and
    once for all features and tails.  One row per feature comes out.
    """
    if not 0.5 < quantile < 1.0:
        raise ValueError("quantile must lie between 0.5 and 1")
    refused = sorted(set(features) & set(blocked))
    if refused:
        raise ValueError(f"derived features cannot be set directly: {refused}")
    contract = contract or {}
    check_contract(contract, train.columns)
    material = min_drop if material_drop is None else material_drop
    if material < 0:
        raise ValueError("material_drop must not be negative")
    spark = train.sparkSession
    low = 1.0 - quantile
    present = [f for f in features if f in train.columns]
    numbers = train.select(*[to_number(F.col(f)).alias(f) for f in present])
    fitted = exact_quantiles(numbers, {f: [low, 0.5, quantile, 0.0, 1.0] for f in present})
    usable = [
        f for f in present if f in inputs and fitted[f][0.5] is not None and fitted[f][1.0] > fitted[f][0.0]
    ]
    values = {c: F.col(c) for c in {*inputs, *(i for s in contract.values() for x in s for i in (*x["inputs"], x["output"]))}}
    baseline = score(values)
    rescored, aggregates = {}, []
    for i, f in enumerate(usable):
        observed = to_number(F.col(f)).isNotNull()
        changed = dict(values)
        changed[f] = F.when(observed, F.lit(fitted[f][0.5])).otherwise(F.col(f).cast("double"))
        rescored[f"__d{i}"] = baseline - score(recomputed(changed, contract.get(f, ())))
        d, x = F.col(f"__d{i}"), to_number(F.col(f))
        tails = {"h": x >= fitted[f][quantile], "l": x <= fitted[f][low]}
        aggregates.append(F.avg(F.when(observed, d)).alias(f"o{i}"))
        for t, inside in tails.items():
            aggregates += [
                F.count_if(inside).alias(f"{t}n{i}"),
                F.avg(F.when(inside, d)).alias(f"{t}m{i}"),
                F.avg(F.when(inside, F.greatest(d, F.lit(0.0)))).alias(f"{t}p{i}"),
                F.avg(F.when(inside, (d >= material).cast("double"))).alias(f"{t}a{i}"),
            ]
    facts = train.withColumns(rescored).agg(*aggregates).first() if usable else None
    table, viable = {}, []
    for f in features:
        if f not in usable:
            reason = (
                "missing_from_training_frame" if f not in train.columns
                else "not_used_by_score" if f not in inputs else "non_varying_or_non_numeric"
            )
            table[f] = (f, False, False, reason, *[None] * 11)
            continue
        i = usable.index(f)

        def drop(t: str) -> float:
            value = facts[f"{t}m{i}"]
            return float("-inf") if value is None else value

        t = "h" if drop("h") >= drop("l") else "l"
        rows, mean, share = facts[f"{t}n{i}"], facts[f"{t}m{i}"], facts[f"{t}a{i}"]
        good = rows >= min_tail_rows and mean is not None and mean >= min_drop and share >= min_affected
        side = ("high", "greater_quantile", quantile) if t == "h" else ("low", "less_quantile", low)
        if good:
            viable.append((-mean, -share, f))
        table[f] = (
            f, bool(good), False, "material_score_drop" if good else "below_materiality_gate", fitted[f][0.5],
            *side, fitted[f][quantile if t == "h" else low], int(rows), mean, facts[f"{t}p{i}"], share,
            facts[f"hm{i}"], facts[f"lm{i}"],
        )
    chosen = {f for _, _, f in sorted(viable)[:max_candidates]}
    rows = []
    for f, r in table.items():
        if f in chosen:
            r = (*r[:2], True, "selected", *r[4:])
        elif r[1]:
            r = (*r[:3], "candidate_budget_exceeded", *r[4:])
        rows.append(r)
    return spark.createDataFrame(
        rows,
        "feature string, eligible boolean, selected boolean, reason string, train_median double, direction string, "
        "operator string, configured_value double, fitted_threshold double, tail_rows bigint, "
        "tail_mean_score_drop double, tail_mean_positive_score_drop double, tail_affected_fraction double, "
        "upper_tail_mean_score_drop double, lower_tail_mean_score_drop double",
    )


def counterfactual_definitions(tails: DataFrame, softness: float = 0.15) -> list[dict[str, Any]]:
    """Rule definitions of the selected tails (at most ``max_candidates`` rows)."""
    rows = tails.filter("selected").orderBy(F.col("tail_mean_score_drop").desc(), "feature").collect()
    return [
        {
            "name": f"counterfactual_{r['direction']}_{r['feature']}",
            "description": f"{r['feature']} is in its {r['direction']} training tail and raises the score.",
            "conditions": [
                {"feature": r["feature"], "operator": r["operator"], "value": r["configured_value"],
                 "softness": softness}
            ],
        }
        for r in rows
    ]
