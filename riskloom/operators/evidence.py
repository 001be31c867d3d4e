"""Evidence scores: weighted rule truths, gated by rule support."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.fuzzy import clip
from riskloom.operators.audit import Weights

# Names of the evidence methods in order of precedence.
METHOD_PRECEDENCE = (
    "guarded_ensemble",
    "contrastive_meta",
    "attribution_gated",
    "fp_penalized",
    "audit_weighted",
    "unweighted",
)


def _sum(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def supported(truths: Mapping[str, str], rules: Sequence[str], activation: float = 0.6) -> Column:
    """True when at least one of the selected rules is active."""
    if not rules:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [F.col(truths[r]) >= activation for r in rules])


def evidence_score(
    truths: Mapping[str, str], weights: Weights, method: str, shares: Mapping[str, Column] | None = None
) -> Column:
    """One evidence method as a literal-weighted sum of truth columns, clipped to [0, 1]."""
    rules = weights.rules
    if not rules:
        return F.lit(0.0)
    if method == "unweighted":
        terms = [F.col(truths[r]) * F.lit(1.0 / len(rules)) for r in rules]
    elif method == "audit_weighted":
        terms = [F.col(truths[r]) * F.lit(weights.audit[r]) for r in rules]
    elif method == "fp_penalized":
        terms = [F.col(truths[r]) * F.lit(weights.penalised[r]) for r in rules]
    elif method == "attribution_gated":
        if shares is None:
            raise ValueError("attribution_gated needs the attribution share of every rule")
        gates = {r: clip(shares[r], 0.0, 1.0) for r in rules}
        terms = [F.col(truths[r]) * gates[r] * F.lit(weights.penalised[r]) for r in rules]
    else:
        raise ValueError(f"unknown evidence method {method!r}")
    return clip(_sum(terms), 0.0, 1.0)


def evidence_columns(
    truths: Mapping[str, str],
    weights: Weights,
    methods: Sequence[str],
    *,
    shares: Mapping[str, Column] | None = None,
    activation: float = 0.6,
) -> dict[str, Column]:
    """Evidence per method; zero where no selected rule is active."""
    if not methods:
        raise ValueError("at least one evidence method is required")
    support = supported(truths, weights.rules, activation)
    return {
        m: F.when(support, evidence_score(truths, weights, m, shares)).otherwise(F.lit(0.0)) for m in methods
    }


def guarded_ensemble(components: Sequence[str]) -> Column:
    """Mean of at least two different evidence columns."""
    if len(components) < 2 or len(set(components)) != len(components):
        raise ValueError("the ensemble needs at least two different components")
    return _sum([F.col(c) for c in components]) / F.lit(float(len(components)))
