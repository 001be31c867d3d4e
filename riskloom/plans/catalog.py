"""All registered queries."""

from __future__ import annotations

from riskloom.plans import audit_queries, feature_queries, metric_queries, model_queries, policy_queries, predictor_queries, rule_queries, source_queries  # noqa: F401
from riskloom.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
