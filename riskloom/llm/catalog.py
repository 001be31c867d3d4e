"""All registered queries of the subpackage."""

from __future__ import annotations

from riskloom.llm import queries as _queries  # noqa: F401
from riskloom.llm.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
