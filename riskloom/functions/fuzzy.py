"""Fuzzy predicates and connectives as Columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Clip of the sigmoid argument, smallest transition width, clip of a probability.
SIGMOID_CLIP = 50.0
MIN_SCALE = 1e-6
PROBABILITY_CLIP = 1e-7


def clip(x: Column, low: float, high: float) -> Column:
    """Bounds that keep a null a null (``greatest`` and ``least`` alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def sigmoid(x: Column) -> Column:
    bounded = clip(x, -SIGMOID_CLIP, SIGMOID_CLIP)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-bounded))


def transition_width(threshold: float, softness: float, mode: str) -> float:
    """The sigmoid scale: native units (``absolute``) or a share of the threshold (``relative``)."""
    width = float(softness)
    if not (math.isfinite(width) and width > 0):
        raise ValueError("softness must be a finite, positive number")
    if mode == "absolute":
        return max(width, MIN_SCALE)
    if mode == "relative":
        return max(abs(float(threshold)) * width, width, MIN_SCALE)
    raise ValueError(f"unknown softness mode {mode!r}")


def greater_than(x: Column, threshold: float, softness: float = 1.0, mode: str = "relative") -> Column:
    return sigmoid((x - F.lit(float(threshold))) / F.lit(transition_width(threshold, softness, mode)))


def less_than(x: Column, threshold: float, softness: float = 1.0, mode: str = "relative") -> Column:
    return sigmoid((F.lit(float(threshold)) - x) / F.lit(transition_width(threshold, softness, mode)))


def outside_range(
    x: Column, lower: float, upper: float, softness: float = 1.0, mode: str = "relative"
) -> Column:
    return F.greatest(less_than(x, lower, softness, mode), greater_than(x, upper, softness, mode))


def _one_or(function, columns: Sequence[Column]) -> Column:
    return columns[0] if len(columns) == 1 else function(*columns)


def fuzzy_and(truths: Sequence[Column], mode: str = "minimum") -> Column:
    if not truths:
        raise ValueError("a conjunction needs at least one truth value")
    if mode == "minimum":
        return _one_or(F.least, truths)
    if mode == "product":
        return reduce(lambda a, b: a * b, truths)
    raise ValueError(f"unknown conjunction {mode!r}")


def fuzzy_or(truths: Sequence[Column], mode: str = "maximum") -> Column:
    if not truths:
        raise ValueError("a disjunction needs at least one truth value")
    if mode == "maximum":
        return _one_or(F.greatest, truths)
    if mode == "probabilistic_sum":
        return F.lit(1.0) - reduce(lambda a, b: a * b, [F.lit(1.0) - t for t in truths])
    raise ValueError(f"unknown disjunction {mode!r}")


def negate(a: Column) -> Column:
    return F.lit(1.0) - a


def implies(a: Column, b: Column) -> Column:
    return F.lit(1.0) - a + a * b


def equivalent(a: Column, b: Column) -> Column:
    return implies(a, b) * implies(b, a)


def soft_threshold(x: Column, threshold: float, temperature: float, direction: str = "greater") -> Column:
    if direction not in ("greater", "less"):
        raise ValueError("direction must be 'greater' or 'less'")
    sign = 1.0 if direction == "greater" else -1.0
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(sign) * (x - F.lit(threshold)) / F.lit(max(temperature, MIN_SCALE)))))


def for_all(truth: Column, p: float = 2.0) -> Column:
    """Aggregate: one minus the power mean of the errors."""
    error = F.lit(1.0) - clip(truth, 0.0, 1.0)
    return F.lit(1.0) - F.pow(F.avg(F.pow(error, F.lit(float(p)))), F.lit(1.0 / p))


def clip_probability(p: Column) -> Column:
    return clip(p, PROBABILITY_CLIP, 1.0 - PROBABILITY_CLIP)
