"""Local attributions of a score and how they support rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE_FLOOR = 1e-12


def linear_attributions(coefficients: Mapping[str, float]) -> dict[str, Column]:
    """Contribution of every feature to the raw margin of a linear scorer."""
    return {f: F.lit(float(c)) * F.col(f).cast("double") for f, c in coefficients.items()}


def largest_effects(attributions: Mapping[str, Column], k: int) -> Column:
    """The ``k`` features with the largest absolute effect; equal effects keep feature order."""
    if k < 1:
        raise ValueError("k must be at least 1")
    entries = F.array(
        *[
            F.struct((-F.abs(a)).alias("size"), F.lit(i).alias("place"), F.lit(f).alias("feature"), a.alias("value"))
            for i, (f, a) in enumerate(attributions.items())
        ]
    )
    return F.slice(F.array_sort(entries), 1, k)


def rule_hit(attributions: Mapping[str, Column], features: Sequence[str], k: int = 5) -> Column:
    """1 when one of the rule's features is among the ``k`` largest effects."""
    known = [f for f in features if f in attributions]
    if not known:
        return F.lit(0.0)
    top = F.transform(largest_effects(attributions, min(k, len(attributions))), lambda e: e["feature"])
    return F.arrays_overlap(top, F.array(*[F.lit(f) for f in known])).cast("double")


def rule_share(attributions: Mapping[str, Column], features: Sequence[str]) -> Column:
    """Share of the total absolute effect that falls on the rule's features."""
    known = sorted({f for f in features if f in attributions})
    if not known:
        return F.lit(0.0)
    total = sum((F.abs(a) for a in attributions.values()), F.lit(0.0))
    own = sum((F.abs(attributions[f]) for f in known), F.lit(0.0))
    return own / F.greatest(total, F.lit(SHARE_FLOOR))


def positive_top_effects(attributions: Mapping[str, Column], k: int = 5) -> Column:
    """Sum of the positive contributions among the ``k`` largest effects."""
    top = largest_effects(attributions, min(k, len(attributions)))
    return F.aggregate(top, F.lit(0.0), lambda s, e: s + F.greatest(e["value"], F.lit(0.0)))


def mean_absolute_attribution(df: DataFrame, attributions: Mapping[str, Column]) -> DataFrame:
    entries = [F.avg(F.abs(a)).alias(f"a{i}") for i, a in enumerate(attributions.values())]
    pairs = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f"a{i}").alias("mean_absolute_attribution"))
          for i, f in enumerate(attributions)]
    )
    return df.agg(*entries).select(F.explode(pairs).alias("e")).select("e.*")
