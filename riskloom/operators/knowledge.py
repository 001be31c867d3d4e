"""Knowledge-base level evidence: suspiciousness, satisfaction and soft-threshold tuning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import fuzzy


def suspiciousness(truths: Sequence[str], mode: str = "maximum") -> Column:
    return fuzzy.fuzzy_or([F.col(t) for t in truths], mode)


def satisfaction(df: DataFrame, score: Column, label: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Agreement of evidence and label: overall, per class, and balanced."""
    y = F.col(label)
    agree = F.when(y == 1, score).otherwise(1 - score)
    return (
        df.groupBy(*by)
        .agg(
            F.avg(agree).alias("overall_satisfaction"),
            F.avg(F.when(y == 1, score)).alias("positive_satisfaction"),
            F.avg(F.when(y == 0, 1 - score)).alias("negative_satisfaction"),
        )
        .withColumn(
            "balanced_satisfaction", (F.col("positive_satisfaction") + F.col("negative_satisfaction")) / 2
        )
    )


def rule_compositions(predicates: Mapping[str, Column], rules: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """Product conjunctions of named predicates."""
    unknown = sorted({p for names in rules.values() for p in names} - set(predicates))
    if unknown:
        raise KeyError(f"rules name unknown predicates: {unknown}")
    return {r: fuzzy.fuzzy_and([predicates[p] for p in names], "product") for r, names in rules.items()}


def supervised_satisfaction(evidence: Column, label: Column, p: float = 2.0) -> Column:
    """Aggregate: for all rows, evidence is equivalent to the label."""
    return fuzzy.for_all(fuzzy.equivalent(evidence, label.cast("double")), p)


def tune_soft_threshold(
    df: DataFrame,
    feature: str,
    label: str,
    candidates: Sequence[float],
    *,
    start: float,
    temperature: float,
    direction: str = "greater",
    penalty: float = 0.01,
    p: float = 2.0,
) -> DataFrame:
    """Balanced for-all satisfaction of every candidate threshold, in one aggregate.

    The objective subtracts ``penalty`` times the squared distance from the start.
    """
    x, y = F.col(feature), F.col(label)
    aggregates = []
    for i, theta in enumerate(candidates):
        truth = fuzzy.soft_threshold(x, float(theta), temperature, direction)
        agree = fuzzy.equivalent(truth, y.cast("double"))
        aggregates.append(fuzzy.for_all(F.when(y == 1, agree), p).alias(f"p{i}"))
        aggregates.append(fuzzy.for_all(F.when(y == 0, agree), p).alias(f"n{i}"))
    row = df.agg(*aggregates)
    options = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("threshold"),
                F.col(f"p{i}").alias("positive_satisfaction"),
                F.col(f"n{i}").alias("negative_satisfaction"),
            )
            for i, t in enumerate(candidates)
        ]
    )
    shift = F.col("threshold") - F.lit(float(start))
    return row.select(F.explode(options).alias("o")).select("o.*").withColumn(
        "objective",
        (F.col("positive_satisfaction") + F.col("negative_satisfaction")) / 2 - F.lit(penalty) * shift * shift,
    )
