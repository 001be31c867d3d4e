"""Per-row explanations built from rule truths with array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.rules import RuleBase

# Fixed value: the text shown when no rule is active.
NO_EVIDENCE = "No configured rule reached the activation threshold."
# Order of outcome groups in case reports.
CASE_GROUPS = tuple(
    f"{case}_{status}"
    for case in ("true_positive", "false_positive", "false_negative", "true_negative")
    for status in ("explained", "unexplained")
)


def active_rules(base: RuleBase, activation: float) -> Column:
    """Active rules as structs, strongest first; equal truths keep the rule order."""
    entries = F.array(
        *[
            F.struct(
                (-F.col(r.column)).alias("weakness"),
                F.lit(i).alias("place"),
                F.lit(r.name).alias("rule"),
                F.lit(r.description).alias("description"),
            )
            for i, r in enumerate(base.rules)
        ]
    )
    return F.array_sort(F.filter(entries, lambda e: e["weakness"] <= -activation))


def with_explanations(
    df: DataFrame,
    base: RuleBase,
    *,
    activation: float = 0.6,
    top_k: int = 3,
    probability: str | None = None,
    threshold: float = 0.5,
) -> DataFrame:
    """Counts, names and strengths of active rules, and a sentence per row."""
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    out = df.withColumn("__active", active_rules(base, activation))
    out = out.withColumn("__shown", F.slice("__active", 1, top_k))
    alert = F.col(probability) >= threshold if probability else F.lit(None).cast("boolean")
    return out.withColumns(
        {
            "predicted_alert": alert,
            "explained": F.size("__active") > 0,
            "active_rule_count": F.size("__active"),
            "displayed_rule_count": F.size("__shown"),
            "available_rule_count": F.lit(len(base.rules)),
            "rule_names": F.transform("__shown", lambda e: e["rule"]),
            "rule_strengths": F.transform("__shown", lambda e: -e["weakness"]),
            "max_rule_strength": F.coalesce(-F.get("__shown", F.lit(0))["weakness"], F.lit(0.0)),
            "explanation": F.when(
                F.size("__shown") > 0, F.concat_ws(" ", F.transform("__shown", lambda e: e["description"]))
            ).otherwise(F.lit(NO_EVIDENCE)),
        }
    ).drop("__active", "__shown")


def strongest_rule(base: RuleBase) -> Column:
    """Struct (truth, rule) of the rule with the highest truth; the first one wins a tie."""
    entries = [
        F.struct(F.col(r.column).alias("truth"), F.lit(-i).alias("place"), F.lit(r.name).alias("rule"))
        for i, r in enumerate(base.rules)
    ]
    return entries[0] if len(entries) == 1 else F.greatest(*entries)


def case_group(alert: Column, label: Column, explained: Column) -> Column:
    case = (
        F.when(alert & (label == 1), F.lit("true_positive"))
        .when(alert, F.lit("false_positive"))
        .when(label == 1, F.lit("false_negative"))
        .otherwise(F.lit("true_negative"))
    )
    status = F.when(explained, F.lit("explained")).otherwise(F.lit("unexplained"))
    return F.concat_ws("_", case, status)


def top_cases(df: DataFrame, group: str, score: str, row_id: str, k: int = 2) -> DataFrame:
    """The ``k`` highest-scoring rows of each group; partial limits run before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(row_id))
    return df.withColumn("case_rank", F.row_number().over(order)).filter(F.col("case_rank") <= k)


def case_evidence(base: RuleBase, activation: float = 0.6) -> Column:
    """Nested audit record: each active rule, or the strongest one, with its fitted conditions."""

    def details(rule):
        return F.array(
            *[
                F.struct(
                    F.lit(c.feature).alias("feature"),
                    F.lit(c.operator).alias("operator"),
                    F.col(c.feature).cast("string").alias("raw_value"),
                    F.lit(str(c.threshold)).alias("fitted_threshold"),
                    F.lit(c.fill).cast("double").alias("fitted_missing_value"),
                    F.lit(c.softness).alias("softness"),
                    F.lit(c.mode).alias("softness_mode"),
                )
                for c in rule.conditions
            ]
        )

    best = strongest_rule(base)["rule"]
    entries = F.array(
        *[
            F.struct(
                (-F.col(r.column)).alias("weakness"),
                F.lit(r.name).alias("rule"),
                (F.col(r.column) >= activation).alias("activated"),
                F.col(r.column).alias("truth_strength"),
                details(r).alias("conditions"),
            )
            for r in base.rules
        ]
    )
    any_active = F.exists(entries, lambda e: e["activated"])
    kept = F.filter(entries, lambda e: e["activated"] | (~any_active & (e["rule"] == best)))
    return F.transform(
        F.array_sort(kept, lambda a, b: F.when(a["weakness"] < b["weakness"], -1)
                     .when(a["weakness"] > b["weakness"], 1).otherwise(0)),
        lambda e: F.struct(e["rule"].alias("rule"), e["activated"].alias("activated"),
                           e["truth_strength"].alias("truth_strength"), e["conditions"].alias("conditions")),
    )
