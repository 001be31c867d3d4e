"""Readable fuzzy rules: fitted on one partition, evaluated as plain Columns anywhere."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import fuzzy
from riskloom.functions.keys import MISSING, category_key, filled_number
from riskloom.operators.ranks import exact_quantiles
from riskloom.session import small, stage, with_constants

RULE_PREFIX = "rule__"
QUANTILE_OPERATORS = ("greater_quantile", "less_quantile")
NATIVE_OPERATORS = ("greater", "less", "outside_range")
OPERATORS = (*QUANTILE_OPERATORS, *NATIVE_OPERATORS, "category_risk", "equals")
CATEGORY_SMOOTHING = 20.0
RISK_PREFIX = "__risk__"


def default_mode(operator: str) -> str:
    if operator not in OPERATORS:
        raise ValueError(f"unknown rule operator {operator!r}")
    return "absolute" if operator in (*NATIVE_OPERATORS, "equals") else "relative"


@dataclass(frozen=True)
class Condition:
    feature: str
    operator: str
    value: Any
    threshold: Any
    softness: float = 0.1
    mode: str = "relative"
    fill: float | None = None
    # The fitted (category, risk) table of a category condition.
    risks: DataFrame | None = field(default=None, compare=False, repr=False)

    def truth(self) -> Column:
        """The condition over a row; a category condition reads the column of ``with_category_risks``."""
        column = F.col(self.feature)
        if self.operator == "category_risk":
            return fuzzy.greater_than(F.col(RISK_PREFIX + self.feature), self.threshold, self.softness, self.mode)
        if self.operator == "equals":
            wanted = self.threshold
            if isinstance(wanted, (int, float)) and not isinstance(wanted, bool):
                hit = column.try_cast("double") == F.lit(float(wanted))
            else:
                hit = category_key(column) == F.lit(str(wanted))
            return F.coalesce(hit, F.lit(False)).cast("double")
        x = filled_number(column, self.fill if self.fill is not None else 0.0)
        if self.operator.startswith("greater"):
            return fuzzy.greater_than(x, self.threshold, self.softness, self.mode)
        if self.operator.startswith("less"):
            return fuzzy.less_than(x, self.threshold, self.softness, self.mode)
        low, high = self.threshold
        return fuzzy.outside_range(x, float(low), float(high), self.softness, self.mode)


@dataclass(frozen=True)
class Rule:
    name: str
    description: str
    conditions: tuple[Condition, ...]
    conjunction: str = "minimum"

    @property
    def column(self) -> str:
        return RULE_PREFIX + self.name

    def truth(self) -> Column:
        return fuzzy.fuzzy_and([c.truth() for c in self.conditions], self.conjunction)


@dataclass(frozen=True)
class RuleBase:
    rules: tuple[Rule, ...]
    skipped: Mapping[str, str] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [r.name for r in self.rules]

    def subset(self, names: Sequence[str]) -> RuleBase:
        return RuleBase(tuple(r for r in self.rules if r.name in set(names)))


def category_risk_table(df: DataFrame, feature: str, target: str) -> DataFrame:
    """Smoothed label rate per category, scaled to [0, 1]."""
    counts = df.groupBy(category_key(F.col(feature)).alias("category")).agg(
        F.sum(F.col(target)).cast("double").alias("positives"), F.count(F.lit(1)).alias("n")
    )
    rate = df.agg(F.avg(F.col(target).cast("double")).alias("rate")).first()["rate"] or 0.0
    raw = counts.withColumn(
        "raw", (F.col("positives") + F.lit(CATEGORY_SMOOTHING * rate)) / (F.col("n") + F.lit(CATEGORY_SMOOTHING))
    )
    ranged = with_constants(raw, raw.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")))
    scaled = (F.col("raw") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return ranged.select(
        "category", "n", F.when(F.col("hi") > F.col("lo"), scaled).otherwise(F.lit(0.0)).alias("risk")
    )


def _check_definitions(definitions: Sequence[Mapping[str, Any]]) -> None:
    names = [d["name"] for d in definitions]
    if len(set(names)) != len(names):
        raise ValueError("rule names must be unique")
    for d in definitions:
        if not d.get("conditions"):
            raise ValueError(f"rule {d['name']!r} has no conditions")
        for c in d["conditions"]:
            default_mode(c["operator"])


def fit_rules(
    train: DataFrame, definitions: Sequence[Mapping[str, Any]], target: str, conjunction: str = "minimum"
) -> RuleBase:
    """Fit quantile thresholds, fill medians and category risks on ``train`` only.

    All numeric statistics come from one pass of exact quantiles; each categorical
    feature adds one small aggregate.
    """
    _check_definitions(definitions)
    present = set(train.columns)
    skipped: dict[str, str] = {}
    usable = []
    for d in definitions:
        missing = [c["feature"] for c in d["conditions"] if c["feature"] not in present]
        if missing:
            skipped[d["name"]] = f"missing features: {', '.join(missing)}"
        else:
            usable.append(d)
    if not usable:
        raise ValueError("no rule is available for the given columns")

    wanted: dict[str, set[float]] = {}
    categories: set[str] = set()
    for d in usable:
        for c in d["conditions"]:
            if c["operator"] == "category_risk":
                categories.add(c["feature"])
            elif c["operator"] != "equals":
                spots = wanted.setdefault(c["feature"], {0.5})
                if c["operator"] in QUANTILE_OPERATORS:
                    spots.add(float(c["value"]))
    numeric = train.select(*[F.col(f).try_cast("double").alias(f) for f in wanted]) if wanted else None
    quantiles = exact_quantiles(numeric, {f: sorted(q) for f, q in wanted.items()}) if wanted else {}
    risks = {
        feature: small(stage(category_risk_table(train, feature, target).select("category", "risk"), "category-risks"))
        for feature in sorted(categories)
    }

    fitted = []
    for d in usable:
        conditions = []
        for c in d["conditions"]:
            op, feature, value = c["operator"], c["feature"], c["value"]
            threshold = quantiles[feature][float(value)] if op in QUANTILE_OPERATORS else value
            fill = None
            if op not in ("category_risk", "equals"):
                fill = quantiles[feature][0.5]
                fill = 0.0 if fill is None else fill
            if threshold is None:
                raise ValueError(f"{feature} has no numeric value to fit a quantile on")
            conditions.append(
                Condition(feature, op, value, threshold, float(c.get("softness", 0.1)),
                          str(c.get("softness_mode", default_mode(op))), fill,
                          risks[feature] if op == "category_risk" else None)
            )
        fitted.append(
            Rule(d["name"], d.get("description", d["name"].replace("_", " ")), tuple(conditions),
                 d.get("conjunction", conjunction))
        )
    return RuleBase(tuple(fitted), skipped)


def with_category_risks(df: DataFrame, conditions: Sequence[Condition]) -> DataFrame:
    """Add the fitted risk of each category condition's feature; a category that was not fitted has risk 0."""
    done = set()
    for c in conditions:
        if c.operator != "category_risk" or c.feature in done:
            continue
        done.add(c.feature)
        name = RISK_PREFIX + c.feature
        table = c.risks.select(F.col("category").alias("__category"), F.col("risk").alias(name))
        df = df.join(table, category_key(F.col(c.feature)) == F.col("__category"), "left").drop("__category")
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(0.0)))
    return df


def with_truth(df: DataFrame, base: RuleBase) -> DataFrame:
    """Add one truth column per rule; a narrow projection behind the joins of category risks."""
    risky = with_category_risks(df, [c for r in base.rules for c in r.conditions])
    return risky.withColumns({r.column: r.truth() for r in base.rules}).drop(*[c for c in risky.columns if c.startswith(RISK_PREFIX)])


def truth_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(RULE_PREFIX)]


def threshold_table(spark: SparkSession, base: RuleBase) -> DataFrame:
    """The fitted rule base as a table, one row per condition."""
    rows = [
        (r.name, c.feature, c.operator, str(c.value),
         float(c.threshold) if isinstance(c.threshold, (int, float)) else None,
         float(c.softness), c.mode, c.fill)
        for r in base.rules
        for c in r.conditions
    ]
    return spark.createDataFrame(
        rows,
        "rule string, feature string, operator string, configured_value string, fitted_threshold double, "
        "softness double, softness_mode string, fitted_missing_value double",
    )


REGISTRY_SCHEMA = (
    "rule string, tier string, source string, description string, feature_space string, features array<string>, "
    "conditions array<struct<feature:string,operator:string,value:double,softness:double>>, "
    "status string, skip_reason string"
)
# The order of rule tiers.
TIER_ORDER = ("A", "B", "C", "baseline")


def rule_registry(
    spark: SparkSession,
    definitions: Sequence[Mapping[str, Any]],
    base: RuleBase,
    *,
    tier: str,
    source: str = "configured",
    derived: Sequence[str] = (),
) -> DataFrame:
    """Candidate registry: one row per configured rule, fitted or skipped with its reason."""
    if tier not in TIER_ORDER:
        raise ValueError(f"unknown tier {tier!r}")
    fitted = {r.name: r for r in base.rules}
    rows = []
    for d in definitions:
        features = sorted({c["feature"] for c in d["conditions"]})
        kinds = {f in set(derived) for f in features}
        space = "mixed" if len(kinds) == 2 else ("derived" if kinds == {True} else "raw")
        conditions = [
            (c.feature, c.operator, float(c.threshold) if isinstance(c.threshold, (int, float)) else None, c.softness)
            for c in (fitted[d["name"]].conditions if d["name"] in fitted else ())
        ]
        reason = base.skipped.get(d["name"])
        rows.append((d["name"], tier, source, d.get("description", d["name"].replace("_", " ")), space, features,
                     conditions, "skipped" if reason else "fitted", reason))
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)


def combine_registries(*registries: DataFrame) -> DataFrame:
    """Union of registries ordered by tier; a rule name may appear once."""
    union = registries[0]
    for other in registries[1:]:
        union = union.unionByName(other, allowMissingColumns=True)
    twice = union.groupBy("rule").count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"rule names appear more than once: {sorted(r['rule'] for r in twice)}")
    place = F.array_position(F.array(*[F.lit(t) for t in TIER_ORDER]), F.col("tier"))
    return union.orderBy(place, "rule")


def distinct_rules(registry: DataFrame) -> DataFrame:
    """One row per rule: the first by tier, then by source."""
    place = F.array_position(F.array(*[F.lit(t) for t in TIER_ORDER]), F.col("tier"))
    rest = [c for c in registry.columns if c != "rule"]
    first = F.min_by(F.struct(*rest), F.struct(place, F.col("source")))
    return registry.groupBy("rule").agg(first.alias("r")).select("rule", "r.*")


def unseen_share(df: DataFrame, condition: Condition) -> DataFrame:
    """One row: the share of rows whose category was not seen when the risk was fitted."""
    known = condition.risks.select(F.col("category").alias("__category"))
    joined = df.join(known, category_key(F.col(condition.feature)) == F.col("__category"), "left")
    return joined.agg(F.avg(F.col("__category").isNull().cast("double")).alias("unseen_share"))


__all__ = [
    "Condition", "Rule", "RuleBase", "MISSING", "fit_rules", "with_truth", "with_category_risks", "truth_columns", "threshold_table",
    "rule_registry", "combine_registries", "distinct_rules", "category_risk_table", "unseen_share",
]
