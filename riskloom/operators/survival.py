"""Which selected rules survive when the audit alerts are resampled: all resamples in one pass.

Every alert carries one weight per seed.  Alerts are summed once per activation
pattern and label, with a column per seed; what follows works on patterns,
rules and seeds only, so the number of seeds costs no further pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators import audit, quality
from riskloom.operators.resample import resample_weight
from riskloom.session import stage


def resampled_patterns(
    alerts: DataFrame, truths: Mapping[str, str], hits: Mapping[str, Column], shares: Mapping[str, Column],
    *, label: str, row_id: str, seeds: Sequence[int], activation: float = 0.6,
) -> DataFrame:
    """Per seed, activation pattern and label: summed weight ``n``, and weighted hits and shares of every rule."""
    rules = list(truths)
    pattern = F.concat(*[F.when(F.col(truths[r]) >= activation, "1").otherwise("0") for r in rules])
    slim = alerts.select(
        pattern.alias("pattern"), F.col(label).alias("y"), *[resample_weight(row_id, s).alias(f"w{i}") for i, s in enumerate(seeds)],
        *[source.get(r, F.lit(None)).cast("double").alias(f"{n}{k}") for n, source in (("h", hits), ("s", shares)) for k, r in enumerate(rules)],
    )
    sums = [
        F.struct(
            F.lit(seed).alias("seed"), F.sum(f"w{i}").alias("n"),
            *[F.array(*[F.sum(F.col(f"w{i}") * F.col(f"{n}{k}")) for k in range(len(rules))]).alias(n) for n in ("h", "s")],
        )
        for i, seed in enumerate(seeds)
    ]
    cells = slim.groupBy("pattern", "y").agg(F.array(*sums).alias("seeds"))
    return stage(cells.select("pattern", "y", F.explode("seeds").alias("c")).select("pattern", "y", "c.*"), "resampled-patterns")


def resampled_audits(patterns: DataFrame, train: DataFrame, rules: Sequence[str]) -> DataFrame:
    """The audit table of every seed, against the unchanged ``train_alert_*`` statistics of ``train``."""
    entries = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(k + 1).alias("k")) for k, r in enumerate(rules)])
    long = patterns.select("*", F.explode(entries).alias("r"))
    on = F.substring(F.col("pattern"), F.col("r.k"), F.lit(1)) == "1"
    n, y = F.col("n"), F.col("y") == 1

    def total(condition: Column, value: Column = n) -> Column:
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))

    active = total(on)
    counts = stage(
        long.groupBy("seed", F.col("r.rule").alias("rule")).agg(
            F.sum("n").alias("rows"), total(y).alias("positives"), active.alias("active"), total(on & y).alias("active_positives"),
            F.lit(None).cast("double").alias("truth_sum"),
            *[F.when(active > 0, F.sum(F.when(on, F.element_at(F.col(c), F.col("r.k")))) / active).alias(name) for c, name in (("h", "hit_rate"), ("s", "share"))],
        ),
        "resampled-counts",
    )
    new = audit.weighted_statistics(counts, ["seed"]).withColumns({"role": F.lit("rule_audit"), "scope": F.lit("alert")})
    old = train.select(
        "rule", *[F.col(f"train_alert_{c}").alias(c) for c in (*audit.STATISTICS, "positives")],
        F.lit("train").alias("role"), F.lit("alert").alias("scope"),
    )
    # One row per rule and seed.
    old = old.join(counts.select("seed", "rule"), "rule")
    return audit.audit_rules(
        new.unionByName(old), part="role", train="train", audit="rule_audit", attribution=counts.select("seed", "rule", "hit_rate", "share"), by=["seed"]
    )


def rule_survival(
    alerts: DataFrame, train: DataFrame, reference: Sequence[str], truths: Mapping[str, str],
    hits: Mapping[str, Column], shares: Mapping[str, Column], *, label: str, row_id: str, seeds: Sequence[int],
    activation: float = 0.6, max_jaccard: float = 0.85, max_rules: int = 12,
) -> DataFrame:
    """One row per seed: which reference rules are selected again, and what the selected ones are like.

    ``alerts`` are the audit alerts, ``train`` the audit table that holds the unchanged training
    statistics.  Rows per seed, rule and pair of rules come to the driver.
    """
    rules = list(truths)
    patterns = resampled_patterns(alerts, truths, hits, shares, label=label, row_id=row_id, seeds=seeds, activation=activation)
    audited = resampled_audits(patterns, train, rules).select(
        "seed", "rule", "audit_pass", "audit_alert_score", "audit_alert_coverage", "audit_alert_lift"
    ).collect()
    overlap = quality.rule_overlap(patterns, rules, by=["seed"]).collect()
    rows = []
    for seed in seeds:
        mine = {r["rule"]: r for r in audited if r["seed"] == seed}
        pairs = {(min(r["rule_a"], r["rule_b"]), max(r["rule_a"], r["rule_b"])): float(r["jaccard"]) for r in overlap if r["seed"] == seed}
        decided = audit.greedy_decisions(
            [(r["rule"], bool(r["audit_pass"]), float(r["audit_alert_score"])) for r in mine.values()], pairs,
            max_jaccard=max_jaccard, max_rules=max_rules,
        )
        names = sorted(d.rule for d in decided if d.status == "selected")
        shared = set(names) & set(reference)

        def mean(column: str) -> float | None:
            values = [mine[n][column] for n in names if mine[n][column] is not None]
            return sum(values) / len(values) if values else None

        rows.append(
            (seed, len(names), len(reference), len(shared), len(shared) / len(reference) if reference else None,
             audit.selected_jaccard(names, reference), names, mean("audit_alert_score"), mean("audit_alert_coverage"),
             mean("audit_alert_lift"))
        )
    return alerts.sparkSession.createDataFrame(
        rows,
        "seed int, selected_rule_count int, reference_selected_rule_count int, surviving_reference_rule_count int, "
        "reference_rule_survival_rate double, selected_rule_jaccard double, selected_rules array<string>, "
        "mean_selected_audit_score double, mean_selected_audit_alert_coverage double, mean_selected_audit_alert_lift double",
    )
