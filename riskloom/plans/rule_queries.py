"""Fitted rules, their truths, explanations and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import fuzzy
from riskloom.operators import explain, joins, knowledge, quality, rules
from riskloom.operators.ranks import exact_quantiles
from riskloom.plans import binding
from riskloom.plans.binding import ACTIVATION, ALERT_THRESHOLD, RULE_NAMES, RULES, TRUTHS
from riskloom.plans.oracle import NAMES, any_active, count_active, sql, threshold_name, unpivot_rules
from riskloom.plans.registry import query


def r6(expression: str, name: str) -> str:
    return f"round({expression}, 6) as {name}"


@query("category_risk", sql("catrisk", "select category, n, round(risk_value, 6) as risk from catrisk"))
def category_risk(spark, sf_dir):
    train = binding.audit(spark, sf_dir).part("train")
    return rules.category_risk_table(train, "payment_format", "label")


def _threshold_sql() -> str:
    parts = []
    for r in RULES:
        for c in r["conditions"]:
            f, op, v = c["feature"], c["operator"], c["value"]
            default = "absolute" if op in ("greater", "less", "outside_range", "equals") else "relative"
            t = (
                threshold_name(f, v) if op.endswith("quantile")
                else "null::double" if op == "outside_range" else f"{v}::double"
            )
            fill = "null::double" if op in ("category_risk", "equals") else f"m_{f}"
            parts.append(
                f"select '{r['name']}' as rule, '{f}' as feature, '{op}' as operator, '{v}' as configured_value, "
                f"round({t}, 6) as fitted_threshold, {c.get('softness', 0.1)}::double as softness, "
                f"'{c.get('softness_mode', default)}' as softness_mode, round({fill}, 6) as fitted_missing_value from fit"
            )
    return " union all ".join(parts)


@query("rule_thresholds", sql("fit", _threshold_sql()))
def rule_thresholds(spark, sf_dir):
    """Fits the rules on the training part anew."""
    train = binding.audit(spark, sf_dir).part("train")
    return rules.threshold_table(spark, rules.fit_rules(train, RULES, "label"))


@query("rule_truth", sql("truth", "select txn_id, " + ", ".join(r6(f"rule__{n}", f"rule__{n}") for n in NAMES) + " from truth"))
def rule_truth(spark, sf_dir):
    return binding.audit(spark, sf_dir).rows.select("txn_id", *TRUTHS.values())


ABSENT = {"name": "needs_device", "conditions": [{"feature": "device", "operator": "equals", "value": "x"}]}
DERIVED = ["amount_relative_difference", "sender_prior_transaction_count", "sender_seconds_since_previous", "cross_bank"]


def _registry_sql() -> str:
    parts = []
    for r in RULES:
        features = sorted({c["feature"] for c in r["conditions"]})
        kinds = {f in DERIVED for f in features}
        space = "mixed" if len(kinds) == 2 else "derived" if kinds == {True} else "raw"
        for c in r["conditions"]:
            f, op, v = c["feature"], c["operator"], c["value"]
            t = threshold_name(f, v) if op.endswith("quantile") else "null::double" if op == "outside_range" else f"{v}::double"
            parts.append(
                f"select '{r['name']}' as rule, 'A' as tier, '{space}' as feature_space, '{','.join(features)}' as features, '{f}' as feature, "
                f"'{op}' as operator, round({t}, 6) as value, {c.get('softness', 0.1)}::double as softness, 'fitted' as status, null::varchar as skip_reason from fit"
            )
    parts.append("select 'needs_device', 'A', 'raw', 'device', null, null, null, null, 'skipped', 'missing features: device'")
    return " union all ".join(parts)


@query("rule_registry", sql("fit", _registry_sql()))
def rule_registry(spark, sf_dir):
    """Rules fitted on the tables, and one whose feature is absent; a row per condition."""
    train = binding.audit(spark, sf_dir).part("train")
    own = [*RULES, ABSENT]
    table = rules.rule_registry(spark, own, rules.fit_rules(train, own, "label"), tier="A", derived=DERIVED)
    found = rules.combine_registries(rules.distinct_rules(table))
    return found.select(
        "rule", "tier", "feature_space", F.array_join("features", ",").alias("features"), F.explode_outer("conditions").alias("c"), "status", "skip_reason"
    ).select("rule", "tier", "feature_space", "features", "c.*", "status", "skip_reason")


@query(
    "category_lookup",
    sql("catrisk", """, p as (select r.txn_id, coalesce(risk_value, 0) as risk_value from roled r
        left join catrisk on coalesce(payment_format, '<MISSING>') = category)
      select txn_id, round(risk_value, 6) as category_risk from p"""),
)
def category_lookup(spark, sf_dir):
    audit = binding.audit(spark, sf_dir)
    condition = next(c for r in audit.rules.rules for c in r.conditions if c.operator == "category_risk")
    return rules.with_category_risks(audit.rows, [condition]).select("txn_id", F.col(rules.RISK_PREFIX + condition.feature).alias("category_risk"))


MAX_OR = "greatest(" + ", ".join(f"rule__{n}" for n in NAMES) + ")"
PROB_OR = "(1 - " + " * ".join(f"(1 - rule__{n})" for n in NAMES) + ")"


@query("suspiciousness", sql("truth", f"select txn_id, {r6(MAX_OR, 'maximum')}, {r6(PROB_OR, 'probabilistic_sum')} from truth"))
def suspiciousness(spark, sf_dir):
    columns = list(TRUTHS.values())
    return binding.audit(spark, sf_dir).rows.select(
        "txn_id", *[knowledge.suspiciousness(columns, m).alias(m) for m in ("maximum", "probabilistic_sum")]
    )


@query(
    "kb_satisfaction",
    sql("truth", f""", s as (select role, label as y, {MAX_OR} as v from truth),
      g as (select role, avg(case when y = 1 then v else 1 - v end) as a, avg(case when y = 1 then v end) as p,
        avg(case when y = 0 then 1 - v end) as q from s group by 1)
      select role, {r6('a', 'overall_satisfaction')}, {r6('p', 'positive_satisfaction')},
        {r6('q', 'negative_satisfaction')}, {r6('(p + q) / 2', 'balanced_satisfaction')} from g"""),
)
def kb_satisfaction(spark, sf_dir):
    rows = binding.audit(spark, sf_dir).rows
    return knowledge.satisfaction(rows, knowledge.suspiciousness(list(TRUTHS.values())), "label", by=["role"])


@query(
    "forall_satisfaction",
    sql("truth", """, e as (select role, label as y, rule__high_amount * rule__deep_discount as a,
          rule__busy_sender * rule__low_balance as b from truth),
        s as (select *, 1 - (1 - a) * (1 - b) as v from e),
        t as (select *, (1 - v + v * y) * (1 - y + y * v) as q from s)
      select role, round(1 - sqrt(avg(pow(1 - greatest(0, least(1, a)), 2))), 6) as first_rule,
        round(1 - sqrt(avg(pow(1 - greatest(0, least(1, 1 - a)), 2))), 6) as not_first_rule,
        round(1 - sqrt(avg(pow(1 - greatest(0, least(1, q)), 2))), 6) as supervised from t group by 1"""),
)
def forall_satisfaction(spark, sf_dir):
    """Named predicates composed to rules, and for-all satisfaction over the rows."""
    rows = binding.audit(spark, sf_dir).rows
    composed = knowledge.rule_compositions(
        {n: F.col(c) for n, c in TRUTHS.items()},
        {"first": ["high_amount", "deep_discount"], "second": ["busy_sender", "low_balance"]},
    )
    evidence = fuzzy.fuzzy_or(list(composed.values()), "probabilistic_sum")
    return rows.groupBy("role").agg(
        fuzzy.for_all(composed["first"]).alias("first_rule"),
        fuzzy.for_all(fuzzy.negate(composed["first"])).alias("not_first_rule"),
        knowledge.supervised_satisfaction(evidence, F.col("label")).alias("supervised"),
    )


GRID = [i * 0.25 for i in range(-4, 9)]


@query(
    "soft_threshold_grid",
    sql("fit", """, z as (select label as y, (amount_paid - m_amount_paid) / s as x
          from roled, fit, (select stddev_samp(amount_paid) as s from roled where role = 'train') where role = 'train'),
        st as (select quantile_cont(x, 0.9) as t0 from z),
        g as (select (i * 0.25)::double as threshold from range(-4, 9) r(i)),
        v as (select threshold, y, 1 / (1 + exp(-(x - threshold) / 0.5)) as e from z cross join g),
        a as (select threshold, 1 - sqrt(avg(case when y = 1 then pow(1 - e, 2) end)) as p,
          1 - sqrt(avg(case when y = 0 then pow(e, 2) end)) as q from v group by 1)
      select threshold, round(p, 6) as positive_satisfaction, round(q, 6) as negative_satisfaction,
        round((p + q) / 2 - 0.01::double * pow(threshold - t0, 2), 6) as objective from a cross join st"""),
)
def soft_threshold_grid(spark, sf_dir):
    """Objective of every candidate threshold of one soft predicate on the training part."""
    train = binding.audit(spark, sf_dir).part("train").select("amount_paid", "label")
    centre = exact_quantiles(train, {"amount_paid": [0.5, 0.9]})["amount_paid"]
    spread = train.agg(F.stddev_samp("amount_paid")).first()[0]
    scaled = train.select("label", ((F.col("amount_paid") - centre[0.5]) / spread).alias("x"))
    return knowledge.tune_soft_threshold(
        scaled, "x", "label", GRID, start=(centre[0.9] - centre[0.5]) / spread, temperature=0.5
    )


RULE_AUC = """
  auc as (
    select role, rule, (sum(case when y = 1 then r end) - p * (p + 1) / 2.0) / (p * q) as rule_auc from (
      select *, rank() over (partition by role, rule order by v) + (count(*) over (partition by role, rule, v) - 1) / 2.0 as r,
        sum(y) over (partition by role, rule) as p, sum(1 - y) over (partition by role, rule) as q from long)
    group by role, rule, p, q)"""

QUALITY = f"""
  long as materialized ({unpivot_rules('role, label as y')}),{RULE_AUC},
  base as (select role, rule, count(*) as n, avg(y) as b, sum((v >= {ACTIVATION})::int) as act,
    avg(case when v >= {ACTIVATION} then y end) as prec, avg(v) as m from long group by 1, 2),
  quality as (
  select role, rule, n as evaluated_rows, round(act / n, 6) as coverage, act::bigint as active_count,
    round(prec, 6) as "precision", round(case when b > 0 then prec / b end, 6) as lift, round(m, 6) as mean_truth,
    round(rule_auc, 6) as rule_auc from base join auc using (role, rule))"""


@query("rule_quality", sql("truth", f", {QUALITY} select * exclude (role) from quality where role = 'test'"))
def rule_quality(spark, sf_dir):
    """Coverage, precision, lift and AUC of each rule on the latest transactions."""
    return quality.rule_quality(binding.audit(spark, sf_dir).part("test"), TRUTHS, "label", activation=ACTIVATION)


@query("rule_quality_by_role", sql("truth", f", {QUALITY} select * from quality"))
def rule_quality_by_role(spark, sf_dir):
    return quality.rule_quality(binding.audit(spark, sf_dir).rows, TRUTHS, "label", activation=ACTIVATION, by=["role"])


@query(
    "quality_change",
    sql("truth", f""", {QUALITY.replace('round(', '(').replace(', 6)', ')')}
      select rule, round(a.lift, 6) as lift_validation, round(b.lift, 6) as lift_test, round(b.lift - a.lift, 6) as lift_change,
        round(a.coverage, 6) as coverage_validation, round(b.coverage, 6) as coverage_test,
        round(b.coverage - a.coverage, 6) as coverage_change
      from quality a join quality b using (rule) where a.role = 'rule_audit' and b.role = 'test'"""),
)
def quality_change(spark, sf_dir):
    """Rule quality on audit rows against test rows."""
    audit = binding.audit(spark, sf_dir)
    a = quality.rule_quality(audit.part("rule_audit"), TRUTHS, "label", activation=ACTIVATION)
    b = quality.rule_quality(audit.part("test"), TRUTHS, "label", activation=ACTIVATION)
    return joins.compare_partitions(a, b, ["rule"], ["lift", "coverage"])


# --- explanations ----------------------------------------------------------------------------

RULE_LIST = "list_sort([" + ", ".join(
    f"{{'w': -rule__{n}, 'i': {i}, 'r': '{n}', 'd': '{RULES[i]['description'].replace(chr(39), chr(39) * 2)}'}}"
    for i, n in enumerate(NAMES)) + "])"
EXPLAIN = f"""
  act as materialized (select *, list_filter({RULE_LIST}, lambda e: e.w <= -{ACTIVATION}::double) as on_rules from truth),
  expl as materialized (select *, len(on_rules) as n_on, on_rules[1:3] as shown, risk >= {ALERT_THRESHOLD}::double as pa from act)"""


@query(
    "explanations_topk",
    sql("truth", f""", {EXPLAIN}
      select txn_id, pa as predicted_alert, n_on > 0 as explained, n_on::int as active_rule_count,
        len(shown)::int as displayed_rule_count, {len(NAMES)}::int as available_rule_count,
        coalesce(array_to_string(list_transform(shown, lambda e: e.r), ','), '') as rule_names,
        round(coalesce(-shown[1].w, 0), 6) as max_rule_strength,
        case when n_on > 0 then array_to_string(list_transform(shown, lambda e: e.d), ' ')
          else 'No configured rule reached the activation threshold.' end as explanation from expl"""),
)
def explanations_topk(spark, sf_dir):
    audit = binding.audit(spark, sf_dir)
    out = explain.with_explanations(
        audit.rows, audit.rules, activation=ACTIVATION, probability="risk", threshold=ALERT_THRESHOLD
    )
    return out.select(
        "txn_id", "predicted_alert", "explained", "active_rule_count", "displayed_rule_count", "available_rule_count",
        F.concat_ws(",", "rule_names").alias("rule_names"), "max_rule_strength", "explanation",
    )


@query(
    "strongest_rule",
    sql("truth", f"select txn_id, {RULE_LIST}[1].r as top_rule_name, round({MAX_OR}, 6) as top_rule_strength from truth"),
)
def strongest_rule(spark, sf_dir):
    audit = binding.audit(spark, sf_dir)
    best = explain.strongest_rule(audit.rules)
    return audit.rows.select("txn_id", best["rule"].alias("top_rule_name"), best["truth"].alias("top_rule_strength"))


EXPL_QUALITY = """
  q as (select role, count(*) as n, sum(pa::int) as a, sum((not pa)::int) as na, sum((pa and label = 1)::int) as af,
    sum((n_on > 0)::int) as e, sum((n_on = 0)::int) as z, sum((n_on > 0 and pa)::int) as ea,
    sum((n_on > 0 and pa and label = 1)::int) as eaf, sum((n_on = 0 and pa)::int) as ua,
    sum((n_on > 0 and not pa)::int) as ena, avg(n_on) as mean_on, avg(len(shown)) as mean_shown,
    avg(n_on / {rules}) as frac, avg(((n_on > 0) = pa)::int) as agree from expl group by 1)
  select role, n as test_rows, a::bigint as predicted_alert_count, na::bigint as non_alert_count,
    af::bigint as predicted_alert_fraud_count, e::bigint as explained_count, z::bigint as zero_rule_count,
    ea::bigint as explained_alert_count, eaf::bigint as explained_alert_fraud_count,
    ua::bigint as unsupported_alert_count, ena::bigint as rule_evidence_without_alert_count,
    round(mean_on, 6) as mean_active_rule_count, round(mean_shown, 6) as mean_displayed_rule_count,
    round(frac, 6) as mean_active_rule_fraction, round(e / n, 6) as explanation_coverage_all,
    round(z / n, 6) as zero_rule_fraction, round(ea / nullif(a, 0), 6) as explanation_coverage_alerts,
    round(ua / nullif(a, 0), 6) as unsupported_alert_rate, round(ena / nullif(na, 0), 6) as rule_evidence_without_alert_rate,
    round(agree, 6) as prediction_rule_consistency, round(1 - agree, 6) as contradiction_rate,
    round(eaf / nullif(ea, 0), 6) as explained_alert_precision, round(af / nullif(a, 0), 6) as all_alert_precision,
    round(1 - frac, 6) as rule_sparsity,
    round((ea / nullif(a, 0) + 1 - ena / nullif(na, 0)) / 2, 6) as balanced_prediction_rule_consistency,
    round(eaf / nullif(ea, 0) - af / nullif(a, 0), 6) as explained_alert_precision_gain from q""".replace("{rules}", str(len(NAMES)))


@query("explanation_quality", sql("truth", f", {EXPLAIN}, {EXPL_QUALITY}"))
def explanation_quality(spark, sf_dir):
    audit = binding.audit(spark, sf_dir)
    rows = explain.with_explanations(audit.rows, audit.rules, activation=ACTIVATION)
    return quality.explanation_quality(rows, "label", F.col("alert"), by=["role"])


@query(
    "support_summary",
    sql("truth", f""", c as (select role, alert, {count_active()} as k from truth)
      select role, count(*) as rows, sum(alert::int)::bigint as alert_rows, sum((alert and k > 0)::int)::bigint as supported_alerts,
        sum((alert and k = 0)::int)::bigint as unsupported_alerts, sum((alert <> (k > 0))::int)::bigint as contradictions,
        round(avg(case when alert then k end), 6) as mean_active_rules,
        round(avg(case when alert then least(k, 3) end), 6) as mean_displayed_rules,
        round(sum((alert and k > 0)::int) / nullif(sum(alert::int), 0), 6) as alert_support_rate,
        round(avg((alert <> (k > 0))::int), 6) as contradiction_rate,
        round(1 - avg(case when alert then k end) / {len(NAMES)}, 6) as rule_sparsity from c group by 1"""),
)
def support_summary(spark, sf_dir):
    audit = binding.audit(spark, sf_dir)
    rows = audit.rows.withColumn(
        "active_rule_count", sum(((F.col(c) >= ACTIVATION).cast("int") for c in TRUTHS.values()), F.lit(0))
    )
    return quality.support_summary(rows, F.col("alert"), available=len(RULE_NAMES), by=["role"])


CASES = f"""
  cases as (select *, (case when alert and label = 1 then 'true_positive' when alert then 'false_positive'
      when label = 1 then 'false_negative' else 'true_negative' end) || '_' ||
      (case when {any_active()} then 'explained' else 'unexplained' end) as case_group from truth where role = 'test'),
  top as (select *, row_number() over (partition by case_group order by risk desc, txn_id) as case_rank from cases
    qualify case_rank <= 2)"""


def _top_cases(spark, sf_dir):
    audit = binding.audit(spark, sf_dir)
    on = sum(((F.col(c) >= ACTIVATION).cast("int") for c in TRUTHS.values()), F.lit(0)) > 0
    rows = audit.part("test").withColumn("case_group", explain.case_group(F.col("alert"), F.col("label"), on))
    return audit, explain.top_cases(rows, "case_group", "risk", "txn_id")


@query("case_groups_top2", sql("truth", f", {CASES} select txn_id, case_group, case_rank::int as case_rank, round(risk, 6) as risk from top"))
def case_groups_top2(spark, sf_dir):
    """Two highest-scoring rows of every outcome group."""
    return _top_cases(spark, sf_dir)[1].select("txn_id", "case_group", "case_rank", "risk")


@query(
    "case_evidence",
    sql("truth", f""", {CASES}, l as ({unpivot_rules('txn_id', source='top')}),
      m as (select *, max(v) over (partition by txn_id) as best from l)
      select txn_id, rule, v >= {ACTIVATION} as activated, round(v, 6) as truth_strength,
        (case when rule in ('cross_bank_gap', 'large_cross_bank') then 2 else 1 end)::int as conditions
      from m where v >= {ACTIVATION} or (best < {ACTIVATION} and v = best)"""),
)
def case_evidence(spark, sf_dir):
    """Nested evidence of the top cases, one row per rule."""
    audit, cases = _top_cases(spark, sf_dir)
    rows = cases.select("txn_id", F.explode(explain.case_evidence(audit.rules, ACTIVATION)).alias("e"))
    return rows.select("txn_id", "e.rule", "e.activated", "e.truth_strength", F.size("e.conditions").alias("conditions"))


LEVELS = (0.5, 0.6, 0.7, 0.8)


def _ablation_sql() -> str:
    def part(variant: str, names: list[str], level: float) -> str:
        on = any_active(names, level) if names else "false"
        return f"select {level}::double as activation, '{variant}' as variant, alert, label as y, {on} as o from truth where role = 'test'"

    parts = [part("full", NAMES, level) for level in LEVELS]
    parts.append(part("none", [], 0.6))
    parts += [part(f"only:{n}", [n], 0.6) for n in NAMES]
    parts += [part(f"without:{n}", [m for m in NAMES if m != n], 0.6) for n in NAMES]
    return f""", v as ({' union all '.join(parts)}),
      s as (select activation, variant, count(*) as rows, sum(alert::int) as a, sum((alert and y = 1)::int) as ap,
        sum(o::int) as e, sum((o and alert)::int) as ea, sum((o and alert and y = 1)::int) as eap from v group by 1, 2)
      select activation, variant, rows, a::bigint as alerts, ap::bigint as alert_positives, e::bigint as explained,
        ea::bigint as explained_alerts, eap::bigint as explained_alert_positives,
        round(ea / nullif(a, 0), 6) as explanation_coverage_alerts, round(eap / nullif(ea, 0), 6) as explained_alert_precision,
        round(eap / nullif(ea, 0) - ap / nullif(a, 0), 6) as explained_alert_precision_gain from s"""


@query("rule_ablation", sql("truth", _ablation_sql()))
def rule_ablation(spark, sf_dir):
    """Every rule subset and activation level from one pattern histogram."""
    test = binding.audit(spark, sf_dir).part("test")
    histogram = quality.pattern_histogram(test, list(TRUTHS.values()), LEVELS, "label", F.col("alert"))
    return quality.rule_ablation(histogram, RULE_NAMES)


def _jaccard_sql() -> str:
    parts = [
        f"""select '{a}' as rule_a, '{b}' as rule_b, sum((rule__{a} >= 0.6 and rule__{b} >= 0.6)::int)::bigint as "both",
          sum((rule__{a} >= 0.6 or rule__{b} >= 0.6)::int)::bigint as either from x"""
        for i, a in enumerate(NAMES) for b in NAMES[i + 1:]
    ]
    return f""", x as (select * from truth where role = 'rule_audit' and alert), p as ({' union all '.join(parts)})
      select rule_a, rule_b, "both", either, round(case when either > 0 then "both" / either else 1 end, 6) as jaccard from p"""


@query("activation_jaccard", sql("truth", _jaccard_sql()))
def activation_jaccard(spark, sf_dir):
    alerts = binding.audit(spark, sf_dir).part("rule_audit").filter("alert")
    histogram = quality.pattern_histogram(alerts, list(TRUTHS.values()), [ACTIVATION], "label", F.lit(True))
    return quality.rule_overlap(histogram, RULE_NAMES)
