"""Rule audit, redundancy, weights, attributions and evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.hashing import MERSENNE_31, POISSON_1, replicate_coefficients
from riskloom.operators import attribution, audit, contrastive, counterfactual, evidence, quality, rules, survival, trees
from riskloom.plans import binding
from riskloom.plans.binding import ACTIVATION, RULE_NAMES, RULES, SCORECARD, TRUTHS
from riskloom.plans.oracle import MARGIN, NAMES, sigmoid, sql, unpivot_rules
from riskloom.plans.registry import query
from riskloom.session import stage, with_constants

TOP_K = 5
METHODS = ("unweighted", "audit_weighted", "fp_penalized", "attribution_gated")
MAX_JACCARD, MAX_RULES = 0.85, 12
RULE_FEATURES = {r["name"]: sorted({c["feature"] for c in r["conditions"]}) for r in RULES}


def attributions():
    return attribution.linear_attributions(SCORECARD)


def shares():
    return {r: attribution.rule_share(attributions(), f) for r, f in RULE_FEATURES.items()}


def hits():
    return {r: attribution.rule_hit(attributions(), f, TOP_K) for r, f in RULE_FEATURES.items()}


@dataclass(frozen=True)
class Audited:
    source: binding.Audit
    table: DataFrame
    overlap: DataFrame
    completed: DataFrame


def audited(spark, sf_dir, *, label: str = "label", rows: DataFrame | None = None, auc: bool = False) -> Audited:
    """Audit on rule_audit alerts against training alerts, with redundancy decisions."""
    source = binding.audit(spark, sf_dir)
    both = source.part("train", "rule_audit") if rows is None else rows
    statistics = audit.alert_statistics(both, TRUTHS, label, "alert", "role", activation=ACTIVATION, auc=auc)
    alerts = both.filter("role = 'rule_audit' and alert")
    rates = audit.attribution_rates(alerts, TRUTHS, hits(), shares(), activation=ACTIVATION)
    table = stage(
        audit.audit_rules(statistics, part="role", train="train", audit="rule_audit", attribution=rates), "rule-audit"
    )
    histogram = quality.pattern_histogram(alerts, list(TRUTHS.values()), [ACTIVATION], label, F.lit(True))
    overlap = stage(quality.rule_overlap(histogram, RULE_NAMES), "rule-overlap")
    completed = audit.remove_redundant(table, overlap, max_jaccard=MAX_JACCARD, max_rules=MAX_RULES)
    return Audited(source, table, overlap, completed)


_weights: dict[tuple, audit.Weights] = {}
_models: dict[tuple, contrastive.ContrastiveModel] = {}


def frozen_weights(spark, sf_dir) -> tuple[binding.Audit, audit.Weights]:
    """The audit table and the weights frozen on it, fitted once per application."""
    key = binding.version(spark, sf_dir)
    if key not in _weights:
        _weights[key] = audit.collect_weights(audit.rule_weights(audited(spark, sf_dir).completed))
    return binding.audit(spark, sf_dir), _weights[key]


def frozen_contrast(spark, sf_dir) -> contrastive.ContrastiveModel:
    """The logistic evidence of the selected rules, fitted on rule_audit alerts once per application."""
    key = binding.version(spark, sf_dir)
    if key not in _models:
        source, weights = frozen_weights(spark, sf_dir)
        _models[key] = contrastive.fit_contrastive(
            source.part("rule_audit"), TRUTHS, weights.rules, label="label", risk="risk", alert="alert", activation=ACTIVATION
        )
    return _models[key]


def with_evidence(rows: DataFrame, weights: audit.Weights, model: contrastive.ContrastiveModel) -> DataFrame:
    """Evidence of every method and their ensemble on scored rows."""
    columns = evidence.evidence_columns(TRUTHS, weights, METHODS, shares=shares(), activation=ACTIVATION)
    out = rows.withColumns(columns | {"contrastive_meta": model.evidence(TRUTHS, "risk")})
    return out.withColumn("guarded_ensemble", evidence.guarded_ensemble(["fp_penalized", "attribution_gated"]))


# --- SQL -------------------------------------------------------------------------------------

STATS = f"""
  long as materialized ({unpivot_rules('role, alert, label as y', "role in ('train', 'rule_audit')")}),
  scoped as materialized (select role, 'population' as scope, rule, v, y from long
    union all select role, 'alert', rule, v, y from long where alert),
  ranked as (select *, rank() over (partition by role, scope, rule order by v)
    + (count(*) over (partition by role, scope, rule, v) - 1) / 2.0 as r from scoped),
  sums as (select role, scope, rule, count(*) as n, sum(y) as p, sum((v >= 0.6)::int) as act, sum((v >= 0.6)::int * y) as actp,
    avg(v) as mean_truth, sum(r * y) as ry from ranked group by 1, 2, 3),
  stats as materialized (select role, scope, rule, n, p, act, act / n as coverage, actp / nullif(act, 0) as prec,
    actp / nullif(act, 0) - p / n as gain, case when p > 0 then actp / nullif(act, 0) / (p / n) end as lift,
    actp / nullif(p, 0) as tpa, (act - actp) / nullif(n - p, 0) as fpa,
    actp / nullif(p, 0) - (act - actp) / nullif(n - p, 0) as gap,
    case when p > 0 and p < n then (ry - p * (p + 1) / 2.0) / p / (n - p) end as auc, mean_truth from sums)"""

def effects_sql(coefficients: dict[str, float]) -> dict[str, str]:
    return {f: f"({c!r}::double * {f})" for f, c in coefficients.items()}


def total_effect(effects: dict[str, str]) -> str:
    return "greatest(" + " + ".join(f"abs({e})" for e in effects.values()) + ", 1e-12)"


EFFECTS = effects_sql(SCORECARD)


def top_effects(effects: dict[str, str]) -> str:
    return "list_sort([" + ", ".join(
        f"{{'s': -abs({e}), 'i': {i}, 'f': '{f}', 'v': {e}}}" for i, (f, e) in enumerate(effects.items())) + f"])[1:{TOP_K}]"


def share_sql(rule: str, effects: dict[str, str] = EFFECTS) -> str:
    known = [f for f in RULE_FEATURES[rule] if f in effects]
    return f"(({' + '.join(f'abs({effects[f]})' for f in known)}) / {total_effect(effects)})" if known else "0.0::double"


def hit_sql(rule: str, effects: dict[str, str] = EFFECTS) -> str:
    known = [f for f in RULE_FEATURES[rule] if f in effects]
    names = ", ".join(f"'{f}'" for f in known)
    return f"list_has_any(list_transform(top_effects, lambda e: e.f), [{names}])::int::double" if known else "0.0::double"


def attributed_sql(effects: dict[str, str] = EFFECTS) -> str:
    return f"""
  attr as materialized (select *, {top_effects(effects)} as top_effects from truth),
  rates as materialized ({' union all '.join(
    f"select '{n}' as rule, avg(case when rule__{n} >= 0.6 then {hit_sql(n, effects)} end) as hit, "
    f"avg(case when rule__{n} >= 0.6 then {share_sql(n, effects)} end) as share from attr where role = 'rule_audit' and alert"
    for n in NAMES)})"""


ATTRIBUTED = attributed_sql()

CHECKS = (
    ("a.act >= 10", "audit_alert_active_count"),
    ("a.coverage >= 0.001", "audit_alert_min_coverage"),
    ("a.coverage <= 0.80", "audit_alert_max_coverage"),
    ("a.gain >= 0", "audit_alert_precision_gain"),
    ("a.lift >= 1", "audit_alert_lift"),
    ("a.gap >= 0", "audit_alert_tp_fp_gap"),
    ("a.fpa <= 0.90", "audit_alert_fp_activation"),
    ("abs(a.coverage - t.coverage) <= 0.20", "alert_coverage_shift"),
    ("abs(ln((a.lift + 1e-8) / (t.lift + 1e-8))) <= 1.5", "alert_lift_log_shift"),
)
FAILURES = "array_to_string(list_filter([" + ", ".join(
    f"case when not coalesce({c}, false) then '{token}' end" for c, token in CHECKS) + "], lambda x: x is not null), ';')"
SCORE = """0.30 * greatest(coalesce(a.gain, 0), 0) + 0.25 * greatest(coalesce(a.gap, 0), 0)
    + 0.15 * coalesce(ln(1 + greatest(a.lift - 1, 0)), 0) + 0.15 * coalesce(hit, 0) + 0.15 * coalesce(share, 0)
    - 0.15 * coalesce(abs(a.coverage - t.coverage), 1)
    - 0.10 * least(coalesce(abs(ln((a.lift + 1e-8) / (t.lift + 1e-8))), 5), 5) - 0.10 * coalesce(a.fpa, 1)"""
AUDITED = f"""
  audited as materialized (select rule, a.act, a.coverage, a.prec, a.gain, a.lift, a.tpa, a.fpa, a.gap, t.coverage as tcov,
    t.lift as tlift, abs(a.coverage - t.coverage) as cshift, abs(ln((a.lift + 1e-8) / (t.lift + 1e-8))) as lshift, hit, share,
    {SCORE} as score, {FAILURES} as failures
    from stats a join stats t using (rule) join rates using (rule)
    where a.role = 'rule_audit' and a.scope = 'alert' and t.role = 'train' and t.scope = 'alert')"""
OVERLAP = f"""
  alerts as materialized (select * from truth where role = 'rule_audit' and alert),
  overlap as materialized ({' union all '.join(
    f"select '{a}' as ra, '{b}' as rb, coalesce(sum((rule__{a} >= 0.6 and rule__{b} >= 0.6)::int) / "
    f"nullif(sum((rule__{a} >= 0.6 or rule__{b} >= 0.6)::int), 0), 1) as j from alerts"
    for a in NAMES for b in NAMES if a != b)})"""


def choice_sql(most: int, pool: str = "true", n: str = "", audited: str = "audited", overlap: str = "overlap") -> str:
    """CTEs of the greedy choice, which visits one rule of the pool per step, by score."""
    return f"""
  queue{n} as materialized (select rule, row_number() over (order by score desc, rule) as k from {audited} where failures = '' and {pool}),
  walk{n} as (
    with recursive w(k, kept, decided) as (
      select 0, []::varchar[], []::struct(rule varchar, status varchar, top double)[] union all
      select q.k::int,
        case when len(kept) < {most} and not exists (select 1 from {overlap} where ra = q.rule and list_contains(kept, rb) and j > {MAX_JACCARD})
          then list_append(kept, q.rule) else kept end,
        list_append(decided, {{'rule': q.rule,
          'status': case when exists (select 1 from {overlap} where ra = q.rule and list_contains(kept, rb) and j > {MAX_JACCARD})
            then 'redundant' when len(kept) < {most} then 'selected' else 'rule_budget_exceeded' end,
          'top': coalesce((select max(j) from {overlap} where ra = q.rule and list_contains(kept, rb)), 0)}})
      from w join queue{n} q on q.k = w.k + 1)
    select kept, decided from w order by k desc limit 1),
  decisions{n} as materialized (select d.rule, d.status, d.top from (select unnest(decided) as d from walk{n}))"""


def weights_sql(n: str = "") -> str:
    return f"""
  comp{n} as (select rule, greatest(score - least(min(score) over (), 0), 0) + 1e-8 as c, greatest(tpa - fpa, 0) + 1e-8 as g
    from audited join decisions{n} using (rule) where status = 'selected'),
  aw{n} as (select rule, c, c / sum(c) over () as w, g from comp{n}),
  weights{n} as materialized (select rule, c, w, w * g / sum(w * g) over () as pw from aw{n})"""


CHOICE, WEIGHTS = choice_sql(MAX_RULES), weights_sql()
POOLS = {
    "amounts": ["high_amount", "deep_discount", "large_cross_bank"],
    "context": ["cross_bank_gap", "busy_sender", "low_balance", "risky_format", "unusual_gap"],
}


def _in_pool(pool: str) -> str:
    return f"rule in ({', '.join(repr(r) for r in POOLS[pool])})"


POOL_CTES = tuple(part for pool in POOLS for part in (choice_sql(MAX_RULES, _in_pool(pool), f"_{pool}"), weights_sql(f"_{pool}")))
RULE_AUDIT_CTES = (STATS, ATTRIBUTED, AUDITED)
SELECTION_CTES = (*RULE_AUDIT_CTES, OVERLAP, CHOICE)
WEIGHT_CTES = (*SELECTION_CTES, WEIGHTS)


CONTRAST_X = (*[f"u_{n} * rule__{n}" for n in NAMES], "(risk - m) / s", "1.0::double")


def newton_sql(features: tuple[str, ...], rows: str, out: str) -> str:
    """CTEs of a balanced logistic fit on alerts: Newton steps, each solved by elimination over lists."""
    d = len(features)
    eliminated = f"""list_reduce(list_prepend(a, list_transform(range(1, {d} + 1), lambda q: a)), lambda acc, other, k:
      list_transform(acc, lambda r, i: case when i = k - 1 then list_transform(r, lambda v: v / r[k - 1])
        else list_transform(r, lambda v, j: v - r[k - 1] / acc[k - 1][k - 1] * acc[k - 1][j]) end))"""
    margin = " + ".join(f"b[{i + 1}] * x{i}" for i in range(d))
    matrix = ", ".join(
        "[" + ", ".join(f"sum(w * p * (1 - p) * x{i} * x{j}) + {int(i == j and i < d - 1)}" for j in range(d))
        + f", sum(w * (p - y) * x{i}) + {int(i < d - 1)} * any_value(b)[{i + 1}]]"
        for i in range(d)
    )
    return f"""
  cx as materialized (select label as y, case when label = 1 then n / (2.0 * pos) else n / (2.0 * (n - pos)) end as w,
    {', '.join(f'({x})::double as x{i}' for i, x in enumerate(features))} from {rows}, cz where role = 'rule_audit' and alert),
  walked as (
    with recursive fit(step, b) as (
      select 0, list_transform(range({d}), lambda q: 0.0::double) union all
      select step + 1, list_transform(b, lambda v, i: v - solved[i][{d + 1}]) from (
        select step, b, {eliminated} as solved from (
          select step, any_value(b) as b, [{matrix}] as a
          from (select f.step, f.b, c.*, 1 / (1 + exp(-({margin}))) as p from fit f, cx c where f.step < 12) group by step)))
    select b from fit order by step desc limit 1),
  {out} as materialized (select case when n >= 20 and least(pos, n - pos) >= 5 and s > 1.5e-8 then b end as fitted from walked, cz)"""



def risk_moments(source: str = "truth") -> str:
    return f"cz as materialized (select avg(risk) as m, stddev_pop(risk) as s, count(*) as n, sum(label) as pos from {source} where role = 'rule_audit' and alert)"


CZ = risk_moments()


def evidence_sql(effects: dict[str, str] = EFFECTS, source: str = "truth") -> str:
    """CTEs of every method's evidence on the rows of ``source`` from the frozen weights."""
    return f"""
  wts as materialized (select {', '.join(f"coalesce(max(case when rule = '{n}' then w end), 0) as w_{n}, "
    f"coalesce(max(case when rule = '{n}' then pw end), 0) as p_{n}, "
    f"coalesce(max(case when rule = '{n}' then 1.0 end), 0) as u_{n}" for n in NAMES)}, count(*) as k from weights),
  sup as materialized (select {source}.*, wts.*, ({' or '.join(f'(rule__{n} >= 0.6 and u_{n} > 0)' for n in NAMES)}) as on_any from {source}, wts),
  evid0 as materialized (select *,
    case when on_any then greatest(0, least(1, ({' + '.join(f'u_{n} * rule__{n}' for n in NAMES)}) / k)) else 0 end as unweighted,
    case when on_any then greatest(0, least(1, {' + '.join(f'w_{n} * rule__{n}' for n in NAMES)})) else 0 end as audit_weighted,
    case when on_any then greatest(0, least(1, {' + '.join(f'p_{n} * rule__{n}' for n in NAMES)})) else 0 end as fp_penalized,
    case when on_any then greatest(0, least(1, {' + '.join(f'p_{n} * rule__{n} * {share_sql(n, effects)}' for n in NAMES)})) else 0 end
      as attribution_gated from sup),
  {risk_moments(source)},{newton_sql(CONTRAST_X, 'evid0', 'contrast')},
  evid as materialized (select evid0.* exclude ({', '.join(f'u_{n}' for n in NAMES)}), (fp_penalized + attribution_gated) / 2 as guarded_ensemble,
    case when on_any and fitted is not null then 1 / (1 + exp(-({' + '.join(f'fitted[{i}] * ({x})' for i, x in enumerate(CONTRAST_X, 1))}))) else 0 end as contrastive_meta
    from evid0, cz, contrast)"""


EVIDENCE_CTES = (*WEIGHT_CTES, evidence_sql())


# --- queries ---------------------------------------------------------------------------------


@query(
    "alert_statistics",
    sql("truth", """select role, scope, rule, n as rows, p::bigint as positives, act::bigint as active_count,
      round(coverage, 6) as coverage, round(prec, 6) as "precision", round(gain, 6) as precision_gain, round(lift, 6) as lift,
      round(tpa, 6) as tp_activation, round(fpa, 6) as fp_activation, round(gap, 6) as tp_fp_gap, round(auc, 6) as rule_auc,
      round(mean_truth, 6) as mean_truth from stats""", STATS),
)
def alert_statistics(spark, sf_dir):
    """Rule statistics of train and audit rows, over all rows and over alerts."""
    rows = binding.audit(spark, sf_dir).part("train", "rule_audit")
    return audit.alert_statistics(rows, TRUTHS, "label", "alert", "role", activation=ACTIVATION)


@query(
    "rule_audit",
    sql("truth", """select rule, act::bigint as audit_alert_active_count, round(coverage, 6) as audit_alert_coverage,
      round(lift, 6) as audit_alert_lift, round(tlift, 6) as train_alert_lift, round(gap, 6) as audit_alert_tp_fp_gap,
      round(cshift, 6) as alert_coverage_shift, round(lshift, 6) as alert_lift_log_shift,
      round(hit, 6) as audit_alert_attribution_hit_rate, round(share, 6) as audit_alert_attribution_share,
      round(score, 6) as audit_alert_score, failures = '' as audit_pass, failures as audit_failures from audited""", *RULE_AUDIT_CTES),
)
def rule_audit(spark, sf_dir):
    return audited(spark, sf_dir).table.select(
        "rule", "audit_alert_active_count", "audit_alert_coverage", "audit_alert_lift", "train_alert_lift",
        "audit_alert_tp_fp_gap", "alert_coverage_shift", "alert_lift_log_shift", "audit_alert_attribution_hit_rate",
        "audit_alert_attribution_share", "audit_alert_score", "audit_pass", "audit_failures",
    )


@query(
    "rule_selection",
    sql("truth", """select rule, coalesce(status, 'audit_failed') as selection_status, round(top, 6) as max_jaccard_with_selected,
      coalesce(status = 'selected', false) as selected from audited left join decisions using (rule)""", *SELECTION_CTES),
)
def rule_selection(spark, sf_dir):
    """Redundancy decisions: one kept rule per group of overlapping rules."""
    return audited(spark, sf_dir).completed.select("rule", "selection_status", "max_jaccard_with_selected", "selected")


@query(
    "rule_weights",
    sql("truth", """select rule, round(w, 6) as audit_weight, round(pw, 6) as fp_penalized_weight,
      round(c, 6) as audit_alert_score_component from weights""", *WEIGHT_CTES),
)
def rule_weights(spark, sf_dir):
    return audit.rule_weights(audited(spark, sf_dir).completed)


@query(
    "evidence_scores",
    sql("truth", "select txn_id, " + ", ".join(f"round({m}, 6) as {m}" for m in (*METHODS, "contrastive_meta", "guarded_ensemble"))
        + " from evid where role in ('policy_select', 'test')", *EVIDENCE_CTES),
)
def evidence_scores(spark, sf_dir):
    """Frozen evidence of policy and test rows."""
    source, weights = frozen_weights(spark, sf_dir)
    rows = with_evidence(source.part("policy_select", "test"), weights, frozen_contrast(spark, sf_dir))
    return rows.select("txn_id", *METHODS, "contrastive_meta", "guarded_ensemble")


@query(
    "linear_attributions",
    sql("truth", "select txn_id, " + ", ".join(f"round({e}, 6) as contribution_{f}" for f, e in EFFECTS.items())
        + f", round({MARGIN}, 6) as raw_margin from truth"),
)
def linear_attributions(spark, sf_dir):
    """Contribution of every scorecard feature; with the base they add up to the margin."""
    parts = attributions()
    margin = sum(parts.values(), F.lit(binding.SCORE_BASE))
    return binding.audit(spark, sf_dir).rows.select(
        "txn_id", *[c.alias(f"contribution_{f}") for f, c in parts.items()], margin.alias("raw_margin")
    )


@query(
    "rule_attribution",
    sql("truth", "select txn_id, " + ", ".join(
        f"round({hit_sql(n)}, 6) as hit_{n}, round({share_sql(n)}, 6) as share_{n}" for n in NAMES)
        + """, round(list_sum(list_transform(top_effects, lambda e: greatest(e.v, 0))), 6) as positive_top_effects
        from attr where role = 'rule_audit'""", ATTRIBUTED),
)
def rule_attribution(spark, sf_dir):
    rows = binding.audit(spark, sf_dir).part("rule_audit")
    h, s = hits(), shares()
    return rows.select(
        "txn_id", *[h[n].alias(f"hit_{n}") for n in RULE_NAMES], *[s[n].alias(f"share_{n}") for n in RULE_NAMES],
        attribution.positive_top_effects(attributions(), TOP_K).alias("positive_top_effects"),
    )


@query(
    "attribution_importance",
    sql("truth", " union all ".join(
        f"select '{f}' as feature, round(avg(abs({e})), 6) as mean_absolute_attribution from truth where role = 'rule_audit'"
        for f, e in EFFECTS.items())),
)
def attribution_importance(spark, sf_dir):
    return attribution.mean_absolute_attribution(binding.audit(spark, sf_dir).part("rule_audit"), attributions())


@query(
    "independent_pools",
    sql("truth", " union all ".join(
        f"select '{pool}' as pool, rule, coalesce(status, 'audit_failed') as selection_status, round(w, 6) as audit_weight, "
        f"round(pw, 6) as fp_penalized_weight from audited left join decisions_{pool} using (rule) left join weights_{pool} using (rule) where {_in_pool(pool)}"
        for pool in POOLS), *RULE_AUDIT_CTES, OVERLAP, *POOL_CTES),
)
def independent_pools(spark, sf_dir):
    """Two rule pools selected and weighted on their own from one full audit."""
    found = audited(spark, sf_dir)
    out = None
    for pool, names in POOLS.items():
        chosen = audit.remove_redundant(found.table, found.overlap, rules=names, max_jaccard=MAX_JACCARD, max_rules=MAX_RULES)
        weights = audit.rule_weights(chosen)
        part = chosen.select("rule", "selection_status").join(weights, "rule", "left").select(
            F.lit(pool).alias("pool"), "rule", "selection_status", "audit_weight", "fp_penalized_weight"
        )
        out = part if out is None else out.unionByName(part)
    return out


# Seeds of the audit resamples.
AUDIT_SEEDS = (42, 123, 2026, 1705, 2027)


def _survival_sql() -> tuple[str, list[str]]:
    coefficients = ", ".join(
        f"{{'seed': {s}, 'a': {a}, 'b': {b}}}" for s, (a, b) in ((s, replicate_coefficients(s, 0)) for s in AUDIT_SEEDS)
    )
    weight = "case " + " ".join(f"when u < {p!r}::double then {k}" for k, p in enumerate(POISSON_1)) + f" else {len(POISSON_1)} end"
    rules = " union all ".join(
        f"select seed, '{n}' as rule, w, label as y, rule__{n} >= 0.6 as hot, {hit_sql(n)} as hit, {share_sql(n)} as share from rw" for n in NAMES
    )
    overlap = " union all ".join(
        f"select seed, '{a}' as ra, '{b}' as rb, coalesce(sum(case when rule__{a} >= 0.6 and rule__{b} >= 0.6 then w end), 0) "
        f"/ nullif(sum(case when rule__{a} >= 0.6 or rule__{b} >= 0.6 then w end), 0) as j from rw group by 1"
        for a in NAMES for b in NAMES if a != b
    )
    ctes = [
        f"""
  rdraw as (select *, unnest([{coefficients}]) as c, (('0x' || substr(md5(txn_id), 1, 12))::bigint % {MERSENNE_31}) as n31 from attr where role = 'rule_audit' and alert),
  rw as materialized (select *, {weight} as w from (select *, c.seed as seed, ((n31 * c.a + c.b) % {MERSENNE_31}) / {MERSENNE_31}.0::double as u from rdraw)),
  rsums as (select seed, rule, sum(w) as n, sum(w * y) as p, coalesce(sum(case when hot then w end), 0) as act, coalesce(sum(case when hot then w * y end), 0) as actp,
    sum(case when hot then w * hit end) / nullif(sum(case when hot then w end), 0) as hit, sum(case when hot then w * share end) / nullif(sum(case when hot then w end), 0) as share
    from ({rules}) group by 1, 2),
  rstats as (select *, act / n as coverage, actp / nullif(act, 0) - p / n as gain, actp / nullif(act, 0) / (p / n) as lift,
    (act - actp) / nullif(n - p, 0) as fpa, actp / nullif(p, 0) - (act - actp) / nullif(n - p, 0) as gap from rsums),
  raudit as materialized (select seed, rule, a.coverage, a.lift, {SCORE} as score, {FAILURES} as failures
    from rstats a join stats t using (rule) where t.role = 'train' and t.scope = 'alert'),
  roverlap as materialized (select seed, ra, rb, coalesce(j, 1) as j from ({overlap}))"""
    ]
    parts = []
    for s in AUDIT_SEEDS:
        n = f"_s{s}"
        ctes.append(f"aud{n} as materialized (select * from raudit where seed = {s}), over{n} as materialized (select * from roverlap where seed = {s})")
        ctes.append(choice_sql(MAX_RULES, n=n, audited=f"aud{n}", overlap=f"over{n}"))
        parts.append(f"select {s} as seed, rule, score, coverage, lift from decisions{n} join aud{n} using (rule) where status = 'selected'")
    chosen = " union all ".join(parts)
    body = f"""select seed::int as seed, count(rule)::int as selected_rule_count, any_value(k)::int as reference_selected_rule_count,
      count(rule) filter (list_contains(ref, rule))::int as surviving_reference_rule_count, round(count(rule) filter (list_contains(ref, rule)) / any_value(k), 6) as reference_rule_survival_rate,
      round(count(rule) filter (list_contains(ref, rule)) / (any_value(k) + count(rule) - count(rule) filter (list_contains(ref, rule))), 6) as selected_rule_jaccard,
      list_sort(list(rule)) as selected_rules, round(avg(score), 6) as mean_selected_audit_score, round(avg(coverage), 6) as mean_selected_audit_alert_coverage,
      round(avg(lift), 6) as mean_selected_audit_alert_lift
      from ({chosen}), (select list(rule) as ref, count(*) as k from decisions where status = 'selected') group by 1"""
    return body, ctes


@query("audit_stability", sql("truth", _survival_sql()[0], *SELECTION_CTES, *_survival_sql()[1]))
def audit_stability(spark, sf_dir):
    """Which selected rules survive when the audit alerts are resampled."""
    found = audited(spark, sf_dir)
    reference = [r["rule"] for r in found.completed.filter("selected").select("rule").collect()]
    return survival.rule_survival(
        found.source.part("rule_audit").filter("alert"), found.table, reference, TRUTHS, hits(), shares(),
        label="label", row_id="txn_id", seeds=AUDIT_SEEDS, activation=ACTIVATION, max_jaccard=MAX_JACCARD, max_rules=MAX_RULES,
    )


# --- candidates and learned evidence ---------------------------------------------------------

NUMERIC = ("amount_paid", "cross_bank", "same_currency", "sender_prior_transaction_count", "sender_balance_before")


def _tails_sql() -> str:
    parts = []
    for f in NUMERIC:
        if f not in SCORECARD:
            parts.append(
                f"select '{f}' as feature, false as eligible, 'not_used_by_score' as reason, null as train_median, null as direction, "
                "null as fitted_threshold, null as tail_rows, null as tail_mean_score_drop, null as tail_affected_fraction"
            )
            continue
        margin = MARGIN.replace(f" * {f}", f" * t_{f}")
        parts.append(f"""(with q as (select quantile_cont({f}, 0.5) as t_{f}, quantile_cont({f}, 0.9) as hi, quantile_cont({f}, 0.1::double) as lo from x),
          d as (select {f} as v, risk - {sigmoid(margin)} as d, t_{f}, hi, lo from x, q),
          s as (select any_value(t_{f})::double as m, any_value(hi)::double as hi, any_value(lo)::double as lo,
            avg(case when v >= hi then d end) as hm, avg(case when v <= lo then d end) as lm,
            sum((v >= hi)::int) as hn, sum((v <= lo)::int) as ln, avg(case when v >= hi then (d >= 0.005)::int end) as ha,
            avg(case when v <= lo then (d >= 0.005)::int end) as la from d)
          select '{f}' as feature, case when hm >= lm then hn >= 25 and hm >= 0.005 and ha >= 0.05
              else ln >= 25 and lm >= 0.005 and la >= 0.05 end as eligible, '' as reason, round(m, 6) as train_median,
            case when hm >= lm then 'high' else 'low' end as direction, round(case when hm >= lm then hi else lo end, 6) as fitted_threshold,
            (case when hm >= lm then hn else ln end)::bigint as tail_rows,
            round(case when hm >= lm then hm else lm end, 6) as tail_mean_score_drop,
            round(case when hm >= lm then ha else la end, 6) as tail_affected_fraction from s)""")
    return f"""select * replace (case when reason <> '' then reason when eligible then 'selected' else 'below_materiality_gate' end as reason)
      from ({' union all '.join(parts)})"""


@query("counterfactual_tails", sql("roled", _tails_sql(), "x as materialized (select * from roled where role = 'train')"))
def counterfactual_tails(spark, sf_dir):
    """Score drop when a raw feature is set to its training median, in both tails."""
    train = binding.audit(spark, sf_dir).part("train")
    return counterfactual.counterfactual_tails(
        train, binding.scorecard, NUMERIC, inputs=list(SCORECARD)
    ).select("feature", "eligible", "reason", "train_median", "direction", "fitted_threshold", "tail_rows",
             "tail_mean_score_drop", "tail_affected_fraction")


@query("counterfactual_rules")
def counterfactual_rules(spark, sf_dir):
    """Tier B rules from the selected tails, evaluated on audit rows."""
    source = binding.audit(spark, sf_dir)
    tails = counterfactual.counterfactual_tails(source.part("train"), binding.scorecard, NUMERIC, inputs=list(SCORECARD))
    base = rules.fit_rules(source.part("train"), counterfactual.counterfactual_definitions(tails), "label")
    rows = rules.with_truth(source.part("rule_audit"), base)
    return quality.rule_quality(rows, {r.name: r.column for r in base.rules}, "label", activation=ACTIVATION)


@query("surrogate_paths")
def surrogate_paths(spark, sf_dir):
    """Leaves of a shallow tree on the frozen score, as conjunction rules."""
    source = binding.audit(spark, sf_dir)
    chosen, stats, fidelity = trees.fit_surrogate(source.part("train"), list(SCORECARD), "risk")
    names = [(r.name, " and ".join(f"{f} {s} {t:.6g}" for f, s, t in r.conditions), r.prediction) for r in chosen]
    table = spark.createDataFrame(names, "leaf string, conditions string, prediction double")
    return with_constants(table.join(stats, "leaf"), fidelity)


@query(
    "contrastive_evidence",
    sql("truth", "select txn_id, round(contrastive_meta, 6) as contrastive_meta, (select fitted is not null from contrast) as available from evid where role = 'policy_select'",
        *EVIDENCE_CTES),
)
def contrastive_evidence(spark, sf_dir):
    """Logistic evidence of true against false alerts, scored on policy rows."""
    model = frozen_contrast(spark, sf_dir)
    rows = binding.audit(spark, sf_dir).part("policy_select")
    return rows.select("txn_id", model.evidence(TRUTHS, "risk").alias("contrastive_meta"), F.lit(model.available).alias("available"))


EVERY_RULE = (*[f"rule__{n}" for n in NAMES], "(risk - m) / s", "1.0::double")


@query(
    "contrastive_coefficients",
    sql("truth", f"""select feature, round(coefficient, 6) as coefficient, round(exp(coefficient), 6) as odds_ratio,
      round(abs(coefficient), 6) as absolute_coefficient, row_number() over (order by abs(coefficient) desc, place)::int as rank
      from (select unnest({[*NAMES, "risk_z"]!r}) as feature, unnest(fitted[1:{len(NAMES) + 1}]) as coefficient, unnest(range({len(NAMES) + 1})) as place from contrast)""",
        CZ, newton_sql(EVERY_RULE, "truth", "contrast")),
)
def contrastive_coefficients(spark, sf_dir):
    source = binding.audit(spark, sf_dir)
    model = contrastive.fit_contrastive(
        source.part("rule_audit"), TRUTHS, RULE_NAMES, label="label", risk="risk", alert="alert", activation=ACTIVATION
    )
    return model.coefficient_table(spark)
