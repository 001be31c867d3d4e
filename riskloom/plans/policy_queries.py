"""Budgeted selection, locked policies, matched controls, resampling and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.hashing import MERSENNE_31, POISSON_1, replicate_coefficients
from riskloom.operators import audit as audit_ops
from riskloom.operators import controls, evidence, joins, matching, policy, resample
from riskloom.operators.policy import Guardrails
from riskloom.plans import binding
from riskloom.plans.audit_queries import EVIDENCE_CTES, METHODS, audited, frozen_contrast, frozen_weights, shares, with_evidence
from riskloom.plans.binding import ACTIVATION, TRUTHS
from riskloom.plans.oracle import settled_sql, sql
from riskloom.plans.registry import query
from riskloom.session import stage, with_constants
from riskloom.sources import artifacts

ALL_METHODS = (*METHODS, "contrastive_meta", "guarded_ensemble")
COVERAGES = (0.05, 0.10, 0.25, 0.50)
RAILS = Guardrails(minimum_delta=0.005, minimum_support=0.05, minimum_fidelity=0.50)
NAMES = {"risk": "risk", "alert": "alert", "row_id": "txn_id"}
BINS, CALIPER = 20, 0.02
FOCUS, FOCUS_COVERAGE = "audit_weighted", 0.25


def evidenced(spark, sf_dir, *roles: str) -> DataFrame:
    source, weights = frozen_weights(spark, sf_dir)
    rows = with_evidence(source.part(*roles), weights, frozen_contrast(spark, sf_dir))
    return stage(rows.select("txn_id", "event_time", "role", "label", "risk", "alert", *ALL_METHODS), "evidence")


def locked(spark, sf_dir) -> tuple[DataFrame, list[policy.LockedPolicy]]:
    rows = evidenced(spark, sf_dir, "policy_select")
    candidates = policy.policy_candidates(rows, ALL_METHODS, COVERAGES, label="label", **NAMES)
    return rows, policy.lock_policies(candidates, RAILS)


def focused(rows: DataFrame) -> DataFrame:
    """Alerts with one method's selection at one budget and the score-only selection of equal size."""
    alerts, supported = rows.agg(F.count_if("alert"), F.count_if(F.col("alert") & (F.col(FOCUS) > 0))).first()
    return marked_alerts(rows, FOCUS, min(policy.budget_count(alerts, FOCUS_COVERAGE), supported))


def marked_alerts(rows: DataFrame, method: str, count: int) -> DataFrame:
    """Alerts of a staged table with the first ``count`` by one method, and by score only, marked."""
    marks = {name: policy.top_marks(rows, m, [count], **NAMES)[count] for name, m in (("selected", method), ("baseline", policy.SCORE_ONLY))}
    return rows.filter("alert").withColumns({n: F.coalesce(c, F.lit(False)) for n, c in marks.items()})


# --- SQL -------------------------------------------------------------------------------------

LONG = """
  arows as materialized (select txn_id, label as y, risk, event_time, role, unnest([{entries}]) as e
    from evid where alert and role in ('policy_select', 'test')),
  along as materialized (select txn_id, y, risk, event_time, role, e.m as method, e.v as ev,
    row_number() over (partition by role, e.m order by e.v desc, risk desc, md5(txn_id)) as rank
    from arows where e.m = '__score_only' or e.v > 0),
  cov as (select unnest([0.05::double, 0.10::double, 0.25::double, 0.50::double]) as coverage),
  na as materialized (select role, count(*) as alerts, sum(label) as positives from evid
    where alert and role in ('policy_select', 'test') group by 1)""".format(
    entries=", ".join([f"{{'m': '{m}', 'v': {m}::double}}" for m in ALL_METHODS] + ["{'m': '__score_only', 'v': risk}"])
)
FIDELITY = """
  flong as (select role, method, v, alert::int as a, risk from (
    select role, alert, risk, unnest([{entries}]) as e from evid where role in ('policy_select', 'test')) t,
    lateral (select e.m as method, e.v as v)),
  frank as (select *, rank() over (partition by role, method order by v) + (count(*) over (partition by role, method, v) - 1) / 2.0 as r
    from flong),
  fauc as (select role, method, (sum(r * a) - sum(a) * (sum(a) + 1) / 2.0) / (sum(a) * sum(1 - a)) as region from frank group by 1, 2),
  fcor as (select role, method, case when count(distinct v) > 1 then corr(x, z) end as agree from (
    select role, method, v, rank() over (partition by role, method order by v) + (count(*) over (partition by role, method, v) - 1) / 2.0 as x,
      rank() over (partition by role, method order by risk) + (count(*) over (partition by role, method, risk) - 1) / 2.0 as z
    from flong where a = 1) group by 1, 2),
  fid as materialized (select * from fauc join fcor using (role, method))""".format(
    entries=", ".join(f"{{'m': '{m}', 'v': {m}::double}}" for m in ALL_METHODS)
)
CANDIDATES = """
  sizes2 as (select role, coverage, alerts, positives, least(alerts, greatest(1, ceil(coverage * alerts)))::bigint as want
    from na, cov),
  sup2 as (select role, method, count(*) as support from along where method <> '__score_only' group by 1, 2),
  means as (select role, e.m as method, avg(case when y = 1 then e.v end) as tpm, avg(case when y = 0 then e.v end) as fpm,
    max(e.v) > min(e.v) as varies from arows where e.m <> '__score_only' group by 1, 2),
  grid as materialized (select s.*, m.method, coalesce(support, 0) as support, least(want, coalesce(support, 0)) as got, tpm, fpm, varies
    from sizes2 s join means m using (role) left join sup2 using (role, method)),
  picked as (select g.role, g.coverage, g.method, sum(y) as hits, min(ev) as cutoff from grid g join along a
    on a.role = g.role and a.method = g.method and a.rank <= g.got group by 1, 2, 3),
  base2 as (select g.role, g.coverage, g.method, sum(case when rank <= g.got then y end) as shits,
    sum(case when rank <= g.want then y end) as whits from grid g join along a on a.role = g.role and a.method = '__score_only'
    group by 1, 2, 3),
  cand as materialized (select *, hits / nullif(got, 0) as prec, shits / nullif(got, 0) as sprec, whits / nullif(want, 0) as wprec,
    positives / alerts as aprec from grid left join picked using (role, coverage, method) join base2 using (role, coverage, method)
    left join fid using (role, method))"""
CANDIDATE_CTES = (*EVIDENCE_CTES, LONG, FIDELITY, CANDIDATES)
RANK_ORDER = "case method when 'guarded_ensemble' then 0 when 'contrastive_meta' then 1 when 'attribution_gated' then 2 when 'fp_penalized' then 3 when 'audit_weighted' then 4 else 5 end"
LOCK = f"""
  elig as (select *, prec is not null and prec - sprec > 0.005::double and support / alerts >= 0.05 and support >= want
    and tpm - fpm > 0 and region >= 0.5 and varies as ok from cand where role = 'policy_select'),
  lockd as materialized (select c.coverage, b.method, b.method is null as abstain, b.got, b.prec, b.sprec, b.cutoff, c.alerts,
      c.aprec, c.wprec from (select distinct coverage, alerts, aprec, any_value(wprec) over (partition by coverage) as wprec from elig) c
    left join (select * from elig where ok qualify row_number() over (partition by coverage
      order by prec - sprec desc, prec desc, tpm - fpm desc, {RANK_ORDER}, method) = 1) b using (coverage))"""
LOCK_CTES = (*CANDIDATE_CTES, LOCK)
FOCUS_SQL = f"""
  focus as materialized (select e.txn_id, e.label as y, e.risk, e.{FOCUS} as ev, e.event_time,
    e.txn_id in (select txn_id from along a join grid g on a.role = g.role and a.method = g.method
      where a.role = 'test' and a.method = '{FOCUS}' and g.coverage = {FOCUS_COVERAGE}::double and a.rank <= g.got) as selected,
    e.txn_id in (select txn_id from along a join grid g on a.role = g.role
      where a.role = 'test' and a.method = '__score_only' and g.method = '{FOCUS}' and g.coverage = {FOCUS_COVERAGE}::double
        and a.rank <= g.got) as baseline
    from evid e where e.alert and e.role = 'test')"""
EDGES = f"""
  edges as materialized (select list_sort(list_distinct(quantile_cont(risk, {[k / BINS for k in range(1, BINS)]}))) as q
    from evid where alert and role = 'policy_select'),
  binned as materialized (select focus.*, len(list_filter(q, lambda t: risk >= t))::int as risk_bin from focus, edges)"""
FOCUS_CTES = (*CANDIDATE_CTES, FOCUS_SQL)
BIN_CTES = (*FOCUS_CTES, EDGES)


def _cell_pairs(n: int, left: str, right: str, shift: float) -> str:
    """CTEs of one round of cell matching over (selected) ``left`` and (controls) ``right``."""
    cell = f"floor(risk / {CALIPER}::double + {shift}::double)::bigint as cell"
    return f"""
  l{n} as (select *, {cell} from {left}), r{n} as (select *, {cell} from {right}),
  c{n} as (select * from (select risk_bin, cell, count(*) as s from l{n} group by 1, 2) join (select risk_bin, cell, count(*) as c from r{n} group by 1, 2) using (risk_bin, cell)),
  g{n} as (select l{n}.*, s, c from l{n} join c{n} using (risk_bin, cell)
    qualify row_number() over (partition by risk_bin, cell order by ev desc, md5(txn_id)) <= c),
  k{n} as (select *, row_number() over (partition by risk_bin, cell order by risk, md5(txn_id)) as k from g{n}),
  o{n} as (select *, row_number() over (partition by risk_bin, cell order by risk, md5(txn_id)) as place from r{n}),
  p{n} as materialized (select k{n}.txn_id as selected_id, o{n}.txn_id as control_id from k{n} join o{n}
    on k{n}.risk_bin = o{n}.risk_bin and k{n}.cell = o{n}.cell and o{n}.place = ((2 * k - 1) * c) // (2 * least(s, c)) + 1)"""


# Risks and evidence at ten decimals, as exp() differs by engine in the last place, and the quantiles of the edges written out:
# what ties, or equals an edge, does so in every engine.
PAIRS = f"""
  orisk as materialized (select r, row_number() over (order by r) - 1 as place, count(*) over () as n
    from (select {settled_sql('risk')} as r from evid where alert and role = 'policy_select')),
  ospot as (select floor(x)::bigint as low, least(floor(x) + 1, n - 1)::bigint as high, x - floor(x) as part
    from (select any_value(n) as n, unnest([{", ".join(f"(any_value(n) - 1) * {k / BINS!r}::double" for k in range(1, BINS))}]) as x from orisk)),
  oedges as materialized (select list_sort(list(distinct a.r + (b.r - a.r) * part)) as q from ospot join orisk a on a.place = low join orisk b on b.place = high),
  settled as (select * replace ({settled_sql('risk')} as risk, {settled_sql('ev')} as ev) from focus),
  placed as materialized (select settled.*, len(list_filter(q, lambda t: risk >= t))::int as risk_bin from settled, oedges),
  lhs as (select * from placed where selected), rhs as (select * from placed where not selected),{_cell_pairs(1, "lhs", "rhs", 0.0)},
  lhs2 as (select * from lhs where txn_id not in (select selected_id from p1)), rhs2 as (select * from rhs where txn_id not in (select control_id from p1)),
  {_cell_pairs(2, "lhs2", "rhs2", 0.5)},
  found as (select * from p1 union all select * from p2),
  pairs as materialized (select l.risk_bin, l.txn_id as selected_id, r.txn_id as control_id, l.risk as selected_risk, r.risk as control_risk,
    abs(r.risk - l.risk) as gap, l.ev as selected_evidence, r.ev as control_evidence, r.txn_id is not null as matched, l.y as ly, r.y as ry,
    case when r.txn_id is null then (select min(abs(x.risk - l.risk)) from rhs x where x.risk_bin = l.risk_bin) end as nearest_gap
    from lhs l left join found f on l.txn_id = f.selected_id left join rhs r on r.txn_id = f.control_id)"""

# --- queries ---------------------------------------------------------------------------------


@query(
    "budget_selection",
    sql("truth", """select a.txn_id, g.coverage, a.method, a.rank::bigint as rank from along a join grid g
      on a.role = g.role and a.method = g.method where a.role = 'test' and a.method = 'audit_weighted' and a.rank <= g.got""",
        *CANDIDATE_CTES),
)
def budget_selection(spark, sf_dir):
    """Selected test alerts of one method at every budget."""
    rows = evidenced(spark, sf_dir, "test")
    ranked = policy.ranked_alerts(rows, ["audit_weighted"], score_only=False, **NAMES)
    alerts = rows.agg(F.count_if("alert")).first()[0]
    takes = F.array(*[F.struct(F.lit(c).alias("coverage"), F.lit(policy.budget_count(alerts, c)).alias("take")) for c in COVERAGES])
    chosen = ranked.select("txn_id", "method", "rank", F.explode(takes).alias("b")).filter("rank <= b.take")
    return chosen.select("txn_id", F.col("b.coverage").alias("coverage"), "method", "rank")


@query(
    "policy_candidates",
    sql("truth", """select method, coverage, alerts as alert_count, got::bigint as selected_count, want as requested_selected_count,
      round(got / alerts, 6) as realized_alert_coverage, got < want as support_shift_underfill, support as supported_alert_count,
      round(support / alerts, 6) as supported_alert_fraction, round(aprec, 6) as all_alert_precision, round(prec, 6) as selected_precision,
      round(prec - aprec, 6) as precision_gain_vs_all_alerts, got::bigint as score_only_selected_count, round(sprec, 6) as score_only_precision,
      round(wprec, 6) as score_only_requested_budget_precision, round(prec - sprec, 6) as delta_vs_score_only,
      round(1 - sprec, 6) as headroom_after_score_only, round(tpm, 6) as evidence_tp_mean, round(fpm, 6) as evidence_fp_mean,
      round(tpm - fpm, 6) as evidence_tp_fp_gap, round(cutoff, 6) as evidence_cutoff, varies as evidence_varies,
      round(region, 6) as positive_region_fidelity, round(agree, 6) as alert_conditional_rank_fidelity, reasons = '' as eligible, reasons as ineligible_reasons
      from (select *, concat_ws(';', case when not varies then 'constant_evidence' end,
        case when support / alerts < 0.05 then 'insufficient_rule_support' end,
        case when support < want then 'insufficient_active_rules_for_fixed_budget' end,
        case when not coalesce(tpm - fpm > 0, false) then 'tp_fp_evidence_guardrail_not_met' end,
        case when not coalesce(region >= 0.5, false) then 'fidelity_guardrail_not_met' end,
        case when not coalesce(prec - sprec > 0.005::double, false) then 'score_only_guardrail_not_met' end) as reasons from cand) where role = 'policy_select'""", *CANDIDATE_CTES),
)
def policy_candidates(spark, sf_dir):
    rows = evidenced(spark, sf_dir, "policy_select")
    return policy.with_eligibility(policy.policy_candidates(rows, ALL_METHODS, COVERAGES, label="label", **NAMES), RAILS)


@query(
    "locked_policy",
    sql("truth", """select coverage, method, abstain, case when abstain then 'no_method_beats_score_only_guardrail'
        else 'validation_guardrails_passed' end as reason, alerts as validation_alert_count, coalesce(got, 0)::bigint as validation_selected_count,
      round(aprec, 6) as validation_all_alert_precision, round(case when abstain then wprec else sprec end, 6) as validation_score_only_precision,
      round(prec, 6) as validation_selected_precision, round(prec - sprec, 6) as validation_delta_vs_score_only,
      round(cutoff, 6) as validation_evidence_cutoff, 0.005::double as minimum_score_only_delta from lockd""", *LOCK_CTES),
)
def locked_policy(spark, sf_dir):
    """One method per budget, or abstention, chosen on policy rows only."""
    return policy.policy_table(spark, locked(spark, sf_dir)[1])


REPORT = """
  rep as materialized (select l.coverage, l.method, l.abstain, n.n as rows, n.pos, n.alerts, n.apos,
    least(n.alerts, greatest(1, ceil(l.coverage * n.alerts)))::bigint as want,
    coalesce(c.got, 0)::bigint as got, coalesce(c.hits, 0)::bigint as hits, coalesce(case when l.abstain then 0 else c.shits end, 0)::bigint as shits,
    w.whits::bigint as whits, c.region, c.agree
    from lockd l cross join (select count(*) as n, sum(label)::bigint as pos, sum(alert::int)::bigint as alerts,
      sum((alert and label = 1)::int)::bigint as apos from evid where role = 'test') n
    left join cand c on c.role = 'test' and c.coverage = l.coverage and c.method = l.method
    join (select coverage, any_value(whits) as whits from cand where role = 'test' group by 1) w on w.coverage = l.coverage)"""


@query(
    "policy_report",
    sql("truth", """select coverage as coverage_budget, method, abstain, rows as test_rows, alerts as alert_count,
      want as requested_selected_count, got as selected_count, hits as selected_positive_count, shits as score_only_positive_count,
      whits as score_only_requested_budget_positive_count, pos as test_positive_count, apos as alert_positive_count,
      got < want as support_shift_underfill, alerts - got as unexplained_alert_count, round(got / alerts, 6) as explanation_coverage,
      round(hits / pos, 6) as selected_recall_test_positives, round(shits / apos, 6) as score_only_recall_alert_positives,
      round(apos / alerts, 6) as all_alert_precision, round(hits / nullif(got, 0), 6) as selected_alert_precision,
      round(shits / nullif(got, 0), 6) as score_only_precision, round(whits / want, 6) as score_only_requested_budget_precision,
      round((alerts - got) / alerts, 6) as abstention_rate, round(hits / nullif(got, 0) / (apos / alerts), 6) as alert_triage_lift,
      round((hits - shits) / nullif(got, 0), 6) as delta_vs_score_only, round(1 - shits / nullif(got, 0), 6) as score_only_headroom,
      round(region, 6) as positive_region_fidelity from rep""", *LOCK_CTES, REPORT),
)
def policy_report(spark, sf_dir):
    """The locked policies on later transactions, against score-only selections."""
    _, policies = locked(spark, sf_dir)
    report = policy.policy_report(evidenced(spark, sf_dir, "test"), policies, label="label", **NAMES)
    if "positive_region_fidelity" not in report.columns:
        report = report.withColumn("positive_region_fidelity", F.lit(None).cast("double"))
    return report.select(
        "coverage_budget", "method", "abstain", "test_rows", "alert_count", "requested_selected_count", "selected_count",
        "selected_positive_count", "score_only_positive_count", "score_only_requested_budget_positive_count",
        "test_positive_count", "alert_positive_count", "support_shift_underfill", "unexplained_alert_count",
        "explanation_coverage", "selected_recall_test_positives", "score_only_recall_alert_positives", "all_alert_precision",
        "selected_alert_precision", "score_only_precision", "score_only_requested_budget_precision", "abstention_rate",
        "alert_triage_lift", "delta_vs_score_only", "score_only_headroom", "positive_region_fidelity",
    )


SIGNED = """
  signed as (select a.txn_id, l.coverage from lockd l join along a on a.role = 'test' and a.method = l.method
    join grid g on g.role = 'test' and g.method = l.method and g.coverage = l.coverage where a.rank <= g.got)"""


@query(
    "selection_signature",
    sql("truth", """select coverage, count(*) as rows, sum(('0x' || substr(md5(txn_id), 1, 12))::bigint)::varchar || ':'
        || sum(('0x' || substr(md5(txn_id), 21, 12))::bigint)::varchar as fingerprint
      from signed group by 1""", *LOCK_CTES, SIGNED),
)
def selection_signature(spark, sf_dir):
    """Fingerprint of the selected test rows per budget; selecting reads no label."""
    _, policies = locked(spark, sf_dir)
    blind = evidenced(spark, sf_dir, "test").drop("label")
    return artifacts.selection_signature(policy.apply_policies(blind, policies, **NAMES))


@query(
    "risk_bins",
    sql("truth", "select txn_id, risk_bin from binned", *BIN_CTES),
)
def risk_bins(spark, sf_dir):
    """Test alerts in bins frozen on policy alerts."""
    rows = evidenced(spark, sf_dir, "policy_select", "test").filter("alert")
    edges = matching.risk_bin_edges(rows.filter("role = 'policy_select'"), "risk", BINS)
    return rows.filter("role = 'test'").select("txn_id", matching.risk_bin(F.col("risk"), edges).alias("risk_bin"))


def _pair_inputs(spark, sf_dir):
    rows = evidenced(spark, sf_dir, "policy_select", "test")
    edges = matching.risk_bin_edges(rows.filter("role = 'policy_select' and alert"), "risk", BINS)
    return focused(rows.filter("role = 'test'")), edges


def _settled_inputs(spark, sf_dir):
    """Alerts and edges at ten decimals, so that ties do not hang on an engine's exp()."""
    rows = evidenced(spark, sf_dir, "policy_select", "test")
    known = rows.filter("role = 'policy_select' and alert").select(binding.settled("risk").alias("risk"))
    alerts = focused(rows.filter("role = 'test'")).withColumns({c: binding.settled(c) for c in ("risk", FOCUS)})
    return alerts, matching.risk_bin_edges(known, "risk", BINS)


MATCH = {"selected": "selected", "risk": "risk", "evidence": FOCUS, "row_id": "txn_id"}


@query(
    "matched_cells",
    sql("truth", """select risk_bin, selected_id, control_id, round(selected_risk, 6) as selected_risk, round(control_risk, 6) as control_risk,
      round(gap, 6) as absolute_risk_gap, round(selected_evidence, 6) as selected_evidence, round(control_evidence, 6) as control_evidence,
      matched, round(nearest_gap, 6) as nearest_gap from pairs""", *FOCUS_CTES, PAIRS),
)
def matched_cells(spark, sf_dir):
    """One-to-one controls within risk bin and caliper cell."""
    alerts, edges = _settled_inputs(spark, sf_dir)
    return matching.match_in_cells(alerts.drop("label"), edges=edges, caliper=CALIPER, **MATCH)


@query(
    "matched_summary",
    sql("truth", """select count(*) as requested_selected_rows, sum(matched::int)::bigint as matched_pairs,
      round(avg(case when matched then gap end), 6) as mean_absolute_risk_gap, round(avg(case when matched then ly end), 6) as selected_precision,
      round(avg(case when matched then ry end), 6) as matched_control_precision,
      round(avg(case when matched then ly - ry end), 6) as matched_precision_difference, sum((matched and ly < ry)::int)::bigint as worse_pairs,
      sum((matched and ly = ry)::int)::bigint as equal_pairs, sum((matched and ly > ry)::int)::bigint as better_pairs,
      sum((not matched)::int)::bigint as unmatched_rows, round(avg(matched::int), 6) as match_rate from pairs""", *FOCUS_CTES, PAIRS),
)
def matched_summary(spark, sf_dir):
    alerts, edges = _settled_inputs(spark, sf_dir)
    return matching.matched_summary(matching.match_in_cells(alerts, edges=edges, caliper=CALIPER, carry=["label"], **MATCH))


@query("pair_interval")
def pair_interval(spark, sf_dir):
    """Interval of the matched precision difference from exact multinomial draws."""
    alerts, edges = _settled_inputs(spark, sf_dir)
    summary = matching.matched_summary(matching.match_in_cells(alerts, edges=edges, caliper=CALIPER, carry=["label"], **MATCH))
    return resample.pair_difference_interval(stage(summary, "summary"), replicates=REPLICATES)


RESIDUAL = """
  perbin as materialized (select risk_bin, count(*) as n, sum(y) as tp, sum(1 - y) as fp, min(risk) as lo, max(risk) as hi,
    avg(case when y = 1 then ev end) as tm, avg(case when y = 0 then ev end) as fm from binned group by 1)"""


@query(
    "residual_gap",
    sql("truth", """select risk_bin, n as rows, tp::bigint as tp_count, fp::bigint as fp_count, round(lo, 6) as risk_min, round(hi, 6) as risk_max,
      round(tm, 6) as tp_evidence_mean, round(fm, 6) as fp_evidence_mean, round(tm - fm, 6) as tp_fp_evidence_gap,
      least(tp, fp)::bigint as comparison_weight from perbin""", *BIN_CTES, RESIDUAL),
)
def residual_gap(spark, sf_dir):
    alerts, edges = _pair_inputs(spark, sf_dir)
    return matching.residual_by_bin(alerts, label="label", risk="risk", evidence=FOCUS, edges=edges)


@query(
    "residual_summary",
    sql("truth", """select sum(n)::bigint as alert_rows, count(tm - fm) as comparable_bins,
      coalesce(sum(case when tm - fm is not null then least(tp, fp) end), 0)::bigint as comparison_weight,
      round(sum((tm - fm) * least(tp, fp)) / nullif(sum(case when tm - fm is not null then least(tp, fp) end), 0), 6)
        as risk_conditioned_tp_fp_gap from perbin""", *BIN_CTES, RESIDUAL),
)
def residual_summary(spark, sf_dir):
    alerts, edges = _pair_inputs(spark, sf_dir)
    return matching.residual_summary(
        matching.residual_by_bin(alerts, label="label", risk="risk", evidence=FOCUS, edges=edges)
    )


REPLICATES = 1000
BLOCKS = f"""
  blocks as materialized (select *, row_number() over (order by block) as k from (
    select event_time::date as block, sum(selected::int) as s, sum((selected and y = 1)::int) as sy, sum(baseline::int) as b,
      sum((baseline and y = 1)::int) as byy from focus group by 1)),
  draws as (select r.rep, (floor(('0x' || substr(md5(concat_ws('|', 42, r.rep, d.d)), 1, 8))::bigint / 4294967296.0 * nb) + 1)::bigint as k
    from range({REPLICATES}) r(rep), (select count(*) as nb from blocks), lateral (select unnest(range(1, nb + 1)) as d) d),
  reps as materialized (select rep, sum(sy) / nullif(sum(s), 0) - sum(byy) / nullif(sum(b), 0) as d from draws join blocks using (k) group by 1)"""


@query(
    "block_bootstrap",
    sql("truth", """select round(o, 6) as observed_difference, round(avg(d), 6) as bootstrap_mean, round(quantile_cont(d, 0.025), 6) as ci_low,
      round(quantile_cont(d, 0.975), 6) as ci_high, round(avg(case when d is not null then (d > 0)::int end), 6) as probability_positive,
      count(d) as valid_iterations from reps, (select sum(sy) / sum(s) - sum(byy) / sum(b) as o from blocks) group by o""", *FOCUS_CTES, BLOCKS),
)
def block_bootstrap(spark, sf_dir):
    """Day-block bootstrap of the precision difference between evidence and score-only selection."""
    rows = focused(evidenced(spark, sf_dir, "test"))
    return resample.paired_block_bootstrap(
        rows, block=F.to_date("event_time"), label="label", selected="selected", baseline="baseline", replicates=REPLICATES
    )


P_REPS = 300


def _pr_sql() -> str:
    pairs = ", ".join(
        f"{{'rep': {r}, 'a': {a}, 'b': {b}}}" for r, (a, b) in ((r, replicate_coefficients(42, r)) for r in range(P_REPS))
    )
    weight = "case " + " ".join(f"when u < {p!r}::double then {k}" for k, p in enumerate(POISSON_1)) + f" else {len(POISSON_1)} end"
    return f""", x as (select txn_id, label as y, risk, amount_paid, (('0x' || substr(md5(txn_id), 1, 12))::bigint % {MERSENNE_31}) as n
          from roled where role = 'test'),
        d as (select txn_id, y, risk, amount_paid, e.rep, ((n * e.a + e.b) % {MERSENNE_31}) / {MERSENNE_31}.0::double as u
          from (select *, unnest([{pairs}]) as e from x)),
        w as (select *, {weight} as w from d),
        every as (select y, risk, amount_paid, -1 as rep, 1 as w from x union all select y, risk, amount_paid, rep, w from w),
        t as (select rep, sum(w * y) as p, sum(w * (1 - y)) as n from every group by 1),
        f as (select rep, first_value(p) over o / nullif(p, 0)::double as cp, first_value(n) over o / nullif(n, 0)::double as cn
          from t window o as (order by rep)),
        l as (select rep, 'first' as which, risk as p, y, w from every where w > 0 union all
          select rep, 'second', amount_paid, y, w from every where w > 0),
        c as (select rep, which, p, sum(w * y) * any_value(cp) as pos, sum(w * (1 - y)) * any_value(cn) as neg
          from l join f using (rep) group by 1, 2, 3),
        k as (select *, sum(pos) over o as tp, sum(neg) over o as fp, sum(pos) over (partition by rep, which) as np
          from c window o as (partition by rep, which order by p desc)),
        ap as (select rep, which, sum(pos * tp / (tp + fp)) / any_value(np) as v from k where tp + fp > 0 group by 1, 2),
        diff as (select a.rep, a.v - b.v as d from ap a join ap b using (rep) where a.which = 'first' and b.which = 'second')
      select round((select d from diff where rep = -1), 6) as observed_difference, round(avg(d), 6) as bootstrap_mean,
        round(quantile_cont(d, 0.025), 6) as ci_low, round(quantile_cont(d, 0.975), 6) as ci_high,
        round(avg((d > 0)::int), 6) as probability_positive, count(d) as valid_iterations from diff where rep >= 0"""


@query("pr_auc_bootstrap", sql("roled", _pr_sql()))
def pr_auc_bootstrap(spark, sf_dir):
    """PR-AUC of the score against the bare amount on the same resamples, with class totals kept."""
    rows = binding.audit(spark, sf_dir).part("test")
    return resample.paired_pr_auc_bootstrap(
        rows, label="label", first="risk", second="amount_paid", row_id="txn_id", replicates=P_REPS, seed=42
    )


@query("precision_gain_interval")
def precision_gain_interval(spark, sf_dir):
    """Interval of the precision gain of explained alerts, with its reading."""
    rows = binding.audit(spark, sf_dir).part("test")
    on = evidence.supported(TRUTHS, ["deep_discount", "high_amount"], ACTIVATION)
    out = resample.precision_gain_interval(
        rows.withColumn("explained", on), label="label", alert="alert", explained="explained", replicates=REPLICATES
    )
    return out.withColumn("status", controls.enrichment_status(F.col("ci_low"), F.col("ci_high"), F.col("valid_iterations")))


PERMUTED = f"""
  pa as (select txn_id, {FOCUS} as ev from evid where role = 'test' and alert),
  givers as (select ev, row_number() over (order by md5('a42|' || txn_id)) as k from pa),
  takers as (select txn_id, ev as own, row_number() over (order by md5('b42|' || txn_id)) as k from pa)"""


@query(
    "evidence_permutation",
    sql("truth", """select txn_id, round(g.ev, 6) as permuted, round(case when own > 0
        then ('0x' || substr(md5('42|' || txn_id), 1, 8))::bigint / 4294967296.0 else 0 end, 6) as random_evidence
      from takers join givers g using (k)""", *EVIDENCE_CTES, PERMUTED),
)
def evidence_permutation(spark, sf_dir):
    """Evidence moved to other alerts, and random evidence on supported alerts."""
    alerts = evidenced(spark, sf_dir, "test").filter("alert")
    shuffled = resample.permute_column(alerts, FOCUS, "txn_id", 42, "permuted")
    chance = alerts.select("txn_id", resample.random_evidence(F.col(FOCUS), "txn_id", 42).alias("random_evidence"))
    return shuffled.join(chance, "txn_id")


CONTROLS = """
  nbase as materialized (select txn_id, y, risk, e.m as method, e.v as ev from arows
    where role = 'test' and e.m in (select method from lockd where not abstain)),
  ngive as (select method, ev, row_number() over (partition by method order by md5('a42|' || txn_id)) as k from nbase),
  ntake as (select method, txn_id, row_number() over (partition by method order by md5('b42|' || txn_id)) as k from nbase),
  nperm as (select method, txn_id, ev as pv from ntake join ngive using (method, k)),
  nlong as (select method, txn_id, y, risk, unnest([{'c': 'locked_policy', 'v': ev::double}, {'c': 'predictor_score_only', 'v': risk::double},
      {'c': 'row_permuted_evidence', 'v': pv::double}, {'c': 'random_evidence', 'v': rv::double}]) as e
    from (select b.*, pv, case when ev > 0 then ('0x' || substr(md5('42|' || b.txn_id), 1, 8))::bigint / 4294967296.0 else 0 end as rv
      from nbase b join nperm using (method, txn_id))),
  nrank as materialized (select method, e.c as control, y, row_number() over (partition by method, e.c order by e.v desc, risk desc, md5(txn_id)) as rank
    from nlong where e.c = 'predictor_score_only' or e.v > 0),
  nsup as (select method, count(*) as support from nrank where control = 'locked_policy' group by 1),
  ncell as (select l.coverage, l.method, l.abstain, s.alerts, s.want, case when l.abstain then 0 else least(want, coalesce(support, 0)) end as cnt, control
    from lockd l join sizes2 s on s.role = 'test' and s.coverage = l.coverage left join nsup using (method),
      (select unnest(['locked_policy', 'predictor_score_only', 'row_permuted_evidence', 'random_evidence']) as control)),
  nfound as (select c.coverage, c.control, count(r.rank) as n, coalesce(sum(r.y), 0) as hits from ncell c
    left join nrank r on r.method = c.method and r.control = c.control and r.rank <= c.cnt group by 1, 2)"""


@query(
    "negative_controls",
    sql("truth", """select coverage as coverage_budget, control, alerts as alert_count, want as requested_selected_count,
      cnt::bigint as matched_realized_selected_count, n as selected_count, hits::bigint as selected_positive_count, abstain as policy_abstained,
      n = cnt as equal_count_with_locked, round(n / alerts, 6) as achieved_alert_coverage, round(hits / nullif(n, 0), 6) as selected_precision
      from ncell join nfound using (coverage, control)""", *LOCK_CTES, CONTROLS),
)
def negative_controls(spark, sf_dir):
    """Locked, score-only, permuted and random selections at equal counts."""
    _, policies = locked(spark, sf_dir)
    return controls.negative_controls(evidenced(spark, sf_dir, "test"), policies, label="label", **NAMES)


# Seeds of the policy resamples.
STABILITY_SEEDS = (42, 123, 2026, 1705, 2027)


def _seeds_sql() -> str:
    """CTEs of the policy locked again on every weighted resample of the policy rows."""
    coefficients = ", ".join(
        f"{{'seed': {s}, 'a': {a}, 'b': {b}}}" for s, (a, b) in ((s, replicate_coefficients(s, 0)) for s in STABILITY_SEEDS)
    )
    weight = "case " + " ".join(f"when u < {p!r}::double then {k}" for k, p in enumerate(POISSON_1)) + f" else {len(POISSON_1)} end"
    entries = ", ".join(f"{{'m': '{m}', 'v': {m}::double}}" for m in ALL_METHODS)
    earlier = "rows between unbounded preceding and 1 preceding"
    return f"""
  sdraw as (select txn_id, label as y, risk, alert, {', '.join(ALL_METHODS)}, unnest([{coefficients}]) as c,
    (('0x' || substr(md5(txn_id), 1, 12))::bigint % {MERSENNE_31}) as n31 from evid where role = 'policy_select'),
  sw as materialized (select *, {weight} as w from (select *, c.seed as seed, ((n31 * c.a + c.b) % {MERSENNE_31}) / {MERSENNE_31}.0::double as u from sdraw)),
  sarows as materialized (select seed, txn_id, y, risk, w, unnest([{entries}, {{'m': '__score_only', 'v': risk}}]) as e from sw where alert),
  slong as materialized (select seed, y, w, e.m as method, e.v as ev, coalesce(sum(w) over (partition by seed, e.m
    order by e.v desc, risk desc, md5(txn_id) {earlier}), 0) as before from sarows where e.m = '__score_only' or e.v > 0),
  sna as (select seed, sum(w) as alerts from sw where alert group by 1),
  ssize as (select seed, coverage, alerts, least(alerts, greatest(1, ceil(coverage * alerts)))::bigint as want from sna, cov),
  ssup as (select seed, method, sum(w) as support from slong where method <> '__score_only' group by 1, 2),
  smean as (select seed, e.m as method, sum(w * y * e.v) / sum(w * y) - sum(w * (1 - y) * e.v) / sum(w * (1 - y)) as gap,
    max(case when w > 0 then e.v end) > min(case when w > 0 then e.v end) as varies from sarows where e.m <> '__score_only' group by 1, 2),
  sgrid as materialized (select z.*, method, coalesce(support, 0) as support, least(want, coalesce(support, 0)) as got, gap, varies
    from ssize z join smean using (seed) left join ssup using (seed, method)),
  spick as (select g.seed, g.coverage, g.method, sum(case when l.method = g.method then y * greatest(0, least(w, g.got - before)) end) as hits,
    sum(case when l.method = '__score_only' then y * greatest(0, least(w, g.got - before)) end) as shits
    from sgrid g join slong l on l.seed = g.seed and l.method in (g.method, '__score_only') group by 1, 2, 3),
  scell as (select seed, e.m as method, e.v as v, sum(w * alert::int) as p, sum(w * (1 - alert::int)) as n
    from (select seed, w, alert, unnest([{entries}]) as e from sw) group by all),
  sauc as (select seed, method, sum(p * (below + n / 2.0)) / sum(p) / sum(n) as region from (
    select *, coalesce(sum(n) over (partition by seed, method order by v {earlier}), 0) as below from scell) group by 1, 2),
  sbest as materialized (select *, hits / got as prec, shits / got as sprec from sgrid join spick using (seed, coverage, method) join sauc using (seed, method)
    where got > 0 and hits / got - shits / got > 0.005::double and support / alerts >= 0.05 and support >= want and gap > 0 and region >= 0.5 and varies
    qualify row_number() over (partition by seed, coverage order by hits / got - shits / got desc, hits / got desc, gap desc, {RANK_ORDER}, method) = 1),
  spair as materialized (select z.seed, z.coverage, b.method as mine, b.prec - b.sprec as d, l.method as other
    from ssize z join lockd l using (coverage) left join sbest b on b.seed = z.seed and b.coverage = z.coverage),
  sover as (select coverage, mine, other, count(*) filter (has = 2) / count(*) as jaccard from (
    select p.coverage, p.mine, p.other, a.txn_id, count(distinct a.method) as has from (select distinct coverage, mine, other from spair where mine <> other) p
      join along a on a.role = 'policy_select' and a.method in (p.mine, p.other)
      join sizes2 z on z.role = a.role and z.coverage = p.coverage where a.rank <= z.want group by 1, 2, 3, 4) group by 1, 2, 3),
  stab as materialized (select p.seed, p.coverage, p.mine, p.other, p.d, f.got, f.prec, f.sprec, f.alerts,
      case when p.mine is not distinct from p.other then 1 when p.mine is not null and p.other is not null then o.jaccard
        else (select (c.got = 0)::int from cand c where c.role = 'policy_select' and c.coverage = p.coverage and c.method = coalesce(p.mine, p.other)) end as jaccard
    from spair p left join sover o on o.coverage = p.coverage and o.mine = p.mine and o.other = p.other
    left join cand f on f.role = 'policy_select' and f.coverage = p.coverage and f.method = p.mine)"""


STABILITY = _seeds_sql()


@query(
    "policy_stability",
    sql("truth", """select seed, coverage, mine as method, mine is null as abstain, round(d, 6) as validation_delta_vs_score_only, other as reference_method,
      other is null as reference_abstain, mine is not distinct from other as method_matches_reference, (mine is null) = (other is null) as abstention_matches_reference,
      coalesce(got, 0)::bigint as full_validation_selected_count, round(coalesce(got / alerts, 0), 6) as full_validation_realized_coverage,
      round(jaccard, 6) as full_validation_selection_jaccard, round(prec, 6) as full_validation_selected_precision,
      round(sprec, 6) as full_validation_score_only_precision, round(prec - sprec, 6) as full_validation_delta_vs_score_only from stab""", *LOCK_CTES, STABILITY),
)
def policy_stability(spark, sf_dir):
    """The policy locked again on weighted resamples and applied to the unchanged rows."""
    rows = evidenced(spark, sf_dir, "policy_select")
    return resample.policy_stability(rows, ALL_METHODS, COVERAGES, RAILS, label="label", seeds=STABILITY_SEEDS, **NAMES)


@query(
    "stability_guard",
    sql("truth", """select coverage, case when kept then method end as method, not kept as abstain,
      case when abstain then 'no_method_beats_score_only_guardrail' when kept then 'validation_guardrails_passed'
        else 'validation_policy_stability_guardrail_not_met' end as reason, alerts as validation_alert_count,
      case when kept then got else 0 end::bigint as validation_selected_count, round(aprec, 6) as validation_all_alert_precision,
      round(case when abstain then wprec else sprec end, 6) as validation_score_only_precision, round(case when kept then prec end, 6) as validation_selected_precision,
      round(case when kept then prec - sprec end, 6) as validation_delta_vs_score_only, round(case when kept then cutoff end, 6) as validation_evidence_cutoff,
      0.005::double as minimum_score_only_delta
      from (select *, not abstain and share >= 0.6 as kept from lockd join (select coverage, avg((mine is not distinct from other
        and coalesce(prec - sprec > 0.005::double, false))::int) as share from stab group by 1) using (coverage))""", *LOCK_CTES, STABILITY),
)
def stability_guard(spark, sf_dir):
    """Locked policies after abstaining where resamples disagree."""
    rows, policies = locked(spark, sf_dir)
    stability = stage(
        resample.policy_stability(rows, ALL_METHODS, COVERAGES, RAILS, label="label", seeds=STABILITY_SEEDS, **NAMES), "stability"
    )
    return policy.policy_table(spark, resample.stable_policies(policies, stability, minimum_delta=RAILS.minimum_delta))


def shuffled_weights(spark, sf_dir, seed: int = 42) -> dict[str, audit_ops.Weights]:
    """Weights of the two shuffled controls: permuted audit labels, and permuted rule weights."""
    source, weights = frozen_weights(spark, sf_dir)
    held = source.part("rule_audit")
    moved = resample.permute_column(held.filter("alert"), "label", "txn_id", seed, "shuffled_label")
    relabelled = held.join(moved, "txn_id", "left").withColumn("label", F.coalesce("shuffled_label", "label")).drop("shuffled_label")
    # Training rows keep their labels, so they are neither joined nor written.
    found = audited(spark, sf_dir, rows=source.part("train").unionByName(stage(relabelled, "relabelled")))
    order = policy.shuffle_mapping(weights.rules, seed)
    return {
        controls.SHUFFLED_CONTROLS[0]: audit_ops.collect_weights(audit_ops.rule_weights(found.completed)),
        controls.SHUFFLED_CONTROLS[1]: audit_ops.Weights(
            {r: weights.audit[order[r]] for r in weights.rules}, {r: weights.penalised[order[r]] for r in weights.rules}
        ),
    }


def variant_reports(spark, sf_dir, variants: dict[str, tuple[audit_ops.Weights, tuple[str, ...]]]) -> DataFrame:
    """Lock and report ablation variants, each with its weights and methods, in one pass over the rows."""
    source = binding.audit(spark, sf_dir)
    columns = {}
    for name, (weights, methods) in variants.items():
        found = evidence.evidence_columns(TRUTHS, weights, methods, shares=shares(), activation=ACTIVATION)
        columns |= {f"{name}/{m}": c for m, c in found.items()}
    rows = source.part("policy_select", "test").withColumns(columns)
    rows = stage(rows.select("txn_id", "role", "label", "risk", "alert", *columns), "variants")
    candidates = policy.policy_candidates(
        rows.filter("role = 'policy_select'"), list(columns), COVERAGES, label="label", **NAMES
    )
    judged = policy.with_eligibility(candidates, RAILS).collect()
    precedence = [f"{v}/{m}" for v in variants for m in evidence.METHOD_PRECEDENCE]
    policies, names = [], []
    for name in variants:
        mine = policy.choose_policies([r for r in judged if r["method"].startswith(f"{name}/")], RAILS, precedence)
        policies += mine
        names += [name] * len(mine)
    report = policy.policy_report(rows.filter("role = 'test'"), policies, label="label", names=names, **NAMES)
    return report.select(
        "variant", "coverage_budget", F.element_at(F.split("method", "/"), 2).alias("method"), "abstain", "alert_count",
        "selected_count", "requested_selected_count", "selected_alert_precision", "score_only_precision", "delta_vs_score_only",
    )


@query("ablation_variants")
def ablation_variants(spark, sf_dir):
    """Policy reports of single methods, independent pools and both shuffled controls."""
    found = audited(spark, sf_dir)
    weights = audit_ops.collect_weights(audit_ops.rule_weights(found.completed))
    variants = {"full": (weights, METHODS)}
    variants |= {f"only_{m}": (weights, (m,)) for m in METHODS}
    pools = {"amount_rules_only": ["high_amount", "deep_discount", "large_cross_bank"],
             "context_rules_only": ["cross_bank_gap", "busy_sender", "low_balance", "risky_format", "unusual_gap"]}
    for name, rules in pools.items():
        pool = audit_ops.remove_redundant(found.table, found.overlap, rules=rules)
        variants[name] = (audit_ops.collect_weights(audit_ops.rule_weights(pool)), METHODS)
    variants |= {n: (w, METHODS) for n, w in shuffled_weights(spark, sf_dir).items()}
    return variant_reports(spark, sf_dir, variants)


@query("outcome")
def outcome(spark, sf_dir):
    """Conservative outcome per budget from bootstrap, matching, residuals, controls and stability."""
    source, weights = frozen_weights(spark, sf_dir)
    policy_rows, policies = locked(spark, sf_dir)
    test = evidenced(spark, sf_dir, "test")
    report = stage(policy.policy_report(test, policies, label="label", **NAMES), "report")
    edges = matching.risk_bin_edges(policy_rows.filter("alert"), "risk", BINS)
    counts = {r["coverage_budget"]: r["selected_count"] for r in report.select("coverage_budget", "selected_count").collect()}
    per_budget = None
    for p in policies:
        if p.abstain:
            continue
        marked = marked_alerts(test, p.method, counts[p.coverage])
        boot = resample.paired_block_bootstrap(
            marked, block=F.to_date("event_time"), label="label", selected="selected", baseline="baseline", replicates=REPLICATES
        )
        pairs = matching.match_in_cells(
            marked, selected="selected", risk="risk", evidence=p.method, row_id="txn_id", edges=edges, caliper=CALIPER, carry=["label"]
        )
        summary = stage(matching.matched_summary(pairs), "matched")
        interval = resample.pair_difference_interval(summary, replicates=REPLICATES).select(
            F.col("ci_low").alias("matched_ci_low"), F.col("ci_high").alias("matched_ci_high")
        )
        residual = matching.residual_summary(
            matching.residual_by_bin(marked, label="label", risk="risk", evidence=p.method, edges=edges)
        ).select("risk_conditioned_tp_fp_gap")
        row = with_constants(with_constants(boot, summary.select("matched_pairs")), interval)
        row = with_constants(row, residual).withColumn("coverage_budget", F.lit(float(p.coverage)))
        per_budget = row if per_budget is None else per_budget.unionByName(row)
    if per_budget is None:
        per_budget = spark.createDataFrame(
            [], "coverage_budget double, ci_low double, ci_high double, valid_iterations bigint, matched_pairs bigint, "
            "matched_ci_low double, matched_ci_high double, risk_conditioned_tp_fp_gap double")
    shuffled = variant_reports(spark, sf_dir, {n: (w, METHODS) for n, w in shuffled_weights(spark, sf_dir).items()})
    stability = resample.policy_stability(
        policy_rows, ALL_METHODS, COVERAGES, RAILS, label="label", seeds=STABILITY_SEEDS, **NAMES
    )
    negative = controls.control_summary(controls.negative_controls(test, policies, label="label", **NAMES))
    key = ["coverage_budget"]
    joined = joins.synthesis(
        report,
        (stage(per_budget, "budget"), key, "1:1"),
        (stage(negative, "negative"), key, "1:1"),
        (stage(controls.shuffled_summary(report, stage(shuffled, "shuffled")), "shuffled"), key, "1:1"),
        (stage(controls.stability_summary(stability), "stability"), key, "1:1"),
    )
    out = controls.conservative_outcome(joined)
    return out.select(
        "coverage_budget", "method", "abstain", "selected_count", "delta_vs_score_only", "ci_low", "ci_high", "matched_pairs",
        "risk_conditioned_tp_fp_gap", "preliminary_outcome", "outcome", "shuffled_blockers",
    )
