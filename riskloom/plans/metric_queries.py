"""Ranking, calibration and threshold metrics of the frozen score."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import contracts, metrics, scoring
from riskloom.plans import binding
from riskloom.plans.binding import ALERT_THRESHOLD
from riskloom.plans.oracle import settled_sql, sql
from riskloom.plans.registry import query
from riskloom.session import stage, with_constants

TEST = """
  s as materialized (select txn_id, label as y, risk as p, alert from roled where role = 'test')"""
CURVE = """
  cells as (select p, sum(y) as pos, sum(1 - y) as neg from s group by 1),
  curve as materialized (select p, pos, neg, sum(pos) over (order by p desc) as tp, sum(neg) over (order by p desc) as fp,
    sum(pos) over () as np, sum(neg) over () as nn from cells),
  rank_m as materialized (select sum(pos * tp / (tp + fp)) / any_value(np) as pr_auc,
    sum(pos * (nn - fp + neg / 2)) / any_value(np) / any_value(nn) as roc_auc,
    coalesce(max(case when fp / nn <= 0.01::double + 1e-12 then tp / np end), 0) as recall_at_fpr from curve)"""
CLIPPED = "greatest(1e-7, least(1 - 1e-7, p))"
DECISION = f"""
  d as (select count(*) as n, sum(y) as np, sum((p >= {ALERT_THRESHOLD} and y = 1)::int) as tp,
    sum((p >= {ALERT_THRESHOLD} and y = 0)::int) as fp, avg((p - y) * (p - y)) as brier,
    avg(-(y * ln({CLIPPED}) + (1 - y) * ln(1 - {CLIPPED}))) as nll from s)"""
ECE = """
  b as (select least(floor(p * 15), 14)::int as bin, count(*) as n, avg(y) as o, avg(p) as m from s group by 1),
  e as (select sum(n * abs(o - m)) / sum(n) as ece from b)"""
DECISION_COLUMNS = """n as n_rows, np::bigint as n_positive, round(np / n, 6) as prevalence, round(tp / nullif(tp + fp, 0), 6) as "precision",
    round(tp / nullif(np, 0), 6) as recall, round(2 * tp / (np + tp + fp), 6) as f1, round(5 * tp / (4 * np + tp + fp), 6) as f_beta,
    round(brier, 6) as brier, round(nll, 6) as nll, round((tp + fp) / n, 6) as predicted_positive_rate"""


# Scores are told apart by ten decimals: exp() differs by engine in the last place, so equal sums written in another order would tie in one only.
TIED = f"""
  s as materialized (select label as y, {settled_sql('risk')} as p from roled where role = 'test')"""


def _test(spark, sf_dir):
    return binding.audit(spark, sf_dir).part("test")


def _tied(spark, sf_dir):
    return _test(spark, sf_dir).withColumn("risk", binding.settled("risk"))


@query("binary_metrics", sql("roled", f"select {DECISION_COLUMNS} from d", TEST, DECISION))
def binary_metrics(spark, sf_dir):
    return metrics.threshold_metrics(_test(spark, sf_dir), "label", "risk", ALERT_THRESHOLD)


@query(
    "ece_bins",
    sql("roled", "select bin, n, round(o, 6) as observed, round(m, 6) as predicted, round(ece, 6) as ece from b, e", TEST, ECE),
)
def ece_bins(spark, sf_dir):
    rows = _test(spark, sf_dir)
    bins = metrics.calibration_bins(rows, "label", "risk")
    return with_constants(bins, metrics.calibration_error(rows, "label", "risk"))


@query(
    "pr_auc",
    sql("roled", """select sum(y)::bigint as positives, sum(1 - y)::bigint as negatives, round(any_value(pr_auc), 6) as pr_auc,
      round(any_value(roc_auc), 6) as roc_auc, round(any_value(recall_at_fpr), 6) as recall_at_fpr from s, rank_m""", TEST, CURVE),
)
def pr_auc(spark, sf_dir):
    return metrics.ranking_metrics(metrics.score_cells(_test(spark, sf_dir), "risk", "label"))


@query(
    "pr_curve",
    sql("roled", """select round(p, 6) as threshold, round(tp / (tp + fp), 6) as "precision", round(tp / np, 6) as recall
      from curve""", TIED, CURVE),
)
def pr_curve(spark, sf_dir):
    """Precision and recall at every distinct score; scores are distinct from the tenth decimal on."""
    curve = metrics.pr_curve(metrics.score_cells(_tied(spark, sf_dir), "risk", "label"))
    return curve.withColumns({c: binding.sixth(c) for c in ("threshold", "precision", "recall")})


@query(
    "recall_at_fpr",
    sql("roled", """, c as (select role, risk as p, sum(label) as pos, sum(1 - label) as neg from roled group by 1, 2),
      u as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by role) as np,
        sum(neg) over (partition by role) as nn from c window w as (partition by role order by p desc))
      select role, np::bigint as positives, nn::bigint as negatives, round(sum(pos * tp / (tp + fp)) / np, 6) as pr_auc,
        round(sum(pos * (nn - fp + neg / 2)) / np / nn, 6) as roc_auc,
        round(coalesce(max(case when fp / nn <= 0.05::double + 1e-12 then tp / np end), 0), 6) as recall_at_fpr
      from u group by role, np, nn"""),
)
def recall_at_fpr(spark, sf_dir):
    """Ranking metrics of every role at a 5 % false-positive rate."""
    cells = metrics.score_cells(binding.audit(spark, sf_dir).rows, "risk", "label", partition=["role"])
    return metrics.ranking_metrics(cells, partition=["role"], target_fpr=0.05)


@query(
    "prediction_report",
    sql("roled", f"""select {DECISION_COLUMNS}, round(pr_auc, 6) as pr_auc, round(roc_auc, 6) as roc_auc,
      round(recall_at_fpr, 6) as recall_at_fpr, round(ece, 6) as ece, round(np / n, 6) as null_prevalence,
      round(np / n, 6) as null_pr_auc, 0.5::double as null_roc_auc, round(5 * np / (5 * np + n - np), 6) as null_f_beta,
      round(np / n, 6) as null_precision, 1.0::double as null_recall, 0.0::double as null_recall_at_fpr,
      round(np / n * (1 - np / n), 6) as null_brier, 0.0::double as null_ece,
      round(-(np / n * ln(np / n) + (1 - np / n) * ln(1 - np / n)), 6) as null_nll,
      round(pr_auc - np / n, 6) as pr_auc_lift_over_null,
      round(5 * tp / (4 * np + tp + fp) - 5 * np / (5 * np + n - np), 6) as f_beta_lift_over_null,
      round(np / n * (1 - np / n) - brier, 6) as brier_improvement_over_null,
      round(-(np / n * ln(np / n) + (1 - np / n) * ln(1 - np / n)) - nll, 6) as nll_improvement_over_null
      from d, rank_m, e""", TEST, CURVE, DECISION, ECE),
)
def prediction_report(spark, sf_dir):
    """Every metric of the frozen score on test rows, with null baselines."""
    return metrics.prediction_report(_test(spark, sf_dir), "label", "risk", ALERT_THRESHOLD)


@query(
    "confusion_counts",
    sql("roled", """select sum((alert and y = 1)::int)::bigint as tp, sum((alert and y = 0)::int)::bigint as fp,
      sum((not alert and y = 1)::int)::bigint as fn, sum((not alert and y = 0)::int)::bigint as tn from s""", TEST),
)
def confusion_counts(spark, sf_dir):
    return metrics.confusion_counts(_test(spark, sf_dir), "label", F.col("alert"))


@query(
    "reliability_curve",
    sql("roled", """select bin, count(*) as n, round(avg(y), 6) as observed, round(avg(p), 6) as predicted
      from (select y, p, len(list_filter(q, lambda t: p >= t))::int as bin from s,
        (select quantile_cont(p, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) as q from s)) group by 1""", TEST),
)
def reliability_curve(spark, sf_dir):
    return metrics.reliability_curve(_test(spark, sf_dir), "label", "risk")


GRID = """
  g as (select distinct t from (select unnest(quantile_cont(p, [{levels}])) as t from s
    union all select 0.0 union all select 1.0)),
  sweep as (select g.t, tp, fp from g asof left join curve on curve.p >= g.t)""".format(
    levels=", ".join(f"{i}/500.0" for i in range(501))
)


# The quantile written out: of two equal neighbours it is exactly their value, which quantile_cont misses by a last place.
EXACT_GRID = f"""
  held as materialized (select p, sum(pos + neg) over (order by p) as upto, sum(pos + neg) over () as n from curve),
  spots as materialized (select distinct floor(x)::bigint as low, least(floor(x) + 1, n - 1)::bigint as high, x - floor(x) as part
    from (select any_value(n) as n, unnest([{", ".join(f"(any_value(n) - 1) * {i / 500!r}::double" for i in range(501))}]) as x from held)),
  g as (select distinct t from (select a.p + (b.p - a.p) * part as t from spots asof join held a on low < a.upto asof join held b on high < b.upto
    union all select 0.0::double union all select 1.0::double)),
  sweep as (select g.t, tp, fp from g asof left join curve on curve.p >= g.t)"""


@query(
    "threshold_sweep",
    sql("roled", """select round(t, 6) as threshold, max(coalesce(tp, 0))::bigint as tp, max(coalesce(fp, 0))::bigint as fp
      from sweep group by t""", TIED, CURVE, EXACT_GRID),
)
def threshold_sweep(spark, sf_dir):
    """True and false positives at every candidate threshold: 0, 1 and the scores' 501 quantiles; scores have ten decimals."""
    rows = metrics.threshold_counts(_tied(spark, sf_dir), "label", "risk")
    return spark.createDataFrame(rows, "threshold double, tp bigint, fp bigint")


@query(
    "selected_threshold",
    sql("roled", """select round(best.t, 6) as threshold, round(best.s, 6) as f_beta from (
        select list_reduce(list_prepend({'t': 0.5::double, 's': -1e308::double}, list({'t': t::double, 's': v::double} order by t)),
          lambda a, x: case when x.s > a.s or (a.s > -1e300 and abs(x.s - a.s) <= 1e-8 + 1e-5 * abs(a.s) and x.t > a.t) then x else a end) as best
        from (select t, coalesce(5.0 * tp / nullif(5.0 * tp + 4.0 * (np - tp) + fp, 0), 0) as v
          from (select t, max(coalesce(tp, 0)) as tp, max(coalesce(fp, 0)) as fp from sweep group by t), (select sum(y) as np from s)))""",
        TEST.replace("'test'", "'calibration_select'"), CURVE, GRID),
)
def selected_threshold(spark, sf_dir):
    """The threshold with the best F2 on the calibration-selection rows."""
    rows = binding.audit(spark, sf_dir).part("calibration_select")
    threshold, score = metrics.select_threshold(rows, "label", "risk")
    return spark.createDataFrame([(threshold, score)], "threshold double, f_beta double")


@query(
    "rank_fidelity",
    sql("truth", """, l as (select 'high_amount' as method, rule__high_amount as v, risk as p, alert from truth where role = 'test'
          union all select 'busy_sender', rule__busy_sender, risk, alert from truth where role = 'test'),
        a as (select method, v, alert::int as y, rank() over (partition by method order by v)
            + (count(*) over (partition by method, v) - 1) / 2.0 as r from l),
        c as (select method, rank() over (partition by method order by v) + (count(*) over (partition by method, v) - 1) / 2.0 as x,
          rank() over (partition by method order by p) + (count(*) over (partition by method, p) - 1) / 2.0 as z from l where alert)
      select method, round((sum(r * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) as positive_region_fidelity,
        round((select corr(x, z) from c where c.method = a.method), 6) as alert_conditional_rank_fidelity from a group by 1"""),
)
def rank_fidelity(spark, sf_dir):
    """How evidence ranks alerts, and how it follows risk among them."""
    from riskloom.operators.policy import method_fidelity

    rows = _test(spark, sf_dir).select(
        F.col("rule__high_amount").alias("high_amount"), F.col("rule__busy_sender").alias("busy_sender"), "risk", "alert"
    )
    return method_fidelity(rows, ["high_amount", "busy_sender"], risk="risk", alert="alert")


FOLD = "('0x' || substr(md5(txn_id), 1, 2))::int % 5"


@query(
    "seed_summary",
    sql("roled", f""", f as (select split, {FOLD} as seed, label as y, risk as p from roled where split <> 'train'),
        c as (select split, seed, p, sum(y) as pos, sum(1 - y) as neg from f group by 1, 2, 3),
        u as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by split, seed) as np
          from c window w as (partition by split, seed order by p desc)),
        m as (select split, seed, sum(pos * tp / (tp + fp)) / any_value(np) as pr_auc from u group by 1, 2)
      select split, count(distinct seed) as seeds, round(avg(pr_auc), 6) as pr_auc_mean, round(stddev_samp(pr_auc), 6) as pr_auc_std
      from m group by 1"""),
)
def seed_summary(spark, sf_dir):
    """Mean and deviation of PR-AUC over five hashed folds."""
    return scoring.seed_summary(_fold_metrics(spark, sf_dir), ["split"], ["pr_auc"])


def _fold_metrics(spark, sf_dir):
    rows = binding.audit(spark, sf_dir).rows.filter("split <> 'train'")
    fold = F.pmod(F.conv(F.substring(F.md5("txn_id"), 1, 2), 16, 10).cast("int"), F.lit(5))
    cells = metrics.score_cells(rows.withColumn("seed", fold), "risk", "label", partition=["split", "seed"])
    return metrics.ranking_metrics(cells, partition=["split", "seed"])


@query(
    "split_gap",
    sql("roled", f""", f as (select split, {FOLD} as seed, label as y, risk as p from roled where split <> 'train'),
        c as (select split, seed, p, sum(y) as pos, sum(1 - y) as neg from f group by 1, 2, 3),
        u as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by split, seed) as np
          from c window w as (partition by split, seed order by p desc)),
        m as (select split, seed, sum(pos * tp / (tp + fp)) / any_value(np) as v from u group by 1, 2)
      select a.seed::int as seed, round(a.v, 6) as validation, round(b.v, 6) as test, round(b.v - a.v, 6) as gap
      from m a join m b on a.seed = b.seed where a.split = 'validation' and b.split = 'test'"""),
)
def split_gap(spark, sf_dir):
    return scoring.split_gap(_fold_metrics(spark, sf_dir), ["seed"], "pr_auc")


@query(
    "contract_violations",
    sql("truth", """select contract, violations from (
      select 'binary:label' as contract, sum((label not in (0, 1))::int)::bigint as violations from truth
      union all select 'binary:l_linenumber', (select sum((l_linenumber not in (0, 1))::int)::bigint from lineitem)
      union all select 'unit_interval:risk', sum((risk < 0 or risk > 1)::int)::bigint from truth
      union all select 'unit_interval:amount_paid', sum((amount_paid < 0 or amount_paid > 1)::int)::bigint from truth
      union all select 'not_null:sender_seconds_since_previous', sum((sender_seconds_since_previous is null)::int)::bigint from truth
      union all select 'subset:label<=alert', sum((label = 1 and not alert)::int)::bigint from truth)"""),
)
def contract_violations(spark, sf_dir):
    """Violations of binary, unit-interval, null and subset contracts."""
    rows = binding.audit(spark, sf_dir).rows
    lines = binding.table(spark, sf_dir, "lineitem")
    found = contracts.contract_violations(
        rows, binary=["label"], unit_interval=["risk", "amount_paid"], not_null=["sender_seconds_since_previous"],
        subset={"label": "alert"},
    )
    return found.unionByName(contracts.contract_violations(lines, binary=["l_linenumber"]))


@query("calibrated_scores")
def calibrated_scores(spark, sf_dir):
    """Calibrators fitted on one validation quarter and compared on the next."""
    audit = binding.audit(spark, sf_dir)
    fit, select = (stage(audit.part(r).select("risk", "label"), r) for r in ("calibration_fit", "calibration_select"))
    _, table = scoring.compare_calibrators(fit, select, "risk", "label")
    return table.withColumn("selected", F.col("method") == scoring.best_method(table))
