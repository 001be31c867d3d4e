import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import attribution, audit, contrastive, controls, evidence, matching, policy, quality, resample
from riskloom.session import stage

NAMES = {"risk": "risk", "alert": "alert", "row_id": "id"}


def audited_rows(spark):
    strong = [0.9, 0.8, 0.9, 0.7, 0.1, 0.2, 0.1, 0.65]
    weak = [0.1, 0.9, 0.2, 0.8, 0.9, 0.1, 0.7, 0.2]
    y = [1, 1, 1, 1, 0, 0, 0, 0]
    rows = [(role, True, s, s, w, a) for role in ("train", "audit") for s, w, a in zip(strong, weak, y)]
    return spark.createDataFrame(rows, "part string, alert boolean, rule__strong double, rule__copy double, rule__weak double, y int")


TRUTHS = {n: f"rule__{n}" for n in ("strong", "copy", "weak")}


def run_audit(spark, **limits):
    rows = audited_rows(spark)
    stats = audit.alert_statistics(rows, TRUTHS, "y", "alert", "part")
    table = audit.audit_rules(stats, part="part", train="train", audit="audit", criteria={"min_active_count": 1, **limits})
    histogram = quality.pattern_histogram(rows.filter("part = 'audit'"), list(TRUTHS.values()), [0.6], "y", F.lit(True))
    return stage(table, "t"), stage(quality.rule_overlap(histogram, list(TRUTHS)), "o")


def test_one_of_two_equal_rules_is_kept(spark):
    table, overlap = run_audit(spark)
    done = {r["rule"]: r for r in audit.remove_redundant(table, overlap).collect()}
    assert sorted(r for r in ("strong", "copy") if done[r]["selected"]) == ["copy"]
    assert done["strong"]["selection_status"] == "redundant" and done["strong"]["redundant_with"] == "copy"
    assert done["strong"]["max_jaccard_with_selected"] == 1.0
    weights = audit.rule_weights(audit.remove_redundant(table, overlap)).collect()
    assert sum(r["audit_weight"] for r in weights) == pytest.approx(1.0)
    assert sum(r["fp_penalized_weight"] for r in weights) == pytest.approx(1.0)


def test_audit_score_and_failures(spark):
    table, _ = run_audit(spark)
    got = {r["rule"]: r for r in table.collect()}
    s = got["strong"]
    # 5 of 8 active, 4 true: precision .8, base .5, lift 1.6, tp activation 1, fp activation .25
    import math

    assert s["audit_alert_score"] == pytest.approx(0.3 * 0.3 + 0.25 * 0.75 + 0.15 * math.log(1.6) - 0.1 * 0.25)
    assert s["audit_pass"] and s["audit_failures"] == ""
    strict, _ = run_audit(spark, min_active_count=6, max_fp_activation=0.2)
    text = {r["rule"]: r["audit_failures"] for r in strict.collect()}["strong"]
    assert text == "audit_alert_active_count;audit_alert_fp_activation"
    hits, _ = run_audit(spark, min_attribution_hit_rate=0.5)
    assert {r["rule"]: r["audit_failures"] for r in hits.collect()}["strong"] == "audit_alert_attribution_hit_rate"


def test_one_class_alerts_fail(spark):
    rows = audited_rows(spark).withColumn("y", F.when(F.col("part") == "audit", 1).otherwise(F.col("y")))
    stats = audit.alert_statistics(rows, TRUTHS, "y", "alert", "part", auc=False)
    table = audit.audit_rules(stats, part="part", train="train", audit="audit")
    assert all("audit_alert_one_class" in r["audit_failures"] for r in table.collect())


def test_greedy_decisions_and_pools():
    scores = [("b", True, 0.9), ("a1", True, 0.5), ("a2", True, 0.4), ("bad", False, 2.0)]
    overlap = {("a1", "a2"): 0.1, ("a1", "b"): 0.2, ("a2", "b"): 0.9}
    got = {d.rule: d.status for d in audit.greedy_decisions(scores, overlap, max_rules=2)}
    assert got == {"b": "selected", "a1": "selected", "a2": "redundant", "bad": "audit_failed"}
    pool = audit.greedy_decisions([s for s in scores if s[0].startswith("a")], overlap, max_rules=2)
    assert [d.status for d in pool] == ["selected", "selected"]
    full = audit.greedy_decisions(scores, {k: 0.0 for k in overlap}, max_rules=2)
    assert {d.rule: d.status for d in full}["a2"] == "rule_budget_exceeded"


def test_evidence_is_bounded_and_needs_support(spark):
    weights = audit.Weights({"strong": 0.7, "weak": 0.3}, {"strong": 0.9, "weak": 0.1})
    shares = {"strong": F.lit(2.0), "weak": F.lit(0.5)}
    rows = audited_rows(spark).filter("part = 'audit'")
    columns = evidence.evidence_columns(TRUTHS, weights, ["unweighted", "audit_weighted", "fp_penalized", "attribution_gated"], shares=shares)
    out = rows.withColumns(columns).collect()
    for r in out:
        on = max(r["rule__strong"], r["rule__weak"]) >= 0.6
        assert r["audit_weighted"] == pytest.approx(0.7 * r["rule__strong"] + 0.3 * r["rule__weak"] if on else 0.0)
        assert r["attribution_gated"] == pytest.approx(0.9 * r["rule__strong"] + 0.05 * r["rule__weak"] if on else 0.0)
    with pytest.raises(ValueError):
        evidence.evidence_score(TRUTHS, weights, "attribution_gated")
    with pytest.raises(ValueError):
        evidence.guarded_ensemble(["a", "a"])
    df = spark.createDataFrame([(0.45, 0.0, 0.3), (0.8, 0.2, 0.65)], "a double, b double, c double")
    assert [r[0] for r in df.select(evidence.guarded_ensemble(["a", "b", "c"])).collect()] == pytest.approx([0.25, 0.55])


def test_positive_top_effects(spark):
    df = spark.createDataFrame(
        [(0.5, 2.0, -1.5, 0.25), (-3.0, -2.0, 1.0, -0.5), (6.0, 5.0, 4.0, 3.0)], ", ".join(f"f{i} double" for i in range(4)))
    got = [r[0] for r in df.select(attribution.positive_top_effects({f"f{i}": F.col(f"f{i}") for i in range(4)}, 3)).collect()]
    # by size: 2, -1.5, .5 | -3, -2, 1 | 6, 5, 4
    assert got == pytest.approx([2.5, 1.0, 15.0])


def alerts_of(spark, rows):
    return stage(spark.createDataFrame(rows, "id string, y int, risk double, ev double").withColumn("alert", F.col("risk") >= 0.5), "a")


def test_budget_counts():
    assert policy.budget_count(37, 0.2) == 8 and policy.budget_count(3, 0.01) == 1 and policy.budget_count(0, 0.5) == 0
    with pytest.raises(ValueError):
        policy.budget_count(10, 0.0)


def test_underfilled_budget_keeps_equal_comparator(spark):
    rows = [(f"r{i}", i % 2, 0.99 - i / 50, 0.3 + i / 40 if i in (4, 7, 11) else 0.0) for i in range(20)]
    df = alerts_of(spark, rows)
    got = policy.policy_candidates(df, ["ev"], [0.35], label="y", **NAMES).first()
    assert (got["requested_selected_count"], got["selected_count"], got["score_only_selected_count"]) == (7, 3, 3)
    assert got["support_shift_underfill"] and got["supported_alert_count"] == 3
    locked = policy.LockedPolicy(0.35, "ev", False, "", 0, 0, None, None, None, None, None, 0.0)
    report = policy.policy_report(df, [locked], label="y", **NAMES).first()
    assert (report["selected_count"], report["requested_selected_count"]) == (3, 7)
    assert report["explanation_coverage"] == pytest.approx(3 / 20) and report["abstention_rate"] == pytest.approx(17 / 20)


def test_selection_reads_no_labels(spark):
    rng = random.Random(1)
    rows = [(f"r{i}", rng.randint(0, 1), 0.5 + rng.random() / 2, rng.choice([0.0, 0.2, 0.4])) for i in range(100)]
    locked = policy.LockedPolicy(0.25, "ev", False, "", 0, 0, None, None, None, None, None, 0.0)
    picks = []
    for flip in (False, True):
        df = alerts_of(spark, [(i, 1 - y if flip else y, r, e) for i, y, r, e in rows])
        picks.append(sorted(r["id"] for r in policy.apply_policies(df, [locked], **NAMES).collect()))
    from hashlib import md5

    wanted = sorted((r for r in rows if r[3] > 0), key=lambda r: (-r[3], -r[2], md5(r[0].encode()).hexdigest()))[:25]
    assert picks[0] == picks[1] == sorted(r[0] for r in wanted)


def test_evidence_equal_to_risk_abstains(spark):
    rng = random.Random(2)
    rows = [(f"r{i}", rng.randint(0, 1), r, r) for i in range(60) for r in [0.5 + rng.random() / 2]]
    candidates = policy.policy_candidates(alerts_of(spark, rows), ["ev"], [0.25], label="y", **NAMES)
    (locked,) = policy.lock_policies(candidates, policy.Guardrails())
    assert locked.abstain and locked.reason == "no_method_beats_score_only_guardrail" and locked.method is None
    reasons = policy.with_eligibility(candidates, policy.Guardrails()).first()["ineligible_reasons"]
    assert "score_only_guardrail_not_met" in reasons


def test_no_alerts_abstains(spark):
    candidates = policy.policy_candidates(alerts_of(spark, [("a", 1, 0.1, 0.2), ("b", 0, 0.2, 0.1)]), ["ev"], [0.5], label="y", **NAMES)
    (locked,) = policy.lock_policies(candidates, policy.Guardrails())
    assert locked.reason == "no_validation_alerts"


def test_policy_table_round_trip(spark):
    p = policy.LockedPolicy(0.5, None, True, "x", 3, 0, 0.5, None, None, None, None, 0.0)
    assert policy.policies_from_table(policy.policy_table(spark, [p])) == [p]


def test_weighted_candidates_equal_repeated_rows(spark):
    rng = random.Random(4)
    rows = [(f"r{i}", rng.randint(0, 1), 0.5 + rng.random() / 2, rng.random()) for i in range(40)]
    weights = {r[0]: rng.randint(0, 3) for r in rows}
    weighted = alerts_of(spark, rows).withColumn("w", F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])[F.col("id")])
    repeated = alerts_of(spark, [(f"{r[0]}#{k}", *r[1:]) for r in rows for k in range(weights[r[0]])])
    a = policy.policy_candidates(stage(weighted, "w"), ["ev"], [0.1, 0.5], label="y", weight="w", fidelity=False, **NAMES)
    b = policy.policy_candidates(repeated, ["ev"], [0.1, 0.5], label="y", fidelity=False, **NAMES)
    for x, z in zip(a.orderBy("coverage").collect(), b.orderBy("coverage").collect()):
        # Sums of doubles may differ in the last place.
        assert {k: round(v, 9) if isinstance(v, float) else v for k, v in x.asDict().items()} == {
            k: round(v, 9) if isinstance(v, float) else v for k, v in z.asDict().items()}


def match_df(spark, rows):
    return spark.createDataFrame(rows, "id string, chosen boolean, risk double, ev double")


def test_cell_matching_hand_case(spark):
    rows = [("a", True, 0.605, 0.9), ("b", True, 0.61, 0.1), ("c", False, 0.612, 0.0), ("d", True, 0.659, 0.5), ("e", False, 0.661, 0.3), ("f", True, 0.9, 0.2), ("g", False, 0.95, 0.2)]
    pairs = {r["selected_id"]: r for r in matching.match_in_cells(
        match_df(spark, rows), selected="chosen", risk="risk", evidence="ev", row_id="id", edges=[0.8], caliper=0.02).collect()}
    # a is stronger than b, so it gets c; d and e stand at both sides of a cell's edge and meet in the shifted cells.
    assert {k: r["control_id"] for k, r in pairs.items()} == {"a": "c", "b": None, "d": "e", "f": None}
    assert pairs["b"]["nearest_gap"] == pytest.approx(0.002) and pairs["f"]["nearest_gap"] == pytest.approx(0.05) and pairs["a"]["nearest_gap"] is None
    free = matching.match_in_cells(match_df(spark, rows), selected="chosen", risk="risk", evidence="ev", row_id="id", edges=[0.8], caliper=None)
    assert {r["selected_id"]: r["control_id"] for r in free.collect()} == {"a": "c", "b": None, "d": "e", "f": "g"}


def test_matching_refuses_missing_values(spark):
    for risk, ev in ((None, 0.1), (float("nan"), 0.1), (0.5, None)):
        with pytest.raises(ValueError, match="before matching"):
            matching.match_in_cells(match_df(spark, [("a", True, risk, ev), ("b", False, 0.5, 0.5)]), selected="chosen", risk="risk", evidence="ev", row_id="id", edges=[0.7], caliper=0.02)


def test_cell_matching_keeps_every_selected_row(spark):
    rng = random.Random(9)
    rows = [(f"i{k}", k % 3 == 0, round(0.5 + rng.random() / 2, 3), rng.random()) for k in range(200)]
    pairs = matching.match_in_cells(match_df(spark, rows), selected="chosen", risk="risk", evidence="ev", row_id="id", edges=[0.7], caliper=0.05).collect()
    assert len(pairs) == sum(r[1] for r in rows)
    used = [r["control_id"] for r in pairs if r["matched"]]
    assert len(used) == len(set(used)) and all(r["absolute_risk_gap"] <= 0.05 for r in pairs if r["matched"])


def test_residual_gap_hand_case(spark):
    # below .7: true .6, false .1 and .3; from .7 to .8: true .4 and .6, false .2; above: one true row
    rows = [(1, 0.55, 0.6), (0, 0.6, 0.1), (0, 0.65, 0.3), (1, 0.7, 0.4), (1, 0.72, 0.6), (0, 0.79, 0.2), (1, 0.9, 0.2)]
    df = spark.createDataFrame(rows, "y int, risk double, ev double")
    per = matching.residual_by_bin(df, label="y", risk="risk", evidence="ev", edges=[0.7, 0.8])
    got = matching.residual_summary(per).first()
    assert got["comparable_bins"] == 2 and got["comparison_weight"] == 2
    assert got["risk_conditioned_tp_fp_gap"] == pytest.approx((0.4 + 0.3) / 2)


def test_risk_bin_edges_are_checked(spark):
    with pytest.raises(ValueError):
        matching.risk_bin(F.lit(0.5), [0.3, 0.3])


def test_contrastive_guards_and_fit(spark):
    rng = random.Random(11)
    rows = []
    for k in range(60):
        y = k % 2
        rows.append((y, 0.5 + rng.random() / 2, min(1.0, max(0.0, 0.3 + 0.5 * y + rng.uniform(-0.3, 0.3)))))
    df = spark.createDataFrame(rows, "y int, risk double, rule__r double").withColumn("alert", F.col("risk") >= 0.5)
    kwargs = {"label": "y", "risk": "risk", "alert": "alert"}
    truths = {"r": "rule__r"}
    model = contrastive.fit_contrastive(df, truths, ["r"], **kwargs)
    again = contrastive.fit_contrastive(df.unionByName(df.withColumn("risk", F.lit(0.1)).withColumn("alert", F.lit(False))), truths, ["r"], **kwargs)
    assert model.available and model.coefficients["r"] > 0
    assert again.coefficients["r"] == pytest.approx(model.coefficients["r"], abs=1e-6)
    out = df.select("rule__r", model.evidence(truths, "risk").alias("e")).collect()
    assert all((r["e"] > 0) == (r["rule__r"] >= 0.6) for r in out)
    assert contrastive.fit_contrastive(df, truths, [], **kwargs).reason == "no_audited_rules"
    assert contrastive.fit_contrastive(df.limit(5), truths, ["r"], **kwargs).reason == "insufficient_predictor_alerts"
    assert contrastive.fit_contrastive(df.withColumn("y", F.lit(1)), truths, ["r"], **kwargs).reason == "insufficient_tp_or_fp_alerts"
    flat = df.withColumn("rule__r", F.lit(0.9))
    assert contrastive.fit_contrastive(flat, truths, ["r"], **kwargs).reason == "non_varying_rule_evidence_among_alerts"
    low = df.withColumn("rule__r", F.col("rule__r") / 10)
    assert contrastive.fit_contrastive(low, truths, ["r"], **kwargs).reason == "no_active_rule_support_among_alerts"
    still = df.withColumn("risk", F.lit(0.7))
    assert contrastive.fit_contrastive(still, truths, ["r"], **kwargs).reason == "non_varying_frozen_risk_among_alerts"


def test_bootstrap_edges(spark):
    df = spark.createDataFrame([(1, False, False), (0, False, True)], "y int, alert boolean, on boolean")
    got = resample.precision_gain_interval(df, label="y", alert="alert", explained="on", replicates=20).first()
    assert got["valid_iterations"] == 0 and got["ci_low"] is None


def test_block_bootstrap_of_equal_selections_is_zero(spark):
    df = spark.range(100).select(
        (F.col("id") % 10).alias("day"), (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 2 == 0).alias("s"))
    got = resample.paired_block_bootstrap(df, block=F.col("day"), label="y", selected="s", baseline="s", replicates=50).first()
    assert got["observed_difference"] == 0 and got["ci_low"] == 0 and got["ci_high"] == 0 and got["valid_iterations"] == 50


def test_permutation_moves_every_value_once(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("id"), F.col("id").cast("double").alias("v"))
    out = resample.permute_column(df, "v", "id", 7, "p").collect()
    assert sorted(r["p"] for r in out) == [float(i) for i in range(200)]
    assert sum(float(r["id"]) == r["p"] for r in out) < 20


def test_resample_weights_have_poisson_moments(spark):
    row = spark.range(20000).select(resample.resample_weight("id", 1).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert row[0] == pytest.approx(1.0, abs=0.05) and row[1] == pytest.approx(1.0, abs=0.08)


def test_negative_controls_select_equal_counts(spark):
    rows = [(f"r{i}", i % 2, 0.9 - i / 100, 0.5 + i / 100 if i < 3 else 0.0) for i in range(6)]
    locked = policy.LockedPolicy(0.5, "ev", False, "", 0, 0, None, None, None, None, None, 0.0)
    got = controls.negative_controls(alerts_of(spark, rows), [locked], label="y", **NAMES).collect()
    assert len(got) == 4 and all(r["selected_count"] == 3 for r in got)
    summary = controls.control_summary(controls.negative_controls(alerts_of(spark, rows), [locked], label="y", **NAMES)).first()
    assert summary["control_count_fair"]


def test_negative_controls_write_no_ranking(spark, monkeypatch):
    written = []
    monkeypatch.setattr(controls, "stage", lambda df, label="table": written.append(label) or stage(df, label))
    rows = [(f"r{i}", i % 3 == 0, 0.5 + (i % 4) / 10, (i * 7 % 10) / 10) for i in range(40)]
    rows = [(i, int(y), r, e) for i, y, r, e in rows]
    locked = [policy.LockedPolicy(c, "ev", False, "", 0, 0, None, None, None, None, None, 0.0) for c in (0.1, 0.4, 1.0)]
    df = alerts_of(spark, rows)
    got = {(r["coverage_budget"], r["control"]): (r["selected_count"], r["selected_positive_count"]) for r in controls.negative_controls(df, locked, label="y", **NAMES).collect()}
    assert sorted(written) == ["alerts", "controls"]
    ranked = policy.ranked_alerts(df, ["ev"], label="y", **NAMES).collect()
    for coverage, count in ((0.1, 4), (0.4, 16), (1.0, 36)):
        for control, method in ((controls.LOCKED, "ev"), (controls.SCORE, policy.SCORE_ONLY)):
            top = [r["y"] for r in ranked if r["method"] == method and r["rank"] <= count]
            assert got[coverage, control] == (len(top), sum(top)) and len(top) == count


OUTCOME = {
    "abstain": False, "score_only_headroom": 0.4, "ci_low": 0.01, "ci_high": 0.1, "valid_iterations": 500, "matched_ci_low": 0.01,
    "matched_ci_high": 0.1, "matched_pairs": 50, "risk_conditioned_tp_fp_gap": 0.1, "control_count_fair": True,
    "control_locked_precision": 0.6, "control_score_precision": 0.5, "control_maximum_null_precision": 0.5,
    "shuffled_comparison_valid": True, "shuffled_below_primary": True, "shuffled_no_material_gain": True,
    "positive_stability_fraction": 0.9, "stability_max_delta": 0.01, "stability_all_abstain": False, "alert_positive_count": 40,
}


@pytest.mark.parametrize(
    "change, outcome",
    [
        ({}, "positive_incremental_evidence"),
        ({"matched_ci_low": -0.1}, "inconclusive_incremental_evidence"),
        ({"positive_stability_fraction": 0.5}, "inconclusive_incremental_evidence"),
        ({"control_count_fair": False}, "inconclusive_incremental_evidence"),
        ({"ci_low": -0.1}, "no_supported_incremental_evidence"),
        ({"abstain": True}, "guardrail_abstention"),
        ({"score_only_headroom": 0.01}, "low_score_only_headroom_unconfirmed"),
        ({"score_only_headroom": 0.01, "ci_high": 0.01, "matched_ci_high": 0.01, "risk_conditioned_tp_fp_gap": 0.01},
         "confirmed_score_only_saturation"),
        ({"score_only_headroom": 0.01, "ci_high": 0.01, "matched_ci_high": 0.01, "risk_conditioned_tp_fp_gap": 0.01, "abstain": True},
         "confirmed_saturation_with_abstention"),
        ({"score_only_headroom": 0.01, "ci_high": 0.01, "matched_ci_high": 0.01, "risk_conditioned_tp_fp_gap": 0.01, "matched_pairs": 3},
         "low_score_only_headroom_unconfirmed"),
    ],
)
def test_outcomes_fail_closed(spark, change, outcome):
    row = {**OUTCOME, **change}
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()])
    assert controls.conservative_outcome(df).first()["outcome"] == outcome


@pytest.mark.parametrize("heavy", [False, True])
def test_pr_auc_bootstrap_equals_brute_force(spark, monkeypatch, heavy):
    import numpy as np

    from riskloom.functions.hashing import MERSENNE_31, POISSON_1, replicate_coefficients

    monkeypatch.setattr(resample, "BUCKET_ROWS", 40)
    rng = random.Random(4)
    rows = [(f"r{k}", int(rng.random() < 0.3), round(rng.random(), 1 if k % 2 else 3), rng.random()) for k in range(300)]
    if heavy:
        # Half of all rows share one score, far more than a bucket takes; the other score is constant.
        rows = [(i, y, 0.4 if k % 2 else a, 1.0) for k, (i, y, a, _) in enumerate(rows)]
    df = spark.createDataFrame(rows, "id string, y int, a double, b double")
    got = resample.paired_pr_auc_bootstrap(df, label="y", first="a", second="b", row_id="id", replicates=20, seed=3).first()
    numbers = dict(tuple(r) for r in df.select("id", resample.row_number_31(F.col("id"))).collect())
    y = np.array([r[1] for r in rows])

    def area(score, w):
        w = w * np.where(y == 1, (y == 1).sum() / w[y == 1].sum(), (y == 0).sum() / w[y == 0].sum())
        total = 0.0
        for v in sorted(set(score), reverse=True):
            total += w[(score == v) & (y == 1)].sum() * w[(score >= v) & (y == 1)].sum() / max(w[score >= v].sum(), 1e-300)
        return total / (y == 1).sum()

    def difference(w):
        return area(np.array([r[2] for r in rows]), w) - area(np.array([r[3] for r in rows]), w)

    draws = []
    for r in range(20):
        m, c = replicate_coefficients(3, r)
        u = np.array([(numbers[row[0]] * m + c) % MERSENNE_31 for row in rows]) / MERSENNE_31
        draws.append(difference(np.searchsorted(POISSON_1, u, side="right").astype(float)))
    assert got["observed_difference"] == pytest.approx(difference(np.ones(300)))
    assert got["bootstrap_mean"] == pytest.approx(np.mean(draws)) and got["ci_low"] == pytest.approx(np.quantile(draws, 0.025))
    assert got["valid_iterations"] == 20


def test_newton_logistic_has_no_slope_left(spark):
    import numpy as np

    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1])))).astype(float)
    w = rng.uniform(0.5, 2, 300)
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.column_stack([x, y, w])], "a double, b double, y double, w double")
    design = [F.col("a"), F.col("b"), F.lit(1.0)]
    fit = contrastive.newton_logistic(df, design, F.col("y"), F.col("w"), [1.0, 1.0, 0.0], 50)
    full = np.column_stack([x, np.ones(300)])
    p = 1 / (1 + np.exp(-full @ fit))
    assert np.abs(full.T @ (w * (p - y)) + np.array([1, 1, 0]) * fit).max() < 1e-8
    assert contrastive.newton_logistic(df, design, F.col("y"), F.col("w"), [1.0, 1.0, 0.0], 2) is None


def test_replicates_in_one_pass_equal_one_at_a_time(spark):
    rng = random.Random(12)
    rows = [(f"t{i}", round(rng.random(), 2), rng.random() < 0.7, rng.randrange(2), round(max(0.0, rng.random() - 0.2), 1), round(rng.random(), 1), rng.randrange(4), rng.randrange(3)) for i in range(240)]
    df = stage(spark.createDataFrame(rows, "id string, risk double, alert boolean, y int, m1 double, m2 double, w0 int, w1 int"), "replicates")
    names = {"label": "y", "risk": "risk", "alert": "alert", "row_id": "id"}
    together = policy.replicate_candidates(df, ["m1", "m2"], [0.1, 0.5], ["w0", "w1"], **names).collect()
    for i in (0, 1):
        # rows repeated as often as their weight says
        repeated = df.where(f"w{i} > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col(f"w{i}"))))
        repeated = stage(repeated.withColumn("id", F.concat_ws("#", "id", "k")), "repeated")
        alone = {(r["method"], r["coverage"]): r for r in policy.policy_candidates(repeated, ["m1", "m2"], [0.1, 0.5], **names).collect()}
        mine = [r for r in together if r["replicate"] == i]
        assert len(mine) == 4
        for r in mine:
            other = alone[r["method"], r["coverage"]]
            for c in ("alert_count", "selected_count", "supported_alert_count", "evidence_cutoff", "evidence_tp_fp_gap", "positive_region_fidelity", "all_alert_precision"):
                assert r[c] == pytest.approx(other[c]), c


def test_survival_equals_repeated_alerts(spark):
    from riskloom.operators import quality, resample, survival

    rng = random.Random(13)
    rows = [(f"t{i}", rng.randrange(2), rng.random(), rng.random()) for i in range(200)]
    alerts = stage(spark.createDataFrame(rows, "id string, y int, rule__a double, rule__b double"), "alerts")
    truths, hit = {"a": "rule__a", "b": "rule__b"}, {"a": F.col("rule__b"), "b": F.lit(1.0)}
    patterns = survival.resampled_patterns(alerts, truths, hit, hit, label="y", row_id="id", seeds=[3, 4])
    for seed in (3, 4):
        drawn = alerts.withColumn("w", resample.resample_weight("id", seed)).where("w > 0")
        counts = {r["rule"]: r for r in quality.rule_counts(drawn, truths, "y", 0.6, weight="w").collect()}
        cells = [r for r in patterns.collect() if r["seed"] == seed]
        for k, rule in enumerate("ab"):
            on = [c for c in cells if c["pattern"][k] == "1"]
            assert sum(c["n"] for c in on) == counts[rule]["active"]
            assert sum(c["n"] for c in on if c["y"] == 1) == counts[rule]["active_positives"]
            assert sum(c["n"] for c in cells) == counts[rule]["rows"]
        rates = {r["rule"]: r for r in audit.attribution_rates(drawn, truths, hit, hit, weight=F.col("w")).collect()}
        on = [c for c in cells if c["pattern"][0] == "1"]
        assert sum(c["h"][0] for c in on) / sum(c["n"] for c in on) == pytest.approx(rates["a"]["hit_rate"])


def test_shuffled_labels_write_audit_rows_only(spark, tiny, monkeypatch):
    from riskloom.plans import policy_queries

    written = {}

    def kept(df, label="table"):
        written[label] = stage(df, label)
        return written[label]

    monkeypatch.setattr(policy_queries, "stage", kept)
    found = policy_queries.shuffled_weights(spark, tiny)
    before = policy_queries.binding.audit(spark, tiny).part("rule_audit")
    moved = written["relabelled"]
    assert set(found) == set(controls.SHUFFLED_CONTROLS)
    assert {r["role"] for r in moved.select("role").distinct().collect()} == {"rule_audit"}
    # The labels of alerts change places among themselves, those of other rows stay.
    count = lambda rows: sorted(map(tuple, rows.groupBy("alert", "label").count().collect()))
    assert count(moved) == count(before)
    quiet = [rows.filter("not alert").select("txn_id", "label") for rows in (moved, before)]
    assert quiet[0].exceptAll(quiet[1]).isEmpty()
