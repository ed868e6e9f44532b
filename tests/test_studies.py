"""Whole studies on the smallest tables."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from shiftlens.operators import gates, metrics, monitors
from shiftlens.plans import studies
from shiftlens.plans.views import Views

FOLDER = "/root/testdata/sf0.001"
SPEC = replace(
    gates.GATES["confirmatory"],
    bootstrap_samples=50,
    checks=(gates.check("effect", "target_effect", ">=", 0.2),),
)


@pytest.fixture(scope="module")
def views(spark):
    return Views(spark, FOLDER)


@pytest.fixture(scope="module")
def rollouts(views):
    return views.rollout_texts.filter(
        F.col("condition").isin("clean", "correct_continuation", "corrupted_continuation")
    )


def test_examples_to_report(views, rollouts):
    report = gates.gate_report(views.questions, rollouts, SPEC)
    found = studies.prepare_examples(views.questions, rollouts, report, SPEC, audit_cap=40)
    assert found.audit.count() == 40
    primary = found.primary.withColumn("label", F.col("binary_label"))
    audit = found.audit.withColumn("label", F.col("binary_label"))
    scores = monitors.local_component_scores(primary, audit, rollouts, seed=3)
    columns = ["example_id", "label", "family", "kind", "is_primary"]
    labels = primary.select(*columns).unionByName(audit.select(*columns))
    out = studies.evaluate_monitors(scores, labels, samples=20)
    table = studies.performance_table(out).collect()
    assert len(table) == 18
    for row in table:
        if row.component == "correctness_only" and row.metric == "auroc":
            assert row.point == 0.5
    assert out.operating_points.count() == 6
    assert {r.metric for r in out.paired.collect()} == {"auroc", "auprc", "false_positive_rate"}
    assert out.audit.filter("stratum = 'overall'").first().n == 40


def test_refused_gate_stops_the_study(views, rollouts):
    strict = replace(SPEC, checks=(gates.check("effect", "target_effect", ">=", 0.99),))
    report = gates.gate_report(views.questions, rollouts, strict)
    with pytest.raises(PermissionError):
        studies.prepare_examples(views.questions, rollouts, report, strict)


def test_touched_partition_stops_the_study(views, rollouts):
    questions = views.questions.withColumn("excluded", F.lit(True))
    report = gates.gate_report(questions, rollouts, SPEC)
    with pytest.raises(ValueError, match="outside the partition"):
        studies.prepare_examples(questions, rollouts, report, SPEC)


def test_external_evaluation_refits_nothing(views, rollouts):
    rows = monitors.error_kind(views.graded.filter(
        F.col("condition").isin("clean", "corrupted_continuation")), external=True)
    texts = rollouts.select("rollout_id", "reasoning")
    examples = monitors.surface_table(
        rows.join(texts, "rollout_id").withColumn("label", F.col("binary_label")))
    model = monitors.surface_monitor(examples)
    shift = monitors.loo_answer_shift(rows, rollouts, keep=["binary_label"]).select(
        "score", F.col("binary_label").alias("label"),
        F.lit("counterfactual_answer_shift").alias("component"))
    thresholds = metrics.threshold_for_recall(shift, 0.5, ["component"])
    report, paired = studies.external_evaluation(
        model, thresholds, examples, rollouts, samples=20)
    got = {r.component: r for r in report.collect()}
    assert got["counterfactual_answer_shift"].auroc > got["surface"].auroc
    assert got["counterfactual_answer_shift"].low <= got[
        "counterfactual_answer_shift"].false_positive_rate <= got[
        "counterfactual_answer_shift"].high
    assert paired.count() == 3


def test_labels(rollouts, views):
    shifts, labels = studies.label_rollouts(views.rollout_texts, ["then an"], min_effect=0.2)
    assert shifts.count() == 15
    assert labels.count() == views.rollout_texts.count()
