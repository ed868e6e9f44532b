"""Gates: a sound cohort passes, one mutation at a time fails the named check."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from shiftlens.operators import gates

ARMS = ("clean", "correct_continuation", "corrupted_continuation")


@pytest.fixture(scope="module")
def cohort(spark):
    """A confirmatory cohort of 72 questions, three arms and three samples that passes."""
    splits = ["train"] * 43 + ["validation"] * 14 + ["test"] * 15
    questions = [
        (f"q{i:02d}", f"f{i % 4}", f"m{i // 4 % 2}", 0, "1", "2", "confirmatory", splits[i], False)
        for i in range(72)
    ]
    rollouts = []
    for i in range(72):
        for arm in ARMS:
            for s in range(3):
                wrong = arm == "clean" and s == 0
                answer = "2" if arm == ARMS[2] and s < 2 else "3" if wrong else "1"
                rollouts.append((
                    f"r{i}-{arm}-{s}", f"q{i:02d}", arm, s, "m", "clean_stop", answer,
                    f"p{i}-{arm}-{s}"
                ))
    q = spark.createDataFrame(
        questions, "question_id string, family string, mechanism string, renderer_id int, "
        "gold_answer string, target_answer string, study_partition string, split string, "
        "excluded boolean")
    r = spark.createDataFrame(
        rollouts, "rollout_id string, question_id string, condition string, seed int, "
        "model string, status string, parsed_answer string, provider_request_id string")
    return q, r


SPEC = replace(gates.GATES["confirmatory"], bootstrap_samples=100)


def failed(questions, rollouts, **kwargs):
    report = gates.gate_report(questions, rollouts, SPEC, **kwargs)
    return {r.check for r in report.filter("NOT passed").collect()}


def test_sound_cohort_passes(cohort):
    report = gates.gate_report(*cohort, SPEC)
    assert report.filter("NOT passed").collect() == []
    verdict = gates.gate_verdict(report).first()
    assert verdict.gate_passed and verdict.checks == len(SPEC.checks)


def one():
    """Match one rollout."""
    return F.col("rollout_id") == "r0-clean-1"


@pytest.mark.parametrize(
    ("change", "check"),
    [
        (lambda r: r.filter(~one()), "all_requests_stored"),
        (lambda r: r.withColumn("seed", F.when(one(), 0).otherwise(F.col("seed"))),
         "exact_unique_samples"),
        (lambda r: r.withColumn(
            "provider_request_id", F.when(one(), "p1-clean-1").otherwise(F.col("provider_request_id"))),
         "unique_provider_request_ids"),
        (lambda r: r.withColumn(
            "provider_request_id", F.when(~one(), F.col("provider_request_id"))),
         "provider_request_ids_present"),
        (lambda r: r.withColumn("model", F.when(one(), "x").otherwise(F.col("model"))),
         "expected_conditions_and_model"),
        (lambda r: r.withColumn("question_id", F.when(one(), "zz").otherwise(F.col("question_id"))),
         "no_unknown_questions"),
        (lambda r: r.withColumn("has_reasoning", ~one()), "reasoning_present_for_scorable"),
        (lambda r: r.withColumn("status", F.when(F.col("seed") == 1, "length_truncated").otherwise(
            F.col("status"))), "at_most_10_percent_truncated"),
        (lambda r: r.withColumn("parsed_answer", F.lit("1")), "target_effect_at_least_20_points"),
    ],
)
def test_one_mutation_fails(cohort, change, check):
    questions, rollouts = cohort
    assert check in failed(questions, change(rollouts))


def test_design_and_certificate_checks(spark, cohort):
    questions, rollouts = cohort
    moved = questions.withColumn("split", F.lit("train"))
    assert {"train_questions", "test_questions"} <= failed(moved, rollouts)
    same = questions.withColumn("target_answer", F.col("gold_answer"))
    assert "expected_conditions_and_model" in failed(same, rollouts)
    violation = spark.createDataFrame([("q", "digest")], "question_id string, rule string")
    assert "certificates_verified" in failed(
        questions, rollouts, certificate_violations=violation
    )


def test_require_gate(cohort):
    report = gates.gate_report(*cohort, SPEC)
    gates.require_gate(report, gates.gate_report(*cohort, SPEC))
    tampered = report.withColumn("value", F.col("value") + 1)
    with pytest.raises(PermissionError, match="differs"):
        gates.require_gate(tampered, report)
    refused = report.withColumn("passed", F.lit(False))
    with pytest.raises(PermissionError, match="failed"):
        gates.require_gate(refused, report)
    with pytest.raises(PermissionError, match="empty"):
        gates.require_gate(report.limit(0), report)
