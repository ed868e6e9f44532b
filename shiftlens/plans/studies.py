"""Whole studies composed from the operators, one function per entry point."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.operators import bootstrap, gates, metrics, monitors, quality
from shiftlens.operators.logistic import LogisticFit
from shiftlens.operators.aggregates import (
    dataset_summary,
    graded,
    hint_answer_shift,
    stratum_quantiles,
)
from shiftlens.operators.joins import attach, enrich, missing_components, unknown_keys
from shiftlens.operators.sampling import select_audit
from shiftlens.session import materialize


@dataclass(frozen=True)
class Examples:
    """Labelled examples of a study and their counts."""

    primary: DataFrame
    audit: DataFrame
    summary: DataFrame


@dataclass(frozen=True)
class Evaluation:
    """Everything reported about the monitors of a study."""

    scores: DataFrame
    metrics: DataFrame
    intervals: DataFrame
    by_family: DataFrame
    operating_points: DataFrame
    precision: DataFrame
    paired: DataFrame
    audit: DataFrame


def prepare_examples(
    questions: DataFrame,
    rollouts: DataFrame,
    stored_report: DataFrame,
    spec: gates.GateSpec,
    *,
    certificate_violations: DataFrame | None = None,
    audit_cap: int = 96,
    audit_seed: int = 17,
) -> Examples:
    """Turn a study that passed its gate into primary and secondary examples.

    The gate is recomputed and must equal the stored report. Rows of unknown questions,
    repeated ids, a partition that is not the untouched one, or a split without both classes
    stop the study.
    """
    recomputed = gates.gate_report(
        questions, rollouts, spec, certificate_violations=certificate_violations
    )
    gates.require_gate(stored_report, recomputed)
    partition = gates.PARTITIONS.get(spec.study, "confirmatory")
    touched = questions.filter(
        ~F.coalesce(F.col("study_partition") == partition, F.lit(False))
        | F.coalesce("excluded", F.lit(True))
    )
    quality.require_empty(touched.select("question_id"), "question outside the partition")
    twice = rollouts.groupBy("rollout_id").count().filter("count > 1")
    quality.require_empty(twice, "repeated rollout id")
    quality.require_empty(unknown_keys(rollouts, questions), "rollout of an unknown question")
    columns = (
        "question_id", "family", "tier", "renderer_id", "mechanism", "split", "gold_answer",
        "target_answer", F.col("prompt").alias("question_prompt"),
    )
    bare = rollouts.drop("gold_answer", "target_answer", "family", "tier", "renderer_id",
                         "mechanism", "split")
    joined = enrich(bare, questions.select(*columns))
    examples = materialize(monitors.error_kind(graded(joined)))
    primary = examples.filter("is_primary")
    quality.require_empty(quality.missing_classes(primary), "split lacks a class")
    audit = select_audit(examples.filter("NOT is_primary"), audit_cap, audit_seed)
    return Examples(primary, audit, dataset_summary(examples))


def evaluate_monitors(
    scores: DataFrame,
    labels: DataFrame,
    *,
    contrasts: Sequence[tuple[str, str]] = (("counterfactual_answer_shift", "surface"),),
    samples: int = 1000,
    seed: int = 17,
    recall: float = 0.5,
) -> Evaluation:
    """Evaluate long component scores on the test split.

    ``labels`` has ``example_id, label, family, kind, is_primary``. Every test example needs
    all components except those fitted on a part of the splits.
    """
    rows = materialize(
        attach(
            scores.select("example_id", "question_id", "split", "component", "score"),
            labels.select("example_id", "label", "family", "kind", "is_primary"),
            ["example_id"],
            row_id="component",
        )
    )
    primary = rows.filter("is_primary")
    test = primary.filter("split = 'test'")
    components = sorted(r[0] for r in test.select("component").distinct().collect())
    quality.require_empty(missing_components(test, components), "test example lacks a score")
    point = metrics.evaluate_scores(test, ["component"], recall=recall)
    by_family = metrics.evaluate_by_stratum(test, ["component", "family"])
    fitted = primary.filter(F.col("split").isin("validation", "test"))
    paired = None
    for first, second in contrasts:
        part = bootstrap.paired_bootstrap_difference(
            test, first, second, samples=samples, seed=seed + 1
        ).withColumn("contrast", F.lit(f"{first}_minus_{second}"))
        paired = part if paired is None else paired.unionByName(part)
    return Evaluation(
        scores=rows,
        metrics=point,
        intervals=bootstrap.cluster_bootstrap_metrics(test, samples=samples, seed=seed),
        by_family=by_family,
        operating_points=metrics.validation_operating_point(fitted, recall=recall),
        precision=metrics.precision_at_prevalence(point),
        paired=paired,
        audit=stratum_quantiles(rows.filter("NOT is_primary")),
    )


def performance_table(evaluation: Evaluation) -> DataFrame:
    """Lay out every component's metrics with their interval ends."""
    pairs = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(m).alias("point"))
            for m in bootstrap.METRICS
        ]
    )
    points = evaluation.metrics.select("component", F.inline(pairs))
    ends = evaluation.intervals.select("component", "metric", "low", "high")
    return points.join(ends, ["component", "metric"], "left")


def label_rollouts(
    rollouts: DataFrame, patterns: Sequence[str], *, min_effect: float, **options
) -> tuple[DataFrame, DataFrame]:
    """Estimate hint effects and label every rollout by them."""
    shifts = hint_answer_shift(rollouts)
    return shifts, monitors.causal_label(
        rollouts, shifts, patterns, min_effect=min_effect, **options
    )


def external_evaluation(
    model: LogisticFit,
    thresholds: DataFrame,
    examples: DataFrame,
    rollouts: DataFrame,
    *,
    samples: int = 1000,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """Score another study with a frozen surface model and the label-free answer shift.

    Returns metrics with both transferred thresholds applied, and the paired difference of
    the two monitors. ``examples`` carries text features and ``label``; nothing is refitted.
    """
    surface = monitors.predict(model, examples).select(
        "example_id", "question_id", "label", "score", F.lit("surface").alias("component")
    )
    focal = examples.withColumn("rollout_id", F.col("example_id"))
    shift = monitors.loo_answer_shift(
        focal, rollouts, strict=True, keep=["example_id", "label"]
    ).select(
        "example_id", "question_id", "label", "score",
        F.lit("counterfactual_answer_shift").alias("component"),
    )
    rows = materialize(surface.unionByName(shift))
    moved = metrics.transfer_threshold(rows, thresholds)
    fpr = metrics.exact_binomial_ci(
        moved.select("component", "threshold", "recall", "false_positive_rate",
                     "false_positives", "negatives"),
        "false_positives",
        "negatives",
    )
    report = metrics.evaluate_scores(rows, ["component"]).drop(
        "threshold", "achieved_recall", "false_positive_rate"
    ).join(fpr, "component", "left")
    paired = bootstrap.paired_bootstrap_difference(
        rows, "counterfactual_answer_shift", "surface", samples=samples, seed=seed
    )
    return report, paired
