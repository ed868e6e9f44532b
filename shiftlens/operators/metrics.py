"""Rare-event metrics from score counts: ROC, average precision, operating points."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlens.operators.joins import transfer_threshold
from shiftlens.operators.ranking import running_sums
from shiftlens.schema import PREVALENCES
from shiftlens.session import settle

_WIDE = "decimal(19,0)"


def score_counts(
    scores: DataFrame, by: Sequence[str], *, score: str = "score", label: str = "label"
) -> DataFrame:
    """Count positives and negatives per distinct score.

    Scores that are not finite and labels other than 0 and 1 fail the query.
    """
    value = F.col(score)
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(math.inf))
    binary = F.coalesce(F.col(label).isin(0, 1), F.lit(False))
    checked = (
        F.when(~finite, F.raise_error(F.lit("scores must be finite")))
        .when(~binary, F.raise_error(F.lit("labels must be 0 or 1")))
        .otherwise(value)
    )
    return (
        scores.withColumn("_score", checked)
        .groupBy(*by, F.col("_score").alias("score"))
        .agg(
            F.count_if(F.col(label) == 1).alias("pos"),
            F.count_if(F.col(label) == 0).alias("neg"),
        )
    )


def _curve(counts: DataFrame, by: Sequence[str], points: Sequence | None) -> DataFrame:
    """Add cumulative counts, class totals and the corner mark to score counts."""
    by = list(by)
    curve = running_sums(
        counts,
        by,
        "score",
        {"tp": "pos", "fp": "neg"},
        descending=True,
        points=points,
        following=("pos", "neg"),
        totals={"positives": "pos", "negatives": "neg"},
    )
    # A point between two equal steps lies on a straight line and is not a corner. The first
    # and the last point always stay.
    straight = (F.col("pos") == F.col("next_pos")) & (F.col("neg") == F.col("next_neg"))
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    return curve.withColumn("corner", first | ~F.coalesce(straight, F.lit(False)))


def roc_curve(
    scores: DataFrame,
    by: Sequence[str] = (),
    *,
    prune: bool = True,
    points: Sequence | None = None,
) -> DataFrame:
    """Return ROC points by falling threshold, collinear ones dropped, origin included."""
    by = list(by)
    curve = _curve(settle(score_counts(scores, by)), by, points)
    if prune:
        curve = curve.filter("corner")
    rows = curve.select(
        *by,
        F.col("score").alias("threshold"),
        F.try_divide("fp", "negatives").alias("fpr"),
        F.try_divide("tp", "positives").alias("tpr"),
    )
    origin = rows.select(*by).distinct() if by else scores.sparkSession.range(1).select()
    start = origin.select(
        *by,
        F.lit(math.inf).alias("threshold"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return rows.unionByName(start)


def evaluate_counts(
    counts: DataFrame,
    by: Sequence[str],
    *,
    recall: float = 0.5,
    points: Sequence | None = None,
) -> DataFrame:
    """Evaluate score counts; groups with one class come back with ``available`` false."""
    if not math.isfinite(recall) or not 0 <= recall <= 1:
        raise ValueError("target recall must be in [0, 1]")
    by = list(by)
    curve = _curve(counts, by, points)
    tpr = F.try_divide("tp", "positives")
    fpr = F.try_divide("fp", "negatives")
    reached = F.col("corner") & (tpr >= F.lit(recall))
    point = F.struct(
        F.col("score").alias("threshold"), tpr.alias("recall"), fpr.alias("fpr")
    )
    best = F.min_by(
        F.when(reached, point), F.when(reached, F.struct(F.col("fp"), (-F.col("score"))))
    )
    area = F.sum(
        F.col("neg").cast(_WIDE) * (2 * F.col("tp") - F.col("pos")).cast(_WIDE)
    ).cast("double")
    steps = F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    found = curve.groupBy(*by).agg(
        F.max("positives").alias("positives"),
        F.max("negatives").alias("negatives"),
        area.alias("_area"),
        steps.alias("_steps"),
        best.alias("_best"),
    )
    positives, negatives = F.col("positives"), F.col("negatives")
    both = (positives > 0) & (negatives > 0)
    at_origin = F.lit(recall == 0)
    values = {
        "auroc": F.col("_area") / (F.lit(2.0) * positives * negatives),
        "auprc": F.col("_steps") / positives,
        "threshold": F.when(at_origin, F.lit(math.inf)).otherwise(F.col("_best.threshold")),
        "achieved_recall": F.when(at_origin, 0.0).otherwise(F.col("_best.recall")),
        "false_positive_rate": F.when(at_origin, 0.0).otherwise(F.col("_best.fpr")),
    }
    return found.select(
        *by,
        (positives + negatives).alias("n"),
        "positives",
        both.alias("available"),
        *[F.when(both, v).alias(n) for n, v in values.items()],
    )


def evaluate_scores(
    scores: DataFrame,
    by: Sequence[str] = (),
    *,
    recall: float = 0.5,
    points: Sequence | None = None,
    strict: bool = False,
) -> DataFrame:
    """Return n, positives, AUROC, average precision and the fixed-recall operating point.

    ``strict`` fails on a group that lacks a class instead of marking it unavailable.
    """
    counts = settle(score_counts(scores, by))
    out = evaluate_counts(counts, by, recall=recall, points=points)
    if strict:
        out = out.withColumn(
            "available",
            F.when(
                ~F.col("available"), F.raise_error(F.lit("labels must contain both classes"))
            ).otherwise(F.col("available")),
        )
    return out


def auroc(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Return the area under the ROC curve, ties counted half."""
    return evaluate_scores(scores, by).select(*by, "auroc")


def average_precision(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Return the step-wise area under the precision-recall curve."""
    return evaluate_scores(scores, by).select(*by, "auprc")


def threshold_for_recall(
    scores: DataFrame, recall: float, by: Sequence[str] = (), points: Sequence | None = None
) -> DataFrame:
    """Return the highest threshold of least false-positive rate that reaches a recall."""
    out = evaluate_scores(scores, by, recall=recall, points=points)
    return out.select(*by, "threshold", "achieved_recall", "false_positive_rate")


def precision_from_rates(tpr: Column, fpr: Column, prevalence: Column) -> Column:
    """Return the precision implied by rates at a prevalence; NaN without any alarm."""

    def outside(c: Column) -> Column:
        return F.isnan(c) | (c < 0) | (c > 1)

    hits = tpr * prevalence
    alarms = hits + fpr * (F.lit(1.0) - prevalence)
    bad = outside(tpr) | outside(fpr) | outside(prevalence)
    return (
        F.when(bad, F.raise_error(F.lit("rates and prevalence must be in [0, 1]")))
        .when(alarms == 0, F.lit(math.nan))
        .otherwise(F.try_divide(hits, alarms))
    )


def precision_at_prevalence(
    metrics: DataFrame, prevalences: Sequence[float] = PREVALENCES
) -> DataFrame:
    """Add one row per assumed prevalence with the precision implied by the operating point."""
    rows = metrics.withColumn(
        "prevalence", F.explode(F.array(*[F.lit(float(p)) for p in prevalences]))
    )
    return rows.withColumn(
        "precision",
        precision_from_rates(
            F.col("achieved_recall"), F.col("false_positive_rate"), F.col("prevalence")
        ),
    )


def evaluate_by_stratum(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Evaluate every stratum; single-class strata stay in the result as unavailable."""
    out = evaluate_scores(scores, by)
    return out.withColumn("reason", F.when(~F.col("available"), F.lit("single_class")))


def validation_operating_point(
    scores: DataFrame, by: Sequence[str] = ("component",), *, recall: float = 0.5
) -> DataFrame:
    """Choose thresholds on the validation split and apply them once to the test split."""
    by = list(by)
    chosen = threshold_for_recall(scores.filter("split = 'validation'"), recall, by).select(
        *by,
        "threshold",
        F.col("achieved_recall").alias("validation_recall"),
        F.col("false_positive_rate").alias("validation_false_positive_rate"),
    )
    applied = transfer_threshold(scores.filter("split = 'test'"), chosen, by).select(
        *by,
        F.col("recall").alias("test_recall"),
        F.col("false_positive_rate").alias("test_false_positive_rate"),
    )
    return chosen.join(applied, by)


def _binomial_udf(tail: float) -> Callable[..., Column]:
    """Build the interval function; it is self-contained, so executors need no extra package."""
    MOST_STEPS = 10_000_000  # noqa: N806 - about the root of the number of trials is needed

    def beta_tail(a: float, b: float, x: float) -> float:
        # Regularised incomplete beta function by its continued fraction.
        if x <= 0 or x >= 1:
            return 0.0 if x <= 0 else 1.0
        if x > (a + 1) / (a + b + 2):
            return 1.0 - beta_tail(b, a, 1 - x)
        log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        front = math.exp(log_front + a * math.log(x) + b * math.log1p(-x)) / a
        total, c, d = 1.0, 1.0, 0.0
        for i in range(MOST_STEPS):
            m = i // 2
            if i == 0:
                step = 1.0
            elif i % 2 == 0:
                step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            else:
                step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1.0 / ((1.0 + step * d) or 1e-300)
            c = (1.0 + step / c) or 1e-300
            total *= c * d
            if abs(1.0 - c * d) < 1e-15:
                return front * (total - 1.0)
        raise ArithmeticError(f"the beta function of {a}, {b} at {x} does not settle")

    def beta_quantile(a: float, b: float, p: float) -> float:
        low, high = 0.0, 1.0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if beta_tail(a, b, middle) < p else (low, middle)
        return (low + high) / 2

    def interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        pairs = list(zip(k, n, strict=True))
        low = [0.0 if x == 0 else beta_quantile(x, t - x + 1, tail) for x, t in pairs]
        high = [1.0 if x == t else beta_quantile(x + 1, t - x, 1 - tail) for x, t in pairs]
        return pd.DataFrame({"low": low, "high": high})

    return F.pandas_udf(interval, "low double, high double")


def exact_binomial_ci(
    rates: DataFrame, successes: str, trials: str, *, confidence: float = 0.95
) -> DataFrame:
    """Add the exact binomial interval to a report of counts."""
    interval = _binomial_udf((1 - confidence) / 2)
    return rates.withColumn("_ci", interval(F.col(successes), F.col(trials))).select(
        "*", F.col("_ci.low").alias("low"), F.col("_ci.high").alias("high")
    ).drop("_ci")
