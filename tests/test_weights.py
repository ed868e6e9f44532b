"""Bootstrap weights drawn inside the row, and rank metrics of all replicates side by side."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftlens.operators import metrics, weights

SAMPLES = 40


@pytest.fixture(scope="module")
def rows():
    """Scores with few distinct values, all distinct values, and one class only."""
    draw = random.Random(3)
    score = {"few": lambda: draw.randrange(12) / 8, "many": draw.random, "one class": draw.random}
    return [
        (name, f"q{draw.randrange(40)}", make(), 1 if name == "one class" else draw.randrange(2))
        for name, make in score.items() for _ in range(300)
    ]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "component string, question_id string, score double, label int")


@pytest.fixture(scope="module")
def drawn(table):
    """Weights as SQL draws them."""
    con = duckdb.connect()
    con.register("t", table.toPandas())
    sql = weights.weights_sql("t", "question_id", SAMPLES, "7")
    return {(q, r): w for q, r, w in con.execute(sql).fetchall()}


def test_weights_are_those_of_sql(table, drawn):
    base = table.select("question_id", weights.weight_base(7, "question_id").alias("b")).distinct().collect()
    found = weights.poisson_weights(np.array([r.b for r in base]), SAMPLES)
    assert {(b.question_id, r): found[i, r] for i, b in enumerate(base) for r in range(SAMPLES)} == drawn
    many = weights.poisson_weights(np.arange(500), 1000)
    assert abs(many.mean() - 1) < 0.01 and abs(many.var() - 1) < 0.01


def replicate(rows, drawn, name, r):
    """Evaluate one replicate point by point."""
    points = {}
    for component, question, score, label in rows:
        if component == name and drawn[question, r]:
            points.setdefault(score, [0, 0])[0 if label else 1] += drawn[question, r]
    order = sorted(points, reverse=True)
    positives, negatives = (sum(points[s][k] for s in order) for k in (0, 1))
    if not positives or not negatives:
        return None
    tp = fp = area = steps = 0
    best = None
    for i, score in enumerate(order):
        a, b = points[score]
        tp, fp = tp + a, fp + b
        area, steps = area + b * (2 * tp - a), steps + a * tp / (tp + fp)
        corner = i == 0 or i == len(order) - 1 or points[order[i + 1]] != points[score]
        if best is None and corner and tp / positives >= 0.5:
            best = fp
    return area / (2 * positives * negatives), steps / positives, best / negatives


@pytest.mark.parametrize(
    "limits",
    [
        {}, {"smallPlanBytes": 0, "rowsPerBucket": 60, "hotRows": 1 << 40},
        {"smallPlanBytes": 0, "rowsPerBucket": 60, "hotRows": 20},
        {"smallPlanBytes": 0, "rowsPerBucket": 1 << 40, "hotRows": 20},
    ],
    ids=["direct", "buckets", "buckets and hot scores", "hot scores"],
)
def test_metrics_of_all_replicates(spark, rows, table, drawn, limits):
    for key, value in limits.items():
        spark.conf.set(f"spark.shiftlens.{key}", str(value))
    try:
        counts = metrics.score_counts(table, ["component", "question_id"])
        found = weights.weighted_metrics(
            counts, ["component"], group="question_id", samples=SAMPLES, seed=7
        ).collect()
    finally:
        for key in limits:
            spark.conf.unset(f"spark.shiftlens.{key}")
    assert len(found) == 3 * SAMPLES
    for r in found:
        want = replicate(rows, drawn, r.component, r.replicate)
        assert r.available == (want is not None)
        if want:
            assert (r.auroc, r.auprc, r.false_positive_rate) == pytest.approx(want)


def test_sums_of_all_replicates(table, rows, drawn):
    clusters = table.groupBy("component", "question_id").agg(F.sum("label").alias("hits"))
    found = weights.weighted_sums(
        clusters, ["component"], "question_id", ["hits"], samples=SAMPLES, seed=7
    ).collect()
    want = {}
    for component, question, _, label in rows:
        for r in range(SAMPLES):
            want[component, r] = want.get((component, r), 0) + label * drawn[question, r]
    assert {(r.component, r.replicate): r.hits for r in found} == want
