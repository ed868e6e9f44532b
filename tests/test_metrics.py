"""Metrics, bootstraps, ranks, quantiles and quotas, direct and bucketed."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftlens.functions.ids import hash_draw
from shiftlens.operators import bootstrap, metrics, ranking, sampling
from shiftlens.operators.metrics import score_counts
from shiftlens.session import checkpoint_folder


def scored(frame, pairs):
    return frame(
        [("c", float(s), y, f"q{i % 5}") for i, (y, s) in enumerate(pairs)],
        "component string, score double, label int, question_id string",
    )


def test_precision_values(frame):
    df = frame(
        [(0.8, 0.05, 0.01), (0.0, 0.0, 0.5), (0.7, 1.0, 0.5), (0.7, 1.0, 0.1), (0.7, 1.0, 0.05),
         (0.7, 1.0, 0.01)],
        "t double, f double, p double",
    )
    got = [r[0] for r in df.select(
        metrics.precision_from_rates(F.col("t"), F.col("f"), F.col("p"))).collect()]
    assert got[0] == pytest.approx(0.1391, abs=1e-3)
    assert math.isnan(got[1])
    assert [round(x, 5) for x in got[2:]] == [0.41176, 0.07216, 0.03553, 0.00702]
    with pytest.raises(Exception, match="must be in"):
        df.select(metrics.precision_from_rates(F.lit(1.5), F.col("f"), F.col("p"))).collect()


def test_perfect_separation(frame):
    df = scored(frame, [(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)])
    row = metrics.evaluate_scores(df, ["component"]).first()
    assert (row.auroc, row.false_positive_rate, row.achieved_recall) == (1.0, 0.0, 0.5)


def test_pruned_point_overshoots_recall(frame):
    # Four positives above four negatives: the straight part of the curve is dropped, so the
    # smallest kept threshold reaching one half is the one with full recall.
    df = scored(frame, [(1, 0.9), (1, 0.8), (1, 0.7), (1, 0.6), (0, 0.4), (0, 0.3), (0, 0.2),
                        (0, 0.1)])
    assert metrics.evaluate_scores(df, ["component"]).first().achieved_recall == 1.0
    curve = metrics.roc_curve(df, ["component"]).count()
    assert curve == 4 and metrics.roc_curve(df, ["component"], prune=False).count() == 9


def test_bad_inputs(frame):
    df = scored(frame, [(0, 0.1), (1, float("nan"))])
    with pytest.raises(Exception, match="finite"):
        metrics.evaluate_scores(df).collect()
    with pytest.raises(ValueError):
        metrics.evaluate_scores(scored(frame, [(0, 0.1), (1, 0.2)]), recall=1.1)
    one = scored(frame, [(1, 0.1), (1, 0.2)])
    assert metrics.evaluate_scores(one).first().available is False
    with pytest.raises(Exception, match="both classes"):
        metrics.evaluate_scores(one, strict=True).collect()


def reference_metrics(y, s):
    order = np.argsort(-s, kind="stable")
    y, s = y[order], s[order]
    ends = np.r_[np.where(np.diff(s))[0], len(s) - 1]
    tp, fp = np.cumsum(y)[ends], np.cumsum(1 - y)[ends]
    p, n = y.sum(), (1 - y).sum()
    t0, f0 = np.r_[0, tp[:-1]], np.r_[0, fp[:-1]]
    auc = ((fp - f0) * (tp + t0)).sum() / (2 * p * n)
    ap = ((tp - t0) / p * tp / (tp + fp)).sum()
    return auc, ap


@pytest.mark.parametrize("points", [None, [0.1, 0.25, 0.5, 0.9]])
def test_metrics_match_numpy_with_and_without_buckets(frame, points):
    rng = np.random.default_rng(2)
    s = np.round(rng.random(500), 2)
    y = (rng.random(500) < s).astype(int)
    df = scored(frame, zip(y.tolist(), s.tolist(), strict=True)).repartition(9)
    row = metrics.evaluate_scores(df, ["component"], points=points).first()
    auc, ap = reference_metrics(y, s)
    assert row.auroc == pytest.approx(auc) and row.auprc == pytest.approx(ap)
    plain = metrics.roc_curve(df, ["component"])
    cut = metrics.roc_curve(df, ["component"], points=points)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, cut.collect()))


def test_split_points_are_measured(spark, tiny_limits):
    df = spark.range(1000).select((F.col("id") / 1000).alias("score"))
    points = ranking.split_points(df, "score")
    assert len(points) == 9
    sizes = df.groupBy(ranking.bucket_of(F.col("score"), points)).count().collect()
    assert max(r["count"] for r in sizes) < 150
    text = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    points = ranking.split_points(text, "k")
    assert points == sorted(points) and len(points) == 9
    ranked = ranking.rank_by_key(text, [], "k", points=points).orderBy("k").collect()
    assert [r.rn for r in ranked] == list(range(1, 1001))


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_hash_rank_is_the_same_at_any_width(spark, digits):
    df = spark.range(500).select(
        F.col("id").cast("string").alias("k"), (F.col("id") % 3 == 0).alias("g")
    )
    want = ranking.rank_by_hash(df, ["g"], "k", 5, digits=0).collect()
    got = ranking.rank_by_hash(df.repartition(11), ["g"], "k", 5, digits=digits).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.mark.parametrize("points", [None, [3.0, 11.0]])
def test_exact_quantiles(spark, points):
    rng = random.Random(4)
    values = [float(rng.randint(0, 20)) for _ in range(200)]
    df = spark.createDataFrame([("g", x) for x in values], "g string, v double")
    row = ranking.exact_quantiles(
        df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.93}, points=points
    ).first()
    for name, q in (("a", 0.1), ("b", 0.5), ("c", 0.93)):
        assert row[name] == pytest.approx(np.quantile(values, q))


def test_round_robin_quota_equals_simulation(spark):
    rng = random.Random(6)
    for _ in range(6):
        sizes = {f"s{i}": rng.randint(1, 9) for i in range(5)}
        n = rng.randint(1, 30)
        left, taken = dict(sizes), dict.fromkeys(sizes, 0)
        while sum(taken.values()) < n and any(left.values()):
            for s in sorted(left):
                if left[s] and sum(taken.values()) < n:
                    left[s] -= 1
                    taken[s] += 1
        df = spark.createDataFrame(list(sizes.items()), "s string, size long")
        got = {r.s: r.quota for r in ranking.round_robin_quota(df, [], ["s"], n).collect()}
        assert got == taken


def test_balanced_select_needs_enough_rows(spark):
    df = spark.range(5).select(
        F.col("id").cast("string").alias("question_id"), (F.col("id") % 2).alias("s")
    )
    assert sampling.balanced_select(df, ["s"], 4, 1).count() == 4
    with pytest.raises(Exception, match="need 6 rows"):
        sampling.balanced_select(df, ["s"], 6, 1).collect()


def test_large_and_small_samples_agree(spark, monkeypatch):
    df = spark.range(300).select(
        F.col("id").cast("string").alias("question_id"), (F.col("id") % 7 * F.col("id") % 5).alias("s")
    )
    small = sampling.balanced_select(df, ["s"], 40, 1).collect()
    monkeypatch.setattr(sampling, "SMALL_SAMPLE", 0)
    large = sampling.balanced_select(df, ["s"], 40, 1).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, large)) and len(small) == 40


def test_selection_ignores_outcomes_and_partitioning(spark):
    df = spark.range(60).select(
        F.col("id").cast("string").alias("question_id"), (F.col("id") % 4).alias("s"),
        F.lit("right").alias("outcome"),
    )
    a = sampling.balanced_select(df, ["s"], 10, 1).select("question_id").collect()
    b = sampling.balanced_select(
        df.withColumn("outcome", F.lit("wrong")).repartition(9), ["s"], 10, 1
    ).select("question_id").collect()
    assert sorted(a) == sorted(b)


def test_grouped_split(spark):
    ids = [f"q{i}" for i in range(20)]
    a = sampling.grouped_split(spark.createDataFrame([(i,) for i in ids], "question_id string"),
                               seed=3)
    b = sampling.grouped_split(
        spark.createDataFrame([(i,) for i in reversed(ids)], "question_id string"), seed=3)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    counts = {r.split: r["count"] for r in a.groupBy("split").count().collect()}
    assert counts == {"train": 12, "validation": 4, "test": 4}
    with pytest.raises(ValueError):
        sampling.grouped_split(a, (0.5, 0.2, 0.2))


def test_permutation_preserves_counts(spark):
    df = spark.range(90).select(
        F.col("id").cast("string").alias("example_id"), (F.col("id") % 3 == 0).cast("int").alias("y")
    )
    out = sampling.permute_labels(df, "y", 3)
    assert out.count() == 90 and out.agg(F.sum("permuted_label")).first()[0] == 30
    changed = out.join(df, "example_id").filter("permuted_label <> y").count()
    assert changed > 10


def test_bootstrap_draws_keep_whole_groups(spark):
    groups = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1)], "question_id string, n int")
    sums = bootstrap.resampled_sums(groups, [], "question_id", ["n"], samples=50, seed=1)
    rows = sums.collect()
    assert len(rows) == 50 and all(3 <= r.n <= 6 for r in rows)
    poisson = bootstrap.resampled_sums(
        groups, [], "question_id", ["n"], samples=400, seed=1, method="poisson"
    )
    assert abs(poisson.agg(F.avg("n")).first()[0] - 5) < 0.6
    with pytest.raises(ValueError):
        bootstrap.resampled_sums(groups, [], "question_id", ["n"], samples=0, seed=1)


def test_bootstrap_metrics_against_brute_force(spark, frame):
    rng = random.Random(9)
    rows = [(f"q{i % 6}", rng.randint(0, 1), round(rng.random(), 1)) for i in range(60)]
    df = frame([("c", s, y, q) for q, y, s in rows],
               "component string, score double, label int, question_id string")
    counts = metrics.score_counts(df, ["component", "question_id"])
    got = {
        r.replicate: (r.auroc, r.auprc)
        for r in bootstrap.replicate_metrics(
            counts, ["component"], samples=20, seed=4, method="draws"
        ).collect()
    }
    indexed = bootstrap.indexed_clusters(df.select("question_id").distinct(), [], "question_id")
    names = {r._slot: r.question_id for r in indexed.collect()}
    drawn = {}
    for r in bootstrap.draws(indexed, [], 20, 4).collect():
        drawn.setdefault(r.replicate, []).append(names[r._slot])
    for replicate, chosen in drawn.items():
        sample = [(y, s) for q in chosen for qq, y, s in rows if qq == q]
        y, s = np.array([a for a, _ in sample]), np.array([b for _, b in sample])
        assert got[replicate] == pytest.approx(reference_metrics(y, s))


def test_exact_binomial(frame):
    df = frame([(0, 108), (45, 118), (32, 108), (74, 118)], "k int, n int")
    rows = metrics.exact_binomial_ci(df, "k", "n").collect()
    want = [(0.0, 0.03358), (0.2935, 0.47532), (0.21228, 0.39183), (0.53332, 0.71438)]
    for row, (low, high) in zip(rows, want, strict=True):
        assert row.low == pytest.approx(low, abs=1e-5)
        assert row.high == pytest.approx(high, abs=1e-5)


def test_draws_reach_slots_beyond_32_bits(spark):
    size = 1 << 40
    slots = spark.range(2000).select(
        hash_draw(3, F.lit(0), F.col("id"), F.lit(size).cast("long")).alias("slot")
    )
    low, high, mean = slots.agg(F.min("slot"), F.max("slot"), F.avg("slot")).first()
    assert 0 <= low and high > 1 << 39 and abs(mean / size - 0.5) < 0.05


def test_labels_outside_both_classes_fail(frame):
    rows = frame([(0.5, 1), (0.4, 0), (0.3, 7)], "score double, label int")
    for bad in (rows, rows.withColumn("label", F.when(F.col("label") < 7, F.col("label")))):
        with pytest.raises(Exception, match="labels must be 0 or 1"):
            score_counts(bad, []).collect()


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_folder(Session())


def test_an_allocation_must_be_used_up(frame):
    rows = frame([(f"q{i}", "a") for i in range(10)], "question_id string, family string")
    fixed = {"qualification": 4, "partition_seed": 1, "split_seed": 2}
    out = sampling.partition_assign(rows, allocations={"a": (3, 2, 1)}, **fixed)
    assert out.filter("split = 'test'").count() == 1
    with pytest.raises(ValueError, match="not used up: a"):
        sampling.partition_assign(rows, allocations={"a": (3, 2, 2)}, **fixed)
    with pytest.raises(Exception, match="allocation too small"):
        sampling.partition_assign(rows, allocations={"a": (3, 1, 1)}, **fixed).collect()
