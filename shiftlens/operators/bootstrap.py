"""Cluster bootstraps from hash draws: whole groups are resampled, never rows.

Facts are reduced to one row per cluster (or per cluster and score) before anything is
replicated. Rank metrics weight clusters inside the row (``weights``); elsewhere, and there on
request, exactly as many clusters are drawn as there are. A draw is the hash of (seed, replicate, slot) modulo the cluster count, so replicates
do not depend on partitioning and every slot can be drawn in any task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlens.functions.ids import hash_draw
from shiftlens.operators.joins import hot_keys, lookup_join, spread_join
from shiftlens.operators.metrics import evaluate_counts, score_counts
from shiftlens.operators.ranking import exact_quantiles, rank_by_hash, split_points
from shiftlens.operators.weights import weighted_metrics, weighted_sums
from shiftlens.session import materialize

INDEX_SEED = "cluster"


def _replicates(samples: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))


def indexed_clusters(clusters: DataFrame, by: Sequence[str], group: str) -> DataFrame:
    """Number clusters 0..G-1 within each ``by`` group and attach G."""
    by = list(by)
    ranked = rank_by_hash(clusters, by, group, INDEX_SEED, rank="_rank")
    sizes = clusters.groupBy(*by).agg(F.count("*").alias("_g"))
    joined = spread_join(ranked, sizes, by, salt=group) if by else ranked.crossJoin(F.broadcast(sizes))
    return joined.withColumn("_slot", F.col("_rank") - 1).drop("_rank")


def _width(df: DataFrame) -> int:
    """Return how many tasks a step that multiplies its rows should use."""
    spark = df.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, shuffle)


def draws(
    clusters: DataFrame, by: Sequence[str], samples: int, seed: int | Column
) -> DataFrame:
    """Draw G clusters per replicate: one row per replicate and slot, drawn index included.

    ``clusters`` comes from :func:`indexed_clusters`; every cluster row fills its own slot. The
    narrow slot table is spread over all cores first, because each row becomes ``samples`` rows.
    """
    picked = hash_draw(seed, F.col("replicate"), F.col("_slot"), F.col("_g"))
    spread = clusters.select(*by, "_slot", "_g").repartition(
        _width(clusters), *by, "_slot"
    )
    slots = spread.select("*", _replicates(samples).alias("replicate"))
    return slots.select(*by, "replicate", picked.alias("_slot"))


def resampled_sums(
    clusters: DataFrame,
    by: Sequence[str],
    group: str,
    sums: Sequence[str],
    *,
    samples: int,
    seed: int | Column,
    method: str = "draws",
) -> DataFrame:
    """Add up per-cluster columns in every bootstrap replicate.

    ``method="poisson"`` weights each cluster independently (see ``weights``) instead of drawing
    exactly G clusters; it needs no join and suits very many clusters, as an approximation.
    """
    if samples <= 0:
        raise ValueError("samples must be positive")
    by = list(by)
    clusters = materialize(clusters.select(*by, group, *sums))
    if method == "poisson":
        return weighted_sums(clusters, by, group, sums, samples=samples, seed=seed)
    indexed = indexed_clusters(clusters, by, group)
    picked = draws(indexed, by, samples, seed)
    # Each slot becomes ``samples`` rows, which size estimates do not see: left to them, the draws
    # would be broadcast. The hint has them shuffled to the clusters' one row per slot.
    stats = indexed.select(*by, "_slot", *sums).hint("shuffle_hash")
    drawn = picked.join(stats, [*by, "_slot"])
    return drawn.groupBy(*by, "replicate").agg(*[F.sum(c).alias(c) for c in sums])


def interval(
    values: DataFrame,
    value: str,
    by: Sequence[str] = (),
    *,
    method: str = "order",
    low: float = 0.025,
    high: float = 0.975,
    few: bool = False,
) -> DataFrame:
    """Return the interval of values by order statistic or linear quantile.

    Groups of any size are ranked in bounded pieces. ``few`` says that a group has no more
    values than a bootstrap has replicates, which are then sorted as one short list.
    """
    if not few:
        sizes = values.groupBy(*by).agg(F.count(value).alias("successful_samples"))
        edges = exact_quantiles(
            values.filter(F.col(value).isNotNull()), by, value, {"low": low, "high": high},
            interpolate=method == "linear",
        ).drop("n")
        return lookup_join(sizes, edges, by, "left") if by else sizes.join(F.broadcast(edges), how="left")
    if method == "linear":
        edges = [
            F.percentile(value, p).alias(n) for n, p in (("low", low), ("high", high))
        ]
        return values.groupBy(*by).agg(F.count(value).alias("successful_samples"), *edges)
    ordered = values.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("_v"))

    def at(p: float) -> Column:
        index = F.floor(F.lit(p) * (F.size("_v") - 1)).cast("int") + 1
        return F.when(F.size("_v") > 0, F.try_element_at("_v", F.greatest(index, F.lit(1))))

    return ordered.select(
        *by,
        F.size("_v").cast("long").alias("successful_samples"),
        at(low).alias("low"),
        at(high).alias("high"),
    )


def effect_clusters(
    graded_rows: DataFrame, treated: str, control: str, by: Sequence[str] = ()
) -> DataFrame:
    """Reduce graded rollouts to target counts per question and arm."""
    hit = F.col("hit_target")
    arm = F.col("condition")
    return graded_rows.groupBy(*by, "question_id").agg(
        F.count_if((arm == treated) & hit).alias("t_hits"),
        F.count_if((arm == treated) & hit.isNotNull()).alias("t_rows"),
        F.count_if((arm == control) & hit).alias("c_hits"),
        F.count_if((arm == control) & hit.isNotNull()).alias("c_rows"),
    )


def cluster_bootstrap_effect(
    graded_rows: DataFrame,
    treated: str,
    control: str,
    *,
    samples: int = 1000,
    seed: int = 17,
    by: Sequence[str] = (),
    seed_from: str | None = None,
    method: str = "draws",
) -> DataFrame:
    """Bootstrap the target effect by question cluster and return its interval.

    ``seed_from`` names a text column whose length is added to the seed of its group.
    """
    by = list(by)
    clusters = effect_clusters(graded_rows, treated, control, by)
    # A question without a target row in any arm is no cluster.
    clusters = clusters.filter((F.col("t_rows") > 0) | (F.col("c_rows") > 0))
    base = F.lit(seed) + F.length(seed_from) if seed_from else F.lit(seed)
    names = ["t_hits", "t_rows", "c_hits", "c_rows"]
    sums = resampled_sums(
        clusters, by, "question_id", names, samples=samples, seed=base, method=method
    )
    usable = sums.filter((F.col("t_rows") > 0) & (F.col("c_rows") > 0))
    effect = F.col("t_hits") / F.col("t_rows") - F.col("c_hits") / F.col("c_rows")
    return interval(usable.select(*by, effect.alias("effect")), "effect", by, few=True)


def cluster_bootstrap_accuracy(
    graded_rows: DataFrame, *, samples: int = 1000, seed: int = 17, method: str = "draws"
) -> DataFrame:
    """Bootstrap the accuracy of graded rollouts by question cluster."""
    clusters = (
        graded_rows.filter(F.col("grade").isNotNull())
        .groupBy("question_id")
        .agg(
            F.count_if(F.col("grade") == "correct").alias("hits"),
            F.count_if(F.col("grade").isin("correct", "incorrect")).alias("rows"),
        )
    )
    sums = resampled_sums(
        clusters, [], "question_id", ["hits", "rows"], samples=samples, seed=seed, method=method
    )
    usable = sums.filter(F.col("rows") > 0)
    return interval(usable.select((F.col("hits") / F.col("rows")).alias("accuracy")), "accuracy", few=True)


def replicate_counts(
    counts: DataFrame,
    by: Sequence[str],
    *,
    group: str = "question_id",
    samples: int,
    seed: int,
) -> DataFrame:
    """Resample the score counts of clusters: one row per replicate and distinct score.

    Each cluster carries its replicate multiplicities as one short array, so the counts of a
    large cluster are joined row by row without being gathered.
    """
    by = list(by)
    indexed = indexed_clusters(counts.select(group).distinct(), [], group)
    times = draws(indexed, [], samples, seed).groupBy("_slot", "replicate").agg(
        F.count("*").alias("w")
    )
    lists = times.groupBy("_slot").agg(
        F.collect_list(F.struct("replicate", "w")).alias("_times")
    )
    # The lists hold up to ``samples`` replicates, which size estimates do not see: neither they nor
    # the weights may be broadcast on those.
    slots = indexed.select(group, "_slot").hint("shuffle_hash")
    weights = lists.join(slots, "_slot").drop("_slot").hint("merge")
    # The scores of one hot cluster spread by score.
    hot = hot_keys(counts, [group])
    exploded = lookup_join(counts, weights, [group], hot=hot, row_id="score").select(
        *by, "score", "pos", "neg", F.inline("_times")
    )
    return exploded.groupBy(*by, "replicate", "score").agg(
        F.sum(F.col("pos") * F.col("w")).alias("pos"),
        F.sum(F.col("neg") * F.col("w")).alias("neg"),
    )


def replicate_metrics(
    counts: DataFrame,
    by: Sequence[str],
    *,
    group: str = "question_id",
    samples: int,
    seed: int,
    recall: float = 0.5,
    method: str = "poisson",
) -> DataFrame:
    """Evaluate every replicate; replicates with one class are marked unavailable.

    ``counts`` holds one row per cluster and distinct score and should be materialized. Weights are
    drawn inside the row and all replicates evaluated side by side. ``method="draws"`` draws
    exactly G clusters a replicate instead, which copies every score row to each replicate that
    drew its cluster: for few clusters.
    """
    if method == "poisson":
        return weighted_metrics(counts, by, group=group, samples=samples, seed=seed, recall=recall)
    points = split_points(counts, "score")
    drawn = replicate_counts(counts, by, group=group, samples=samples, seed=seed)
    return evaluate_counts(drawn, [*by, "replicate"], recall=recall, points=points)


def _merged(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add up score counts over clusters."""
    return counts.groupBy(*by, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


METRICS = ("auroc", "auprc", "false_positive_rate")


def _long(metrics: DataFrame, keep: Sequence[str]) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS]
    )
    return metrics.select(*keep, F.inline(pairs))


def cluster_bootstrap_metrics(
    scores: DataFrame,
    by: Sequence[str] = ("component",),
    *,
    group: str = "question_id",
    samples: int = 1000,
    seed: int = 17,
    method: str = "poisson",
) -> DataFrame:
    """Return clustered intervals of AUROC, average precision and FPR at fixed recall."""
    by = list(by)
    counts = materialize(score_counts(scores, [*by, group]))
    rows = replicate_metrics(counts, by, group=group, samples=samples, seed=seed, method=method)
    long = _long(rows.filter("available"), by)
    return interval(long, "value", [*by, "metric"], few=True).withColumn(
        "requested_samples", F.lit(samples).cast("long")
    )


def paired_bootstrap_difference(
    scores: DataFrame,
    first: str,
    second: str,
    *,
    group: str = "question_id",
    samples: int = 1000,
    seed: int = 17,
    method: str = "poisson",
) -> DataFrame:
    """Return metric differences of two components under the same draws, with intervals."""
    pair = scores.filter(F.col("component").isin(first, second))

    def difference(metrics: DataFrame, keys: list[str]) -> DataFrame:
        long = _long(metrics.filter("available"), [*keys, "component"])
        sides = long.groupBy(*keys, "metric").agg(
            F.max(F.when(F.col("component") == first, F.col("value"))).alias("_a"),
            F.max(F.when(F.col("component") == second, F.col("value"))).alias("_b"),
        )
        return sides.select(*keys, "metric", (F.col("_a") - F.col("_b")).alias("value"))

    counts = materialize(score_counts(pair, ["component", group]))
    point = evaluate_counts(_merged(counts, ["component"]), ["component"])
    rows = replicate_metrics(
        counts, ["component"], group=group, samples=samples, seed=seed, method=method
    )
    edges = interval(difference(rows, ["replicate"]), "value", ["metric"], method="linear", few=True)
    observed = difference(point, []).select("metric", F.col("value").alias("point"))
    return observed.join(edges, "metric", "left")
