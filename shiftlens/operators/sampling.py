"""Deterministic balanced cohorts, grouped splits and seeded permutations."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.functions.ids import hash_order
from shiftlens.operators.joins import lookup_join, spread_join
from shiftlens.operators.ranking import first_k, rank_by_hash, round_robin_quota
from shiftlens.session import fits_broadcast, literal_rows, setting

# Up to this sample size Spark prunes ranks before the shuffle.
SMALL_SAMPLE = 1000


def _fail(condition: Column, message: Column, value: Column) -> Column:
    return F.when(condition, F.raise_error(message)).otherwise(value)


def balanced_select(
    df: DataFrame,
    strata: Sequence[str],
    n: int,
    seed: int,
    *,
    key: str = "question_id",
    outer: Sequence[str] = (),
    strict: bool = True,
) -> DataFrame:
    """Select ``n`` rows round-robin over sorted strata, in hash order inside a stratum.

    With ``outer`` columns every outer group gives ``n`` rows. ``turn`` is the round a row was
    taken in, so (turn, strata) is the selection order. ``strict`` fails when rows run short.

    ``key`` must be unique. Only keys and strata are ranked; whole rows are picked up by key at
    the end. A stratum never gives more than ``n`` rows, so for a small sample every task keeps
    just its first ``n`` keys of a stratum.
    """
    if n <= 0:
        raise ValueError("sample size must be positive")
    outer, strata = list(outer), list(strata)
    groups = [*outer, *strata]
    keys = df.select(*groups, key)
    if n <= SMALL_SAMPLE:
        hashed = keys.withColumn("_h", hash_order(seed, key))
        order = [F.col("_h"), F.col(key)]
        ranked = first_k(
            hashed, groups, order, n, salt=F.substring("_h", 1, 2), rank="turn"
        ).select(*groups, key, F.col("turn").cast("long").alias("turn"))
    else:
        ranked = rank_by_hash(keys, groups, key, seed, rank="turn")
    sizes = df.groupBy(*groups).agg(F.count("*").alias("size"))
    quota = round_robin_quota(sizes, outer, strata, n)
    taken = F.col("quota")
    if strict:
        text = F.concat(F.lit(f"need {n} rows, have "), F.col("total").cast("string"))
        taken = _fail(F.col("total") < n, text, taken)
    quota = quota.select(*groups, taken.alias("quota"))
    picked = ranked.join(quota, groups).filter(F.col("turn") <= F.col("quota"))
    return df.join(picked.select(key, "turn"), key)


def hash_top_k(df: DataFrame, k: int, seed: int, *, key: str) -> DataFrame:
    """Take the ``k`` rows with the smallest hash of (seed, key); fewer rows fail."""
    if k <= 0:
        raise ValueError("count must be positive")
    taken = df.orderBy(hash_order(seed, key), key).limit(k)
    found = F.count("*").over(Window.partitionBy(F.lit(0)))
    short = F.concat(F.lit(f"need {k} rows, have "), found.cast("string"))
    return taken.withColumn(key, _fail(found < k, short, F.col(key)))


def smoke_examples(examples: DataFrame, k: int, seed: int, *, key: str = "example_id"):
    """Take ``k`` known-wrong examples of a permanently excluded qualification cohort."""
    guarded = examples.withColumn(
        key,
        _fail(
            ~(
                (F.col("study_partition") == "qualification")
                & F.coalesce("excluded", F.lit(False))
            ),
            F.lit("smoke examples must come from the excluded qualification partition"),
            F.col(key),
        ),
    )
    return hash_top_k(guarded, k, seed, key=key)


def grouped_split(
    ids: DataFrame,
    fractions: tuple[float, float, float] = (0.6, 0.2, 0.2),
    seed: int = 17,
    *,
    key: str = "question_id",
) -> DataFrame:
    """Assign whole groups to train, validation and test with exact sizes."""
    shares = dict(zip(("train", "validation", "test"), fractions, strict=True))
    below = [name for name, share in shares.items() if share < 0]
    if below or not math.isclose(sum(fractions), 1.0, abs_tol=1e-9):
        raise ValueError(f"cannot split all groups into shares of {shares}")
    groups = ids.select(key).distinct()
    ranked = rank_by_hash(groups, [], key, seed)
    total = groups.agg(F.count("*").alias("_n"))
    train = F.bround(F.col("_n") * F.lit(fractions[0])).cast("long")
    valid = train + F.bround(F.col("_n") * F.lit(fractions[1])).cast("long")
    split = F.when(F.col("rn") <= train, "train").when(F.col("rn") <= valid, "validation")
    return ranked.crossJoin(F.broadcast(total)).select(
        key, split.otherwise("test").alias("split")
    )


def partition_assign(
    questions: DataFrame,
    *,
    qualification: int,
    allocations: dict[str, tuple[int, int, int]],
    partition_seed: int,
    split_seed: int,
    family: str = "family",
    key: str = "question_id",
) -> DataFrame:
    """Split each family into qualification and confirmatory, then train/validation/test.

    ``allocations`` maps a family to its (train, validation, test) counts; together they must
    use up the family's confirmatory questions: one too small fails the query, one too large is
    an error at once.
    """
    first = rank_by_hash(
        questions.select(key, family), [family], key, f"partition|{partition_seed}", rank="_p"
    )
    marked = first.withColumn(
        "study_partition",
        F.when(F.col("_p") <= qualification, "qualification").otherwise("confirmatory"),
    )
    rest = marked.filter(F.col("study_partition") == "confirmatory")
    ranked = rank_by_hash(rest, [family], key, f"monitor-split|{split_seed}", rank="_s")
    table = literal_rows(
        questions.sparkSession,
        [(name, a, a + b, a + b + c) for name, (a, b, c) in allocations.items()],
        f"{family} string, _a long, _b long, _c long",
    )
    sizes = questions.groupBy(family).agg(F.count("*").alias("_n"))
    left = F.greatest(F.coalesce("_n", F.lit(0)) - qualification, F.lit(0))
    unused = table.join(sizes, family, "left").filter(F.col("_c") > left).select(family)
    if names := [r[0] for r in unused.collect()]:  # a row per allocation at most
        raise ValueError(f"allocations are not used up: {', '.join(sorted(names))}")
    split = (
        F.when(F.col("_s") <= F.col("_a"), "train")
        .when(F.col("_s") <= F.col("_b"), "validation")
        .when(F.col("_s") <= F.col("_c"), "test")
        .otherwise(F.raise_error(F.concat(F.lit("allocation too small for "), F.col(family))))
    )
    placed = ranked.join(F.broadcast(table), family, "left").select(
        key, family, "study_partition", split.alias("split")
    )
    qualified = marked.filter(F.col("study_partition") == "qualification").select(
        key, family, "study_partition", F.lit(None).cast("string").alias("split")
    )
    return placed.unionByName(qualified)


def select_audit(examples: DataFrame, cap: int, seed: int) -> DataFrame:
    """Select secondary examples round-robin across kind, family and split, up to ``cap``."""
    secondary = F.col("kind").isin("correct_state_error", "corrupt_other_error")
    checked = examples.withColumn(
        "example_id",
        _fail(
            ~secondary | (F.col("binary_label") != 0),
            F.lit("secondary audit input contains a primary example"),
            F.col("example_id"),
        ),
    )
    return balanced_select(
        checked, ["kind", "family", "split"], cap, seed, key="example_id", strict=False
    )


def collection_balanced_sample(
    df: DataFrame, group: str, n: int, min_group: int, seed: int, *, key: str = "question_id"
) -> DataFrame:
    """Sample ``n`` rows round-robin over groups with at least ``min_group`` rows."""
    if min_group <= 0:
        raise ValueError("min_group must be positive")
    large = df.groupBy(group).agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_group)
    hot = None if fits_broadcast(large) else large.filter(F.col("_n") >= setting(df, "hotRows"))
    eligible = lookup_join(df, large.select(group), [group], hot=hot, row_id=key)
    return balanced_select(eligible, [group], n, seed, key=key).drop("turn")


def select_screened(
    questions: DataFrame,
    cells: DataFrame,
    per_family: int,
    seed: int,
    *,
    families: Sequence[str] | None = None,
) -> DataFrame:
    """Select ``per_family`` questions from eligible (family, tier) cells.

    Only the cell verdict is used, so the outcome of one question never moves its rank.
    """
    good = cells.filter("eligible").select("family", "tier")
    pool = spread_join(questions, good, ["family", "tier"], salt="question_id")
    if families is not None:
        pool = pool.filter(F.col("family").isin(*families))
    return balanced_select(
        pool, ["tier", "renderer_id"], per_family, seed, outer=["family"], strict=False
    )


def combine_screens(
    old_questions: DataFrame,
    old_cells: DataFrame,
    new_questions: DataFrame,
    new_cells: DataFrame,
    *,
    failed_family: str,
    per_family: int,
    seed: int,
) -> DataFrame:
    """Keep old eligible families and take the failed family from a fresh screen.

    The result carries ``valid``: exactly the named family failed the old screen and passed
    the new one.
    """
    kept = select_screened(
        old_questions.filter(F.col("family") != failed_family), old_cells, per_family, seed
    ).withColumn("screen", F.lit("prior"))
    fresh = select_screened(
        new_questions.filter(F.col("family") == failed_family), new_cells, per_family, seed
    ).withColumn("screen", F.lit("replacement"))
    verdict = old_cells.groupBy("family").agg(F.bool_or("eligible").alias("_ok"))
    old_ok = verdict.agg(
        F.bool_and(F.col("_ok") == (F.col("family") != failed_family)).alias("_old")
    )
    new_ok = new_cells.filter(F.col("family") == failed_family).agg(
        F.coalesce(F.bool_or("eligible"), F.lit(False)).alias("_new")
    )
    gate = old_ok.crossJoin(new_ok).select((F.col("_old") & F.col("_new")).alias("valid"))
    return kept.unionByName(fresh).crossJoin(F.broadcast(gate))


def permute_labels(
    df: DataFrame, label: str, seed: int, *, key: str = "example_id"
) -> DataFrame:
    """Permute labels over rows: same class counts, seeded, independent of partitioning."""
    rows = rank_by_hash(df.select(key), [], key, f"{seed}|rows", rank="_slot")
    labels = rank_by_hash(df.select(key, label), [], key, f"{seed}|labels", rank="_slot")
    return rows.join(
        labels.select("_slot", F.col(label).alias("permuted_label")), "_slot"
    ).select(key, "permuted_label")


def group_folds(
    df: DataFrame, folds: int, seed: int, *, group: str = "question_id", label: str = "label"
) -> DataFrame:
    """Assign whole groups to folds, balancing the class mix of the groups.

    Groups of the same size class and class mix are ordered by hash and dealt back and forth.
    """
    mix = df.groupBy(group).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    )
    ranked = rank_by_hash(mix, ["_pos", "_neg"], group, seed, rank="_rn")
    sizes = mix.groupBy("_pos", "_neg").agg(F.count("*").alias("_m"))
    order = Window.orderBy("_pos", "_neg").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_pos", "_neg", F.coalesce(F.sum("_m").over(order), F.lit(0)).alias("_start")
    )
    turn, step = F.expr(f"(_start + _rn - 1) div {folds}"), (F.col("_start") + F.col("_rn") - 1) % folds
    fold = F.when(turn % 2 == 0, step).otherwise(folds - 1 - step)
    placed = spread_join(ranked, starts, ["_pos", "_neg"], salt=group)
    return placed.select(group, fold.cast("int").alias("fold"))
