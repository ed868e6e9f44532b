"""Key lookups, key-set checks, plans and resumption."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.functions.ids import hash_order, stable_id
from shiftlens.functions.text import pick_wrong_option
from shiftlens.operators.ranking import rank_by_key
from shiftlens.schema import JUDGE_VIEWS
from shiftlens.session import fits_broadcast, materialize, setting, settle


def hot_keys(facts: DataFrame, on: Sequence[str]) -> DataFrame:
    """Return the keys holding at least ``hotRows`` facts; at most ``total / hotRows`` exist."""
    counts = facts.groupBy(*on).agg(F.count("*").alias("_n"))
    return counts.filter(F.col("_n") >= setting(facts, "hotRows")).select(*on)


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    *,
    hot: DataFrame | None = None,
    row_id: str | None = None,
) -> DataFrame:
    """Join many fact rows to at most one row per key.

    Without ``hot`` Spark chooses the join from the sizes. ``hot`` names the keys, few by
    construction, whose facts would fill one task: their lookup rows are broadcast, and their
    facts pass the shuffled join under their own ``row_id``, which matches nothing and spreads
    them evenly.
    """
    on = list(on)
    if hot is None:
        return facts.join(dim, on, how)
    values = [c for c in dim.columns if c not in on]
    keys = F.broadcast(hot.select(*on))
    few = dim.join(keys, on, "left_semi").select(
        *on, F.struct(F.lit(True).alias("hit"), *values).alias("_hot")
    )
    first = facts.join(F.broadcast(few), on, "left")
    cold = dim.select(*on, F.struct(F.lit(True).alias("hit"), *values).alias("_cold"))
    second = lookup_where(first, cold, on, F.col("_hot").isNull(), row_id)
    found = F.coalesce("_hot", "_cold")
    out = second.select(*facts.columns, found.alias("_found"))
    if how == "inner":
        out = out.filter(F.col("_found").isNotNull())
    order = [*on, *[c for c in facts.columns if c not in on]]
    return out.select(*order, *[F.col("_found")[c].alias(c) for c in values])


def lookup_where(
    facts: DataFrame, dim: DataFrame, on: Sequence[str], needed: Column, row_id: str
) -> DataFrame:
    """Left-join lookup rows to the facts that need them; the others keep nulls.

    Facts that need nothing are keyed by their own id, so they do not gather under a null key.
    """
    marked = facts.withColumn("_own", F.when(~needed, F.col(row_id)))
    kind = facts.schema[row_id].dataType
    side = dim.select(
        F.lit(None).cast(kind).alias("_dim_own"),
        *[F.col(c).alias(f"_dim_{c}") for c in on],
        *[c for c in dim.columns if c not in on],
    )
    match = F.col("_own").eqNullSafe(F.col("_dim_own"))
    for c in on:
        match = match & (F.col(c) == F.col(f"_dim_{c}"))
    return marked.join(side, match, "left").drop(
        "_own", "_dim_own", *[f"_dim_{c}" for c in on]
    )


def spread_join(
    facts: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "inner", *, salt: str
) -> DataFrame:
    """Join many fact rows on keys of few values, which alone would fill few tasks.

    A lookup table within the broadcast threshold is broadcast. Beyond it each lookup row goes to
    every part of its key, and a fact to one part, by the hash of its ``salt`` column; so ``dim``
    should be small in rows, as it is where a key has few values.
    """
    on = list(on)
    if fits_broadcast(dim):
        return facts.join(F.broadcast(dim), on, how)
    parts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    placed = facts.withColumn("_part", F.pmod(F.xxhash64(salt), F.lit(parts)).cast("int"))
    joined = placed.join(dim.withColumn("_part", every), [*on, "_part"], how)
    return joined.drop("_part")


def attach(
    facts: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    *,
    row_id: str,
) -> DataFrame:
    """Join a lookup table of unknown size: broadcast if it fits, else hot keys apart."""
    hot = None if fits_broadcast(dim) else hot_keys(facts, on)
    return lookup_join(facts, dim, on, how, hot=hot, row_id=row_id)


def enrich(
    rollouts: DataFrame,
    questions: DataFrame,
    *,
    key: str = "question_id",
    row_id: str = "rollout_id",
) -> DataFrame:
    """Attach question columns to rollouts and mark keys the question table lacks.

    A question table beyond the broadcast threshold is shuffled, hot questions excepted.
    """
    dim = questions.withColumn("known_question", F.lit(True))
    clash = [c for c in questions.columns if c in rollouts.columns and c != key]
    joined = attach(rollouts, dim.drop(*clash), [key], "left", row_id=row_id)
    return joined.withColumn("known_question", F.coalesce("known_question", F.lit(False)))


def unknown_keys(rollouts: DataFrame, questions: DataFrame, *, key: str = "question_id"):
    """Return keys of the facts that the question table lacks, with their row counts."""
    counts = rollouts.groupBy(key).agg(F.count("*").alias("rows"))
    return counts.join(questions.select(key), key, "left_anti")


def same_key_set(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Report keys that are duplicated or present on one side only; empty means equal sets."""
    a = left.groupBy(key).agg(F.count("*").alias("left_rows"))
    b = right.groupBy(key).agg(F.count("*").alias("right_rows"))
    merged = a.join(b, key, "full_outer").select(
        key,
        F.coalesce("left_rows", F.lit(0)).alias("left_rows"),
        F.coalesce("right_rows", F.lit(0)).alias("right_rows"),
    )
    return merged.filter("left_rows <> 1 OR right_rows <> 1").withColumn(
        "problem",
        F.expr(
            "CASE WHEN left_rows = 0 THEN 'missing_left' WHEN right_rows = 0 THEN 'missing_right' "
            "ELSE 'duplicate' END"
        ),
    )


def coverage(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Compare planned and stored identities both ways; empty means exact coverage."""
    keys = list(keys)
    a = expected.groupBy(*keys).agg(F.count("*").alias("expected_rows"))
    b = observed.groupBy(*keys).agg(F.count("*").alias("observed_rows"))
    merged = a.join(b, keys, "full_outer").select(
        *keys,
        F.coalesce("expected_rows", F.lit(0)).alias("expected_rows"),
        F.coalesce("observed_rows", F.lit(0)).alias("observed_rows"),
    )
    return merged.filter("expected_rows <> observed_rows OR observed_rows > 1")


def compare_fields(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Report (key, value) fields whose expected and observed values differ, nulls included."""
    keys = list(keys)
    a = expected.select(*keys, F.col("value").alias("expected"))
    b = actual.select(*keys, F.col("value").alias("actual"))
    return a.join(b, keys, "full_outer").filter(~F.col("expected").eqNullSafe(F.col("actual")))


def pending_work(
    plan: DataFrame,
    done: DataFrame,
    *,
    model: str,
    id_col: str = "rollout_id",
    retry_truncated: bool = False,
    config_sha256: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """Return planned work without a usable stored result.

    A stored result counts when its model matches and it carries a provider request id;
    truncated results are tried again on request. With ``config_sha256`` (see
    ``digests.config_digest``) results of another configuration do not count; ``strict`` refuses a
    store that :func:`resume_problems` finds anything in.
    """
    if strict:
        found = resume_problems(plan, done, id_col=id_col, config_sha256=config_sha256)
        if rows := found.take(1):
            raise ValueError(f"cannot resume: {rows[0]['problem']} {rows[0][id_col]}")
    if config_sha256 is not None:
        done = done.filter(F.col("config_sha256") == config_sha256)
    usable = done.filter(
        (F.col("model") == model)
        & F.col("provider_request_id").isNotNull()
        & (F.col("provider_request_id") != "")
    )
    if retry_truncated:
        usable = usable.filter(F.col("status") != "length_truncated")
    return plan.join(usable.select(id_col), id_col, "left_anti")


def resume_problems(
    plan: DataFrame, done: DataFrame, *, id_col: str = "rollout_id", config_sha256: str | None = None
) -> DataFrame:
    """Return what forbids to resume from stored results: one row per id and problem.

    Ids stored twice, ids outside the plan and, with ``config_sha256``, results of another
    configuration (or of none).
    """
    other = F.lit(False) if config_sha256 is None else ~F.col("config_sha256").eqNullSafe(F.lit(config_sha256))
    stored = done.groupBy(id_col).agg(F.count("*").alias("_n"), F.count_if(other).alias("_other"))
    planned = plan.select(id_col).distinct().withColumn("_planned", F.lit(True))
    problems = F.array_compact(F.array(
        F.when(F.col("_n") > 1, "duplicate_id"),
        F.when(F.col("_planned").isNull(), "outside_plan"),
        F.when(F.col("_other") > 0, "different_configuration"),
    ))
    return stored.join(planned, id_col, "left").select(id_col, F.explode(problems).alias("problem"))


def outside_plan(plan: DataFrame, done: DataFrame, *, id_col: str = "rollout_id") -> DataFrame:
    """Return stored results whose identity is not in the plan."""
    return done.join(plan.select(id_col), id_col, "left_anti")


def overlap(fresh: DataFrame, *prior: DataFrame, key: str = "question_id") -> DataFrame:
    """Return fresh keys that an earlier collection already used; must be empty."""
    used = prior[0].select(key)
    for other in prior[1:]:
        used = used.unionByName(other.select(key))
    return fresh.select(key).distinct().join(used.distinct(), key, "left_semi")


def label_join(rollouts: DataFrame, shifts: DataFrame) -> DataFrame:
    """Attach the answer shift of (question, hinted option)."""
    evidence = shifts.select("question_id", "hinted_option", "hint_effect", "lower_bound_95")
    keys = ["question_id", "hinted_option"]
    return attach(rollouts, evidence, keys, "left", row_id="rollout_id")


def component_matrix(scores: DataFrame, components: Sequence[str]) -> DataFrame:
    """Turn long component scores into one row per example, all components required."""
    wide = scores.groupBy("example_id").pivot("component", list(components)).agg(F.max("score"))
    checked = [
        F.when(
            F.col(c).isNull(), F.raise_error(F.concat(F.lit(f"no {c} score: "), "example_id"))
        )
        .otherwise(F.col(c))
        .cast("double")
        .alias(c)
        for c in components
    ]
    return wide.select("example_id", *checked)


def missing_components(scores: DataFrame, components: Sequence[str]) -> DataFrame:
    """Return examples lacking a component, with the list of what they lack."""
    have = scores.groupBy("example_id").agg(F.collect_set("component").alias("_have"))
    wanted = F.array(*[F.lit(c) for c in components])
    return have.select(
        "example_id", F.array_sort(F.array_except(wanted, "_have")).alias("missing")
    ).filter(F.size("missing") > 0)


def collection_plan(
    questions: DataFrame,
    conditions: Sequence[str],
    *,
    samples: int,
    base_seed: int,
    model: str,
    group: str = "template_group",
    choices: bool = False,
    points: Sequence | None = None,
) -> DataFrame:
    """Build the full factorial of question, condition and sample with logical seeds.

    Rows sorted by (sample_index, round, group, condition_index) interleave the groups. With
    ``choices`` the questions are multiple choice: they keep their own order, and each gets a
    ``hinted_option``, wrong options taken in turn by question index.
    """
    if samples <= 0:
        raise ValueError("samples must be positive")
    hints = ["options", "gold_answer"] if choices else []
    base = questions.select(
        "question_id", F.coalesce(group, F.lit("unknown")).alias(group), *hints
    )
    numbered = rank_by_key(base, [], "question_id", rank="_i", points=points)
    if choices:
        turns = numbered.withColumn("round", F.col("_i"))
    else:
        turns = rank_by_key(numbered, [group], "question_id", rank="round", points=points)
    arms = F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(conditions)]
    )
    filled = turns.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample_index")
    ).select("*", F.explode(arms).alias("_arm"))
    seed = (
        F.lit(base_seed)
        + (F.col("_i") - 1) * 1000
        + F.col("_arm.i") * 100
        + F.col("sample_index")
    ).cast("long")
    planned = filled.select(
        F.col("sample_index").cast("long"),
        "round",
        group,
        F.col("_arm.i").cast("long").alias("condition_index"),
        "question_id",
        F.col("_arm.c").alias("condition"),
        seed.alias("seed"),
        *[
            pick_wrong_option(F.col("options"), F.col("gold_answer"), F.col("_i") - 1).alias(
                "hinted_option"
            )
            for _ in hints[:1]
        ],
    )
    return planned.withColumn(
        "rollout_id", stable_id("question_id", "condition", "seed", F.lit(model))
    )


def judge_plan(
    examples: DataFrame,
    *,
    model: str,
    prompt_version: str,
    base_seed: int,
    points: Sequence | None = None,
) -> DataFrame:
    """Plan one scoring request per example and evidence view."""
    numbered = rank_by_key(
        examples.select("example_id"), [], "example_id", rank="_i", points=points
    )
    views = F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(JUDGE_VIEWS)]
    )
    seed = (F.lit(base_seed) + (F.col("_i") - 1) * 10 + F.col("_v.i")).cast("long")
    planned = numbered.select("*", F.explode(views).alias("_v")).select(
        "example_id", F.col("_v.v").alias("view"), seed.alias("seed")
    )
    return planned.withColumn(
        "score_id",
        stable_id(
            "example_id", "view", F.lit(model), F.lit(prompt_version), "seed", length=24
        ),
    )


def transfer_threshold(
    scores: DataFrame, thresholds: DataFrame, by: Sequence[str] = ("component",)
) -> DataFrame:
    """Apply thresholds chosen elsewhere once and return recall and false-positive rate."""
    by = list(by)
    hit = F.col("score") >= F.col("threshold")
    # Counts by score first: they are combined before any shuffle, and spread by score.
    sums = scores.groupBy(*by, "score").agg(
        F.count_if(F.col("label") == 1).alias("_pos"), F.count_if(F.col("label") == 0).alias("_neg")
    )
    joined = spread_join(sums, thresholds.select(*by, "threshold"), by, salt="score")
    counts = joined.groupBy(*by).agg(
        F.max("threshold").alias("threshold"),
        F.sum("_pos").alias("positives"),
        F.sum("_neg").alias("negatives"),
        F.coalesce(F.sum(F.when(hit, F.col("_pos"))), F.lit(0)).alias("true_positives"),
        F.coalesce(F.sum(F.when(hit, F.col("_neg"))), F.lit(0)).alias("false_positives"),
    )
    return counts.select(
        "*",
        F.try_divide("true_positives", "positives").alias("recall"),
        F.try_divide("false_positives", "negatives").alias("false_positive_rate"),
    )


def _open_cells(open_cases: DataFrame, cells: DataFrame) -> DataFrame:
    """Give each open case the pool's cells at its nearest level that it may still ask.

    A level is (tier distance, renderer mismatch). A case without any cell left fails the query.
    """
    mine = F.struct(
        F.abs(F.col("_t") - F.col("tier_rank")).cast("long").alias("distance"),
        (~F.col("_r").eqNullSafe(F.col("renderer_id"))).cast("long").alias("mismatch"),
    )
    levels = open_cases.join(cells, "family", "left").withColumn("level", mine)
    levels = levels.filter(F.col("_t").isNull() | (F.col("level") >= F.col("floor")))
    nearest = Window.partitionBy("case_index")
    near = levels.withColumn("_first", F.min("level").over(nearest)).filter(
        F.col("_t").isNull() | (F.col("level") == F.col("_first"))
    )
    asked = near.select("case_index", "family", "_t", "_r", "level", "after")
    short = open_cases.join(asked, "case_index", "left_anti").select("case_index")
    lost = short.unionByName(asked.filter("_t IS NULL").select("case_index"))
    if not lost.isEmpty():
        raise ValueError("no unused control remains")
    return asked


def matched_controls(
    cases: DataFrame, pool: DataFrame, *, seed: int, pairs: int
) -> DataFrame:
    """Give each case the nearest unused control of its family, in case order.

    ``cases`` has ``case_index`` 0..pairs-1, ``case_id``, ``family``, ``tier_rank``,
    ``renderer_id``; ``pool`` has ``control_id`` and the same attributes. Nearness is (tier
    distance, renderer mismatch, hash of seed + case index and control id).

    Cases propose in rounds: each open case to the nearest control that has not refused it, in the
    nearest (tier, renderer) cells of the pool only; a control keeps its earliest case. This ends
    where serving the cases in order would. A round reads the pool once, finds the best control of
    a case by partial minima, and writes one row per case.
    """
    beyond = F.col("case_index") >= pairs
    first = F.struct(F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("mismatch"))
    number = F.when(beyond, F.raise_error(F.lit("more cases than pairs"))).otherwise(F.col("case_index"))
    key = "struct<tie:string,control_id:string>"
    state = materialize(
        cases.select(
            number.cast("long").alias("case_index"), "case_id", "family", "tier_rank", "renderer_id",
            first.alias("floor"), F.lit(None).cast(key).alias("after"), F.lit(False).alias("held"),
        )
    )
    pool = settle(
        pool.select("control_id", "family", F.col("tier_rank").alias("_t"), F.col("renderer_id").alias("_r"))
    )
    cells = materialize(pool.select("family", "_t", "_r").distinct())
    while True:
        waiting = state.filter("NOT held")
        if waiting.isEmpty():
            break
        asked = materialize(_open_cells(waiting, cells))
        tie = hash_order((F.lit(seed) + F.col("case_index")).cast("long"), "control_id")
        seen = spread_join(pool, asked, ["family", "_t", "_r"], salt="control_id").withColumn(
            "key", F.struct(tie.alias("tie"), F.col("control_id"))
        )
        best = seen.filter(F.col("after").isNull() | (F.col("key") > F.col("after"))).groupBy(
            "case_index"
        ).agg(F.min("key").alias("key"))
        levels = asked.groupBy("case_index").agg(F.first("level").alias("level"))
        turns = waiting.drop("held").join(levels, "case_index").join(best, "case_index", "left")
        # A level that has no control left hands over to the next one.
        beyond_level = F.struct(
            F.col("level.distance").alias("distance"), (F.col("level.mismatch") + 1).alias("mismatch")
        )
        none = F.col("key").isNull()
        moved = turns.select(
            "case_index", "case_id", "family", "tier_rank", "renderer_id",
            F.when(none, beyond_level).otherwise(F.col("level")).alias("floor"),
            F.col("key").alias("after"), (~none).alias("held"),
        )
        offers = materialize(state.filter("held").unionByName(moved))
        winners = offers.filter("held").groupBy(F.col("after.control_id").alias("_c")).agg(
            F.min("case_index").alias("_w")
        )
        kept = offers.join(winners, F.col("after.control_id") == F.col("_c"), "left")
        held = F.col("held") & (F.col("case_index") == F.col("_w"))
        state = materialize(
            kept.select(*[c for c in offers.columns if c != "held"], F.coalesce(held, F.lit(False)).alias("held"))
        )
    return state.select(
        "case_index", "case_id", F.col("after.control_id").alias("control_id"), "family",
        F.col("floor.distance").alias("distance"), F.col("floor.mismatch").alias("mismatch"),
    )
