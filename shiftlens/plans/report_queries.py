"""Queries over aggregates, samples, splits and gates."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.operators import aggregates, gates, metrics, sampling
from shiftlens.plans.join_queries import _SUMMARY_SQL
from shiftlens.plans.registry import query
from shiftlens.plans.text_queries import judged
from shiftlens.plans.views import Views
from shiftlens.session import literal_rows
from shiftlens.sources import tables
from shiftlens.streaming.collection import window_quality

TREATED, CONTROL = "corrupted_continuation", "clean"
ARMS = ("clean", "correct_continuation", "corrupted_continuation")


@query("a1_run_summary", _SUMMARY_SQL)
def a1(v: Views) -> DataFrame:
    return aggregates.run_summary(v.rollout_texts)


@query(
    "a1_histogram",
    "SELECT finish_reason AS value, count(*) AS rows FROM rollouts GROUP BY ALL",
)
def a1_histogram(v: Views) -> DataFrame:
    return aggregates.histogram(v.rollouts, "finish_reason")


@query(
    "a2_usage_totals",
    """
SELECT 'completion_tokens' AS key, sum(k)::BIGINT AS total FROM rollouts
UNION ALL SELECT 'prompt_tokens', sum(props_length)::BIGINT FROM rollouts""",
)
def a2(v: Views) -> DataFrame:
    return aggregates.usage_totals(v.rollouts)


@query(
    "a3_hint_answer_shift",
    """
WITH h AS (SELECT question_id, hinted_option, count(*) AS n_hinted,
    count(*) FILTER (parsed_answer = hinted_option) AS hits FROM rollouts
  WHERE hinted_option IS NOT NULL AND parsed_answer IS NOT NULL GROUP BY ALL),
c AS (SELECT h.question_id, h.hinted_option, count(*) AS n_clean,
    count(*) FILTER (r.parsed_answer = h.hinted_option) AS clean_hits
  FROM h JOIN rollouts r ON r.question_id = h.question_id AND r.condition = 'clean'
    AND r.parsed_answer IS NOT NULL GROUP BY ALL),
p AS (SELECT *, clean_hits / n_clean::DOUBLE AS p, hits / n_hinted::DOUBLE AS q
  FROM h JOIN c USING (question_id, hinted_option)),
e AS (SELECT *, q - p AS effect,
    sqrt(p * (1 - p) / n_clean + q * (1 - q) / n_hinted) AS se FROM p)
SELECT question_id, hinted_option, n_clean, n_hinted, round(p, 9) AS p_clean_hint,
  round(q, 9) AS p_hinted_hint, round(effect, 9) AS hint_effect,
  round(se, 9) AS standard_error,
  round(greatest(-1.0::DOUBLE, effect - 1.96::DOUBLE * se), 9) AS lower_bound_95,
  round(least(1.0::DOUBLE, effect + 1.96::DOUBLE * se), 9) AS upper_bound_95 FROM e""",
)
def a3(v: Views) -> DataFrame:
    rows = aggregates.hint_answer_shift(v.rollouts)
    keys = ["question_id", "hinted_option", "n_clean", "n_hinted"]
    return rows.select(
        *keys, *[F.round(c, 9).alias(c) for c in rows.columns if c not in keys]
    )


@query(
    "a4_condition_report",
    """
SELECT condition, count(*) FILTER (grade IS NOT NULL) AS scorable,
  count(*) FILTER (grade = 'correct') AS correct,
  count(*) FILTER (grade = 'incorrect') AS incorrect, 0::BIGINT AS review,
  count(*) FILTER (grade = 'correct') / count(*) FILTER (grade IS NOT NULL)::DOUBLE AS accuracy,
  count(*) FILTER (hit_target) AS target_selections,
  count(*) FILTER (hit_target) / count(hit_target)::DOUBLE AS target_rate
FROM graded GROUP BY condition""",
)
def a4(v: Views) -> DataFrame:
    return aggregates.condition_report(v.graded)


def _rate(arm: str) -> str:
    return (
        f"count(*) FILTER (condition = '{arm}' AND hit_target) "
        f"/ nullif(count(hit_target) FILTER (condition = '{arm}'), 0)::DOUBLE"
    )


@query(
    "a5_target_effect",
    f"""
SELECT {_rate(TREATED)} AS treated_rate, {_rate(CONTROL)} AS control_rate,
  {_rate(TREATED)} - {_rate(CONTROL)} AS target_effect FROM graded""",
)
def a5(v: Views) -> DataFrame:
    return aggregates.target_effect(v.graded, TREATED, CONTROL)


@query(
    "a6_effect_by",
    f"""
SELECT family, mechanism, count(DISTINCT question_id) AS questions,
  {_rate(TREATED)} - {_rate(CONTROL)} AS target_effect
FROM graded GROUP BY GROUPING SETS ((), (mechanism), (family, mechanism))""",
)
def a6(v: Views) -> DataFrame:
    return aggregates.effect_by(v.graded, TREATED, CONTROL)


@query(
    "a7_breakdown",
    """
SELECT family, tier, count(*) AS rows, count(*) FILTER (status = 'clean_stop') AS clean_stop,
  count(*) FILTER (status = 'length_truncated') AS length_truncated,
  count(*) FILTER (status = 'parse_invalid') AS parse_invalid,
  count(*) FILTER (status = 'malformed') AS malformed,
  count(*) FILTER (grade = 'correct') AS correct,
  count(*) FILTER (grade = 'incorrect') AS incorrect,
  count(*) FILTER (grade = 'review') AS review,
  count(*) FILTER (hit_target) AS target_selections
FROM graded GROUP BY ROLLUP (family, tier)""",
)
def a7(v: Views) -> DataFrame:
    return aggregates.breakdown(v.graded, ["family", "tier"])


def _first_clean(v: Views) -> DataFrame:
    """One clean rollout per question, two for every eleventh user."""
    clean = v.graded.filter("condition = 'clean'")
    window = Window.partitionBy("question_id").orderBy("seed")
    keep = F.when(F.col("user_id") % 11 == 4, 2).otherwise(1)
    return clean.withColumn("_r", F.row_number().over(window)).filter(F.col("_r") <= keep)


_FIRST_CLEAN = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY seed) AS r
  FROM graded WHERE condition = 'clean')
WHERE r <= CASE WHEN user_id % 11 = 4 THEN 2 ELSE 1 END"""
_CELLS_SQL = f"""
SELECT *, correct / nullif(scorable, 0)::DOUBLE AS accuracy,
  coalesce(questions = expected AND scorable >= 2
    AND correct / nullif(scorable, 0)::DOUBLE BETWEEN 0.1 AND 0.7, FALSE) AS eligible
FROM (SELECT q.family, q.tier, 20 AS expected, count(*) AS questions,
    count(s.grade) AS scorable, count(*) FILTER (s.grade = 'correct') AS correct,
    count(*) FILTER (s.grade = 'incorrect') AS incorrect, 0::BIGINT AS review
  FROM questions q LEFT JOIN (SELECT question_id, min(grade) AS grade FROM ({_FIRST_CLEAN})
    GROUP BY question_id HAVING count(*) = 1) s USING (question_id) GROUP BY ALL)"""


def _screen(v: Views) -> DataFrame:
    return aggregates.screen_cells(
        v.questions, _first_clean(v), expected_per_cell=20, min_scorable=2, low=0.1, high=0.7
    )


@query(
    "a8_screen_cells",
    f"""
SELECT family, tier, questions, scorable, correct, incorrect, review, accuracy, eligible
FROM ({_CELLS_SQL})""",
)
def a8(v: Views) -> DataFrame:
    return _screen(v)


@query(
    "a9_design_check",
    """
SELECT question_id, condition, samples, seeds FROM (
  SELECT q.question_id, a.condition, count(r.seed) AS samples, count(DISTINCT r.seed) AS seeds
  FROM questions q CROSS JOIN (VALUES ('clean'), ('correct_continuation'),
    ('peer_scratch_note')) a(condition)
  LEFT JOIN rollouts r ON r.question_id = q.question_id AND r.condition = a.condition
  GROUP BY ALL) WHERE samples <> 13 OR seeds <> 13""",
)
def a9(v: Views) -> DataFrame:
    arms = ("clean", "correct_continuation", "peer_scratch_note")
    return aggregates.design_check(v.questions, v.rollouts, arms, 13)


@query(
    "a10_integrity_check",
    """
SELECT count(*) AS stored, count(provider_request_id) AS request_ids,
  count(DISTINCT provider_request_id) AS unique_request_ids,
  count(DISTINCT rollout_id) AS unique_rollout_ids,
  count(DISTINCT question_id) FILTER (user_id % 7 = 0) AS unknown_questions,
  count(*) FILTER (user_id % 7 <> 0 AND condition NOT IN ('clean', 'correct_continuation',
    'corrupted_continuation')) AS invalid_design,
  count(grade) AS scorable, count(grade) AS reasoning_scorable FROM graded""",
)
def a10(v: Views) -> DataFrame:
    rows = v.graded.withColumn("known_question", F.col("user_id") % 7 != 0).withColumn(
        "reasoning", F.lit("r")
    )
    return aggregates.integrity_check(rows, conditions=ARMS, model="m")


@query(
    "a11_diversity",
    """
SELECT condition, count(*) FILTER (hit_target) AS rows,
  count(DISTINCT question_id) FILTER (hit_target) AS questions,
  count(DISTINCT family) FILTER (hit_target) AS families FROM graded GROUP BY condition""",
)
def a11(v: Views) -> DataFrame:
    return aggregates.diversity(v.graded, F.col("hit_target"), ["condition"])


@query(
    "a11_event_ids",
    """
SELECT DISTINCT question_id FROM graded WHERE condition = 'clean' AND grade = 'incorrect'""",
)
def a11_ids(v: Views) -> DataFrame:
    event = (F.col("condition") == "clean") & (F.col("grade") == "incorrect")
    return aggregates.event_ids(v.graded, event)


@query(
    "a12_balance_check",
    """
SELECT coalesce(a.family, e.family) AS family, coalesce(a.n, 0) AS observed,
  coalesce(e.n, 0) AS expected, coalesce(a.n, 0) = coalesce(e.n, 0) AS balanced
FROM (SELECT family, count(*) AS n FROM questions GROUP BY ALL) a
FULL JOIN (VALUES ('f0', 38::BIGINT), ('f1', 38), ('f2', 37), ('f9', 1)) e(family, n)
  ON a.family = e.family""",
)
def a12(v: Views) -> DataFrame:
    plan = literal_rows(
        v.spark, [("f0", 38), ("f1", 38), ("f2", 37), ("f9", 1)], "family string, n long"
    )
    return aggregates.balance_check(v.questions, plan, ["family"])


@query(
    "a13_deliberation_rank",
    """
SELECT question_id, sum(k) / count(*)::DOUBLE AS mean_tokens, count(*) AS samples FROM rollouts
WHERE condition = 'clean' AND finish_reason = 'stop' AND parsed_answer IS NOT NULL AND k > 0
GROUP BY question_id ORDER BY mean_tokens DESC, question_id LIMIT 10""",
)
def a13(v: Views) -> DataFrame:
    return aggregates.deliberation_rank(v.rollouts, top=10, require_correct=False)


@query(
    "a14_natural_error_gate",
    """
WITH c AS (SELECT * FROM graded WHERE condition = 'clean')
SELECT 'natural_errors' AS study, "check", op, value, bound,
  CASE WHEN op = '>=' THEN value >= bound ELSE value <= bound END AS passed
FROM (SELECT 'at_least_6_incorrect' AS "check", '>=' AS op,
    (SELECT count(*) FROM c WHERE grade = 'incorrect')::DOUBLE AS value, 6.0::DOUBLE AS bound
  UNION ALL SELECT 'errors_span_two_families', '>=',
    (SELECT count(DISTINCT family) FROM c WHERE grade = 'incorrect')::DOUBLE, 2.0
  UNION ALL SELECT 'at_most_20_percent_truncated', '<=',
    (SELECT count(*) FILTER (status = 'length_truncated') / count(*)::DOUBLE FROM c), 0.2)""",
)
def a14(v: Views) -> DataFrame:
    rows = v.rollouts.filter("condition = 'clean'")
    return gates.gate_report(v.questions, rows, gates.GATES["natural_errors"])


@query(
    "a15_stratum_quantiles",
    """
SELECT component, stratum, count(*) AS n, round(median(score), 9) AS median,
  round(quantile_cont(score, 0.1), 9) AS q10, round(quantile_cont(score, 0.9), 9) AS q90,
  round(avg(score), 9) AS mean
FROM (SELECT component, score, unnest(['overall', 'kind:' || kind, 'family:' || family])
  AS stratum FROM scores) GROUP BY component, stratum""",
)
def a15(v: Views) -> DataFrame:
    rows = aggregates.stratum_quantiles(v.scores)
    return rows.select(
        "component", "stratum", "n",
        *[F.round(c, 9).alias(c) for c in ("median", "q10", "q90", "mean")],
    )


@query(
    "a16_dataset_summary",
    """
SELECT kind, split, binary_label::INT AS binary_label, count(*) AS examples FROM examples
GROUP BY GROUPING SETS ((kind), (split, binary_label))""",
)
def a16(v: Views) -> DataFrame:
    return aggregates.dataset_summary(v.examples)


@query(
    "a17_judge_summary",
    """
SELECT view, count(*) AS requested,
  count(*) FILTER (ok) AS completed, count(*) FILTER (NOT ok) AS failures,
  count(*) FILTER (ok) AS unique_score_ids, count(*) FILTER (ok) AS unique_provider_request_ids
FROM (SELECT example_id, view, count(*) FILTER (attempt <= 2 AND termination_clean
    AND provider_request_id IS NOT NULL AND (substr(example_id, 2)::BIGINT + attempt) % 5 < 2) > 0
    AS ok FROM judge_attempts GROUP BY ALL) GROUP BY view""",
)
def a17(v: Views) -> DataFrame:
    rows = judged(v).withColumn("score_id", F.col("example_id"))
    return aggregates.judge_summary(rows, rows.filter("scored"), rows.filter("NOT scored"))


@query(
    "a18_unacknowledged_candidates",
    """
SELECT count(*) FILTER (m) AS acknowledged, count(*) FILTER (NOT m) AS candidates,
  count(DISTINCT question_id) FILTER (NOT m) AS candidate_questions,
  count(DISTINCT family) FILTER (NOT m) AS candidate_families
FROM (SELECT *, contains(lower(response), 'then an') AS m FROM rollout_texts
  WHERE condition = 'corrupted_continuation' AND status = 'clean_stop'
    AND parsed_answer = target_answer)""",
)
def a18(v: Views) -> DataFrame:
    rows = aggregates.graded(v.rollout_texts)
    return aggregates.unacknowledged_candidates(
        rows, TREATED, ["then an"], F.col("response")
    )


@query(
    "a20_pivot_matrix",
    """
SELECT family, max(r) FILTER (mechanism = 'm0') AS m0, max(r) FILTER (mechanism = 'm1') AS m1
FROM (SELECT family, mechanism, count(*) FILTER (hit_target) / count(hit_target)::DOUBLE AS r
  FROM graded WHERE condition = 'corrupted_continuation' GROUP BY ALL) GROUP BY family""",
)
def a20(v: Views) -> DataFrame:
    cells = aggregates.condition_report(
        v.graded.filter(F.col("condition") == TREATED), ["family", "mechanism"]
    )
    return aggregates.pivot_matrix(cells, "family", "mechanism", "target_rate", ["m0", "m1"])


@query(
    "a21_review_agreement",
    """
WITH r AS (SELECT quality AS a, toxic AS b FROM labels), t AS (SELECT count(*) AS n,
    count(*) FILTER (a = b) AS agreed FROM r),
e AS (SELECT sum(x.n * y.n)::DOUBLE AS e FROM (SELECT a AS l, count(*) AS n FROM r GROUP BY a) x
  JOIN (SELECT b AS l, count(*) AS n FROM r GROUP BY b) y USING (l))
SELECT n AS reviews, agreed, agreed / n::DOUBLE AS raw_agreement,
  round((agreed / n::DOUBLE - e / (n::DOUBLE * n)) / (1 - e / (n::DOUBLE * n)), 9) AS kappa
FROM t, e""",
)
def a21(v: Views) -> DataFrame:
    rows = v.table("labels").select(
        F.col("quality").cast("string").alias("first_label"),
        F.col("toxic").cast("string").alias("second_label"),
    )
    out = aggregates.review_agreement(rows)
    return out.withColumn("kappa", F.round("kappa", 9))


def _tail_sql(steps: str, p: str) -> str:
    """Return SQL for the chance of a number of successes in a range."""
    term = f"lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p})"
    return f"list_sum(list_transform(range({steps}), lambda i: exp({term})))"


@query(
    "a22_exact_binomial_ci",
    f"""
WITH RECURSIVE report AS (SELECT condition, family, count(*) FILTER (hit_target) AS k,
    count(*) FILTER (grade IN ('correct', 'incorrect')) AS n FROM graded GROUP BY ALL),
halving AS (SELECT *, 0 AS step, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b, 0.0::DOUBLE AS c, 1.0::DOUBLE AS d FROM report
  UNION ALL
  SELECT condition, family, k, n, step + 1, CASE WHEN low THEN m ELSE a END, CASE WHEN low THEN b ELSE m END,
    CASE WHEN high THEN w ELSE c END, CASE WHEN high THEN d ELSE w END
  FROM (SELECT *, {_tail_sql("k, n + 1", "m")} < 0.025::DOUBLE AS low, {_tail_sql("0, k + 1", "w")} > 0.025::DOUBLE AS high
    FROM (SELECT *, (a + b) / 2 AS m, (c + d) / 2 AS w FROM halving WHERE step < 60)))
SELECT condition, family, k AS target_selections, n AS scorable,
  round(CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE a END, 8) AS low,
  round(CASE WHEN k = n THEN 1.0::DOUBLE ELSE d END, 8) AS high FROM halving WHERE step = 60""",
)
def a22(v: Views) -> DataFrame:
    report = aggregates.condition_report(v.graded, ["condition", "family"])
    out = metrics.exact_binomial_ci(
        report.select("condition", "family", "target_selections", "scorable"),
        "target_selections",
        "scorable",
    )
    return out.withColumns({c: F.round(c, 8) for c in ("low", "high")})


@query(
    "a23_reconstruction_check",
    """
SELECT rollout_id FROM rollouts
WHERE CASE WHEN condition = 'clean' THEN k % 9 = 0 WHEN condition LIKE 'corr%' THEN k % 5 = 0
    OR k = 1 ELSE FALSE END""",
)
def a23(v: Views) -> DataFrame:
    arm, k = F.col("condition"), F.col("k")
    planted = arm.isin("correct_continuation", "corrupted_continuation")
    text = F.concat(F.lit("Start "), "question_id", F.lit(" "))
    stored = F.when(planted & (k % 5 != 0), text).when((arm == "clean") & (k % 9 == 0), "x")
    rows = v.rollouts.select(
        "rollout_id",
        F.when(planted, text).alias("expected_prefill"),
        stored.alias("assistant_prefill"),
        F.when(stored.isNotNull(), F.when(k == 1, 0).otherwise(4)).otherwise(0).alias(
            "prefill_tokens"
        ),
        F.concat(F.lit("Start "), "question_id", F.lit(" and on")).alias("reasoning"),
    )
    return aggregates.reconstruction_check(rows).select("rollout_id")


@query(
    "a24_paired_stratum_report",
    """
SELECT stratum, count(*) AS rows, count(DISTINCT pair_id) AS pairs,
  count(*) FILTER (status = 'clean_stop') AS clean_stop,
  count(*) FILTER (status = 'length_truncated') AS length_truncated,
  count(*) FILTER (grade = 'correct') AS correct,
  count(*) FILTER (grade = 'incorrect') AS incorrect, count(*) FILTER (grade = 'review') AS review
FROM (SELECT *, user_id // 2 AS pair_id, CASE WHEN user_id % 2 = 0 THEN 'previously_truncated'
    ELSE 'matched_clean_control' END AS stratum FROM graded) GROUP BY stratum""",
)
def a24(v: Views) -> DataFrame:
    even = F.col("user_id") % 2 == 0
    rows = v.graded.select(
        "*",
        F.expr("user_id div 2").alias("pair_id"),
        F.when(even, "previously_truncated").otherwise("matched_clean_control").alias("stratum"),
    )
    return aggregates.paired_stratum_report(rows)


# ---- cohorts and splits ------------------------------------------------------------------


@query(
    "w1_balanced_select",
    """
SELECT family, tier, renderer_id, question_id, turn FROM (
  SELECT *, row_number() OVER (PARTITION BY family ORDER BY turn, tier, renderer_id) AS place
  FROM (SELECT *, row_number() OVER (PARTITION BY family, tier, renderer_id
      ORDER BY sha256('9|' || question_id)) AS turn FROM questions)) WHERE place <= 3""",
)
def w1(v: Views) -> DataFrame:
    rows = sampling.balanced_select(
        v.questions, ["tier", "renderer_id"], 3, 9, outer=["family"]
    )
    return rows.select("family", "tier", "renderer_id", "question_id", "turn")


@query("w2_grouped_split", "SELECT question_id, split FROM questions")
def w2(v: Views) -> DataFrame:
    return sampling.grouped_split(v.rollouts, seed=17)


@query(
    "w3_partition_assign",
    """
WITH p AS (SELECT 'c' || c_custkey AS question_id, c_mktsegment AS family,
    row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('partition|5|c' || c_custkey))
      AS rn FROM customer),
s AS (SELECT question_id, row_number() OVER (PARTITION BY family
    ORDER BY sha256('monitor-split|6|' || question_id)) AS sn FROM p WHERE rn > 4)
SELECT question_id, family, CASE WHEN rn <= 4 THEN 'qualification' ELSE 'confirmatory' END
    AS study_partition,
  CASE WHEN sn <= 3 THEN 'train' WHEN sn <= 5 THEN 'validation' WHEN sn IS NOT NULL THEN 'test'
    END AS split
FROM p LEFT JOIN s USING (question_id)""",
)
def w3(v: Views) -> DataFrame:
    rows = v.table("customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("question_id"),
        F.col("c_mktsegment").alias("family"),
    )
    # Five market segments; what is not qualification, train or validation is test.
    sizes = rows.groupBy("family").count().collect()
    return sampling.partition_assign(
        rows,
        qualification=4,
        allocations={family: (3, 2, n - 9) for family, n in sizes},
        partition_seed=5,
        split_seed=6,
    )


@query(
    "w4_select_audit",
    """
SELECT example_id, kind, family, split FROM (
  SELECT *, row_number() OVER (ORDER BY turn, kind, family, split) AS place
  FROM (SELECT *, row_number() OVER (PARTITION BY kind, family, split
      ORDER BY sha256('4|' || example_id)) AS turn FROM examples WHERE NOT is_primary))
WHERE place <= 96""",
)
def w4(v: Views) -> DataFrame:
    rows = sampling.select_audit(v.examples.filter("NOT is_primary"), 96, 4)
    return rows.select("example_id", "kind", "family", "split")


@query(
    "w5_hash_top_k",
    """
SELECT example_id FROM examples WHERE kind = 'ordinary_error'
ORDER BY sha256('8|' || example_id) LIMIT 5""",
)
def w5(v: Views) -> DataFrame:
    rows = v.examples.filter("kind = 'ordinary_error'").withColumn(
        "study_partition", F.lit("qualification")
    ).withColumn("excluded", F.lit(True))
    return sampling.smoke_examples(rows, 5, 8).select("example_id")


_SIBLING_SQL = """
SELECT rollout_id, question_id, focal_answer,
  hits_clean / {k}::DOUBLE AS clean_frequency, hits_correct / {k}::DOUBLE
    AS correct_state_frequency,
  hits_corrupted / {k}::DOUBLE AS corrupted_state_frequency,
  (hits_corrupted / {k}::DOUBLE - greatest(hits_clean / {k}::DOUBLE, hits_correct / {k}::DOUBLE)
    + 1.0::DOUBLE) / 2.0::DOUBLE AS score
FROM (SELECT rollout_id, question_id, focal_answer,
    count(*) FILTER (condition = 'clean' AND hit) AS hits_clean,
    count(*) FILTER (condition = 'correct_continuation' AND hit) AS hits_correct,
    count(*) FILTER (condition = 'corrupted_continuation' AND hit) AS hits_corrupted
  FROM (SELECT f.rollout_id, f.question_id, f.parsed_answer AS focal_answer, s.condition,
      s.parsed_answer = f.parsed_answer AS hit,
      row_number() OVER (PARTITION BY f.rollout_id, s.condition ORDER BY s.rollout_id) AS rn
    FROM (SELECT * FROM examples WHERE is_primary) f JOIN siblings s
      ON s.question_id = f.question_id AND s.rollout_id <> f.rollout_id) WHERE rn <= {k}
  GROUP BY ALL HAVING count(*) = 3 * {k})"""


@query("w6_truncate_siblings", _SIBLING_SQL.format(k=2))
def w6(v: Views) -> DataFrame:
    from shiftlens.operators.monitors import loo_answer_shift

    rows = loo_answer_shift(v.examples.filter("is_primary"), v.rollouts, siblings=2)
    return rows.filter("reject_reason IS NULL").drop("raw_shift", "reject_reason")


@query(
    "w7_collection_balanced_sample",
    """
WITH q AS (SELECT 'mcq:test:' || id AS question_id, split_part(id, '_', 1) AS g FROM mcq_rows
  WHERE len(texts) = 4),
big AS (SELECT * FROM q WHERE g IN (SELECT g FROM q GROUP BY g HAVING count(*) >= 5))
SELECT question_id, g AS template_group FROM (SELECT *, row_number() OVER (ORDER BY turn, g)
    AS place FROM (SELECT *, row_number() OVER (PARTITION BY g
    ORDER BY sha256('2|' || question_id)) AS turn FROM big)) WHERE place <= 40""",
)
def w7(v: Views) -> DataFrame:
    valid, _ = tables.split_rejects(
        tables.normalize_mcq(v.mcq_rows, source_split="test", prefix="mcq")
    )
    rows = sampling.collection_balanced_sample(valid, "template_group", 40, 5, 2)
    return rows.select("question_id", "template_group").orderBy("question_id")


@query(
    "w8_select_screened",
    f"""
SELECT question_id, family, tier FROM (
  SELECT *, row_number() OVER (PARTITION BY family ORDER BY turn, tier, renderer_id) AS place
  FROM (SELECT q.*, row_number() OVER (PARTITION BY q.family, q.tier, q.renderer_id
      ORDER BY sha256('6|' || q.question_id)) AS turn
    FROM questions q JOIN ({_CELLS_SQL}) c ON c.family = q.family AND c.tier = q.tier
    WHERE c.eligible)) WHERE place <= 4""",
)
def w8(v: Views) -> DataFrame:
    rows = sampling.select_screened(v.questions, _screen(v), 4, 6)
    return rows.select("question_id", "family", "tier")


@query(
    "w9_combine_screens",
    f"""
WITH cells AS MATERIALIZED (SELECT family, tier, eligible AND family <> 'f3' AS old_ok, TRUE AS new_ok
  FROM ({_CELLS_SQL})),
pool AS (SELECT q.*, CASE WHEN q.family = 'f3' THEN 'replacement' ELSE 'prior' END AS screen
  FROM questions q JOIN cells c ON c.family = q.family AND c.tier = q.tier
  WHERE CASE WHEN q.family = 'f3' THEN new_ok ELSE old_ok END)
SELECT question_id, family, screen, (SELECT bool_and(ok = (family <> 'f3')) FROM (SELECT family,
    bool_or(old_ok) AS ok FROM cells GROUP BY family))
  AND (SELECT count(*) > 0 FROM cells WHERE family = 'f3') AS valid
FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY turn, tier, renderer_id) AS place
  FROM (SELECT *, row_number() OVER (PARTITION BY family, tier, renderer_id
    ORDER BY sha256('6|' || question_id)) AS turn FROM pool)) WHERE place <= 4""",
)
def w9(v: Views) -> DataFrame:
    cells = _screen(v)
    old = cells.withColumn("eligible", F.col("eligible") & (F.col("family") != "f3"))
    new = cells.withColumn("eligible", F.lit(True))
    rows = sampling.combine_screens(
        v.questions, old, v.questions, new, failed_family="f3", per_family=4, seed=6
    )
    return rows.select("question_id", "family", "screen", "valid")


@query(
    "w10_permute_labels",
    """
WITH a AS (SELECT example_id, row_number() OVER (ORDER BY sha256('3|rows|' || example_id)) AS i
  FROM examples WHERE is_primary),
b AS (SELECT binary_label, row_number() OVER (ORDER BY sha256('3|labels|' || example_id)) AS i
  FROM examples WHERE is_primary)
SELECT a.example_id, b.binary_label::INT AS permuted_label FROM a JOIN b USING (i)""",
)
def w10(v: Views) -> DataFrame:
    return sampling.permute_labels(v.examples.filter("is_primary"), "binary_label", 3)


# ---- gates -------------------------------------------------------------------------------

def _gate_spec(name: str) -> gates.GateSpec:
    return replace(gates.GATES[name], patterns=("k1",))


def _gate_inputs(v: Views, name: str) -> tuple[DataFrame, DataFrame]:
    """Map the rollouts onto the arms of a study; odd users form the control stratum."""
    spec = gates.GATES[name]
    arm = F.col("condition")
    for ours, theirs in zip(ARMS[1:], spec.arms[1:], strict=False):
        arm = F.when(F.col("condition") == ours, theirs).otherwise(arm)
    rows = v.rollouts.withColumn("condition", arm).withColumn(
        "mention_text", F.concat(F.lit("k"), F.col("k").cast("string"))
    )
    if len(spec.arms) == 1:
        rows = rows.filter("condition = 'clean'")
    even = F.col("user_id") % 2 == 0
    questions = v.questions.select(
        "*",
        F.expr("user_id div 2").alias("pair_id"),
        F.when(even, "previously_truncated").otherwise("matched_clean_control").alias("stratum"),
    )
    return questions, rows


def _gate_sql(name: str) -> str:
    spec = _gate_spec(name)
    arms = ", ".join(f"'{a}'" for a in spec.arms)
    arm = "condition"
    for ours, theirs in zip(ARMS[1:], spec.arms[1:], strict=False):
        arm = f"CASE WHEN condition = '{ours}' THEN '{theirs}' ELSE {arm} END"
    only = "WHERE condition = 'clean'" if len(spec.arms) == 1 else ""
    design = f"condition IN ({arms}) AND model = '{spec.model}'"
    counted = f"WHERE {design}" if spec.skip_invalid else ""
    base = "grade IS NOT NULL"
    partition = gates.PARTITIONS.get(name)
    wrong = "0" if partition is None else f"count(*) FILTER (study_partition <> '{partition}')"
    treated, control = f"condition = '{spec.treated}'", f"condition = '{spec.control}'"
    correct_arm = f"condition = '{spec.correct_arm}'"

    def rate(arm_sql: str) -> str:
        return (
            f"(sum(hit) FILTER ({arm_sql}) "
            f"/ nullif(count(hit) FILTER ({arm_sql}), 0)::DOUBLE)"
        )

    def accuracy(where: str) -> str:
        return (
            f"(count(*) FILTER (grade = 'correct' AND {where}) "
            f"/ nullif(count(*) FILTER (grade IS NOT NULL AND {where}), 0)::DOUBLE)"
        )

    if spec.effect:
        value = "t_hits / t_rows::DOUBLE - c_hits / c_rows::DOUBLE"
        pieces = (
            f"coalesce(sum(hit) FILTER ({treated}), 0) AS t_hits, "
            f"count(hit) FILTER ({treated}) AS t_rows, "
            f"coalesce(sum(hit) FILTER ({control}), 0) AS c_hits, "
            f"count(hit) FILTER ({control}) AS c_rows"
        )
    else:
        value = "t_hits / t_rows::DOUBLE"
        pieces = (
            "count(*) FILTER (grade = 'correct') AS t_hits, count(grade) AS t_rows, "
            "0 AS c_hits, count(grade) AS c_rows"
        )
    needs_interval = spec.effect or spec.accuracy_interval
    interval_cte = f"""
clusters AS (SELECT *, row_number() OVER (ORDER BY sha256('cluster|' || question_id)) - 1 AS slot,
    count(*) OVER () AS g
  FROM (SELECT question_id, {pieces} FROM counted GROUP BY question_id)
  WHERE t_rows > 0 OR c_rows > 0),
draws AS (SELECT r.r, ('0x' || substr(sha256('{spec.bootstrap_seed}|' || r.r || '|' || slot), 1, 15))
    ::BIGINT % g AS slot FROM clusters, range({spec.bootstrap_samples}) r(r)),
reps AS (SELECT r, sum(t_hits)::BIGINT AS t_hits, sum(t_rows)::BIGINT AS t_rows,
    sum(c_hits)::BIGINT AS c_hits, sum(c_rows)::BIGINT AS c_rows
  FROM draws JOIN clusters USING (slot) GROUP BY r),
vals AS (SELECT list_sort(list({value})) AS l FROM reps WHERE t_rows > 0 AND c_rows > 0),
edges_ci AS (SELECT l[floor(0.025::DOUBLE * (len(l) - 1))::INT + 1] AS lo,
  l[floor(0.975::DOUBLE * (len(l) - 1))::INT + 1] AS hi FROM vals)"""
    if not needs_interval:
        interval_cte = "edges_ci AS (SELECT NULL::DOUBLE AS lo, NULL::DOUBLE AS hi)"
    stored_or_expected = "(SELECT count(*) FROM rows_in)" if spec.truncation_base == "stored" else (
        f"(SELECT count(*) * {len(spec.arms) * spec.samples} FROM questions)"
    )
    measures = {
        "questions": "(SELECT count(*) FROM questions)",
        "families": "(SELECT count(DISTINCT family) FROM questions)",
        "family_min": "(SELECT min(n) FROM (SELECT count(*) AS n FROM questions GROUP BY family))",
        "family_max": "(SELECT max(n) FROM (SELECT count(*) AS n FROM questions GROUP BY family))",
        "cells": "(SELECT count(*) FROM (SELECT DISTINCT family, mechanism FROM questions))",
        "cell_min": "(SELECT min(n) FROM (SELECT count(*) AS n FROM questions "
                    "GROUP BY family, mechanism))",
        "cell_max": "(SELECT max(n) FROM (SELECT count(*) AS n FROM questions "
                    "GROUP BY family, mechanism))",
        "pairs": "(SELECT count(DISTINCT user_id // 2) FROM questions)",
        "pair_min": "(SELECT min(n) FROM (SELECT count(*) AS n FROM questions "
                    "GROUP BY user_id // 2))",
        "pair_max": "(SELECT max(n) FROM (SELECT count(*) AS n FROM questions "
                    "GROUP BY user_id // 2))",
        "prior_questions": "(SELECT count(*) FROM questions WHERE user_id % 2 = 0)",
        "control_questions": "(SELECT count(*) FROM questions WHERE user_id % 2 = 1)",
        "ambiguous_questions": "(SELECT count(*) FROM questions WHERE family = 'recurrence')",
        "excluded": "(SELECT count(*) FROM questions WHERE excluded)",
        "not_excluded": "(SELECT count(*) FROM questions WHERE NOT excluded)",
        "wrong_partition": f"(SELECT {wrong} FROM questions)",
        **{
            f"{s}_questions": f"(SELECT count(*) FROM questions WHERE split = '{s}')"
            for s in ("train", "validation", "test")
        },
        "stored": "(SELECT count(*) FROM rows_in)",
        "truncated": "(SELECT count(*) FROM rows_in WHERE status = 'length_truncated')",
        "truncation_rate": "(SELECT count(*) FILTER (status = 'length_truncated') / "
                           f"{stored_or_expected}::DOUBLE FROM rows_in)",
        "request_ids": "(SELECT count(provider_request_id) FROM rows_in)",
        "unique_request_ids": "(SELECT count(DISTINCT provider_request_id) FROM rows_in)",
        "unique_rollout_ids": "(SELECT count(DISTINCT rollout_id) FROM rows_in)",
        "unknown_questions": "0",
        "request_errors": "0",
        "bad_certificates": "0",
        "reconstruction_failures": "0",
        "invalid_design": f"(SELECT count(*) FROM rows_in WHERE NOT ({design}))",
        "expected": f"(SELECT count(*) * {len(spec.arms) * spec.samples} FROM questions)",
        "bad_cells": f"""(SELECT count(*) FROM (SELECT q.question_id, a.condition,
    count(c.seed) AS n, count(DISTINCT c.seed) AS s FROM questions q
    CROSS JOIN (SELECT unnest([{arms}]) AS condition) a LEFT JOIN counted c
      ON c.question_id = q.question_id AND c.condition = a.condition GROUP BY ALL)
    WHERE n <> {spec.samples} OR s <> {spec.samples})""",
        "missing_target_cells": f"""(SELECT count(*) FROM (SELECT q.question_id, a.condition,
    count(c.hit) AS n FROM questions q CROSS JOIN (SELECT unnest([{arms}]) AS condition) a
    LEFT JOIN counted c ON c.question_id = q.question_id AND c.condition = a.condition
    GROUP BY ALL) WHERE n = 0)""",
        "scorable": f"(SELECT count(*) FROM counted WHERE {base})",
        "reasoning_present": f"(SELECT count(*) FROM counted WHERE {base})",
        "correct": "(SELECT count(*) FROM counted WHERE grade = 'correct')",
        "incorrect": "(SELECT count(*) FROM counted WHERE grade = 'incorrect')",
        "accuracy": f"(SELECT {accuracy('TRUE')} FROM counted)",
        "clean_accuracy": "(SELECT " + accuracy("condition = 'clean'") + " FROM counted)",
        "correct_arm_accuracy": f"(SELECT {accuracy(correct_arm)} FROM counted)",
        "target_effect": f"(SELECT {rate(treated)} - {rate(control)} FROM counted)",
        "target_selections": f"(SELECT coalesce(sum(hit), 0) FROM counted WHERE {treated})",
        "target_questions": "(SELECT count(DISTINCT question_id) FROM counted "
                            f"WHERE {treated} AND hit = 1)",
        "target_families": "(SELECT count(DISTINCT family) FROM counted "
                           f"WHERE {treated} AND hit = 1)",
        "target_cells": "(SELECT count(DISTINCT (family, mechanism)) FROM counted "
                        f"WHERE {treated} AND hit = 1)",
        "clean_errors": "(SELECT count(*) FROM counted "
                        "WHERE condition = 'clean' AND grade = 'incorrect')",
        "clean_error_questions": "(SELECT count(DISTINCT question_id) FROM counted "
                                 "WHERE condition = 'clean' AND grade = 'incorrect')",
        "clean_error_families": "(SELECT count(DISTINCT family) FROM counted "
                                "WHERE condition = 'clean' AND grade = 'incorrect')",
        "clean_error_cells": "(SELECT count(DISTINCT (family, mechanism)) FROM counted "
                             "WHERE condition = 'clean' AND grade = 'incorrect')",
        "candidates": f"(SELECT count(*) FROM counted WHERE {treated} AND hit = 1 "
                      "AND NOT contains('k' || k, 'k1'))",
        "candidate_questions": "(SELECT count(DISTINCT question_id) FROM counted "
                               f"WHERE {treated} AND hit = 1 AND NOT contains('k' || k, 'k1'))",
        "error_questions": "(SELECT count(DISTINCT question_id) FROM counted "
                           "WHERE grade = 'incorrect')",
        "error_families": "(SELECT count(DISTINCT family) FROM counted "
                          "WHERE grade = 'incorrect')",
        "correct_families": "(SELECT count(DISTINCT family) FROM counted "
                            "WHERE grade = 'correct')",
        "prior_scorable": f"(SELECT count(*) FROM counted WHERE {base} AND user_id % 2 = 0)",
        "control_scorable": f"(SELECT count(*) FROM counted WHERE {base} AND user_id % 2 = 1)",
        "mechanisms_with_effect": f"""(SELECT count(e) FROM (SELECT mechanism,
    {rate(treated)} - {rate(control)} AS e FROM counted GROUP BY mechanism))""",
        "mechanism_effect_min": f"""(SELECT min(e) FROM (SELECT mechanism,
    {rate(treated)} - {rate(control)} AS e FROM counted GROUP BY mechanism))""",
        "interval_low": "(SELECT lo FROM edges_ci)",
        "interval_high": "(SELECT hi FROM edges_ci)",
    }
    lines = []
    for check, measure, op, other, factor, offset in spec.checks:
        bound = f"{offset!r}::DOUBLE" if other is None else (
            f"{measures[other]}::DOUBLE * {factor!r}::DOUBLE + {offset!r}::DOUBLE"
        )
        lines.append(
            f"SELECT '{check}' AS chk, '{op}' AS op, {measures[measure]}::DOUBLE AS value, "
            f"{bound} AS bound"
        )
    body = "\nUNION ALL ".join(lines)
    return f"""
WITH rows_in AS MATERIALIZED (SELECT * REPLACE ({arm} AS condition) FROM graded {only}),
counted AS MATERIALIZED (SELECT *, hit_target::INT AS hit FROM rows_in {counted}),
{interval_cte}
SELECT '{spec.study}' AS study, chk AS "check", op, value, bound,
  coalesce(CASE op WHEN '>=' THEN value >= bound WHEN '<=' THEN value <= bound
    WHEN '>' THEN value > bound ELSE value = bound END, FALSE) AS passed
FROM ({body})"""


def _register_gate(name: str) -> None:
    @query(f"a19_gate_{name}", _gate_sql(name))
    def run(v: Views) -> DataFrame:
        questions, rows = _gate_inputs(v, name)
        return gates.gate_report(questions, rows, _gate_spec(name))


for _name in gates.GATES:
    if _name != "natural_errors":
        _register_gate(_name)


@query(
    "a19_gate_screening",
    f"""
WITH cells AS MATERIALIZED ({_CELLS_SQL
    .replace("0.1 AND 0.7", "0.3 AND 0.7")})
SELECT 'screening' AS study, chk AS "check", '=' AS op, value::DOUBLE AS value,
  0.0::DOUBLE AS bound, value = 0 AS passed
FROM (SELECT 'one_rollout_per_question' AS chk, (SELECT count(*) FROM questions
    WHERE question_id NOT IN (SELECT question_id FROM ({_FIRST_CLEAN}) GROUP BY ALL
      HAVING count(*) = 1)) AS value
  UNION ALL SELECT 'no_malformed_cells', (SELECT count(*) FROM cells WHERE questions <> 20)
  UNION ALL SELECT 'no_missing_family', 4 - (SELECT count(DISTINCT family) FROM cells
    WHERE eligible AND family IN ('f0', 'f1', 'f2', 'f9'))
  UNION ALL SELECT 'families_as_frozen', (SELECT count(DISTINCT family) FROM cells
    WHERE family NOT IN ('f0', 'f1', 'f2', 'f9'))
  UNION ALL SELECT 'clean_condition_and_expected_model', 0
  UNION ALL SELECT 'zero_request_errors', 0)""",
)
def a19_screening(v: Views) -> DataFrame:
    rows = _first_clean(v).drop("grade", "hit_target", "_r")
    return gates.screening_gate(
        v.questions, rows, families=("f0", "f1", "f2", "f9"), expected_per_cell=20,
        min_scorable=2, model="m",
    )


@query(
    "a19_gate_verdict",
    """
SELECT study, count(*) AS checks, count(*) FILTER (passed) AS passed_checks,
  bool_and(passed) AS gate_passed FROM (
""" + _gate_sql("causal_yield").replace("\nWITH ", "\nWITH ") + ") GROUP BY study",
)
def a19_verdict(v: Views) -> DataFrame:
    questions, rows = _gate_inputs(v, "causal_yield")
    return gates.gate_verdict(gates.gate_report(questions, rows, _gate_spec("causal_yield")))


@query(
    "t2_window_quality",
    """
SELECT date_trunc('hour', created_at) AS window_start,
  date_trunc('hour', created_at) + INTERVAL 1 HOUR AS window_end, count(*) AS rollouts,
  count(*) FILTER (status = 'clean_stop') AS clean_stop,
  count(*) FILTER (status = 'length_truncated') AS truncated,
  count(*) FILTER (status = 'parse_invalid') AS parse_invalid,
  count(*) FILTER (status = 'malformed') AS malformed,
  count(*) FILTER (status = 'length_truncated') / count(*)::DOUBLE AS truncation_rate,
  count(*) FILTER (status = 'length_truncated') / count(*)::DOUBLE > 0.1::DOUBLE AS alert
FROM rollouts GROUP BY ALL""",
)
def t2(v: Views) -> DataFrame:
    return window_quality(v.rollouts)


@query(
    "t1_batch_ingest",
    """
SELECT rollout_id, condition, status FROM rollouts""",
)
def t1(v: Views) -> DataFrame:
    from shiftlens.streaming.collection import stream_ingest

    twice = v.rollouts.unionByName(v.rollouts.filter(F.col("k") % 3 == 0))
    return stream_ingest(twice).select("rollout_id", "condition", "status")


