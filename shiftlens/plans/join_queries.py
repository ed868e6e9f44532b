"""Queries over lookups, plans, set operations and data-quality assertions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.functions.digests import canonical_digest, canonical_json, config_digest
from shiftlens.operators import aggregates, gates, graph, interventions, joins, monitors, quality
from shiftlens.operators.monitors import groups_crossing, leaky_split
from shiftlens.operators.sampling import balanced_select
from shiftlens.plans.registry import query
from shiftlens.plans.views import Views

_TRIO = ("counterfactual_answer_shift", "corrupted_recurrence_only", "control_suppression_only")


def _some_questions(v: Views) -> DataFrame:
    """Question table without the users whose number is a multiple of seven."""
    return v.questions.filter(F.col("user_id") % 7 != 0)


@query(
    "j1_enrich",
    """
SELECT r.rollout_id, r.question_id, q.split, q.question_id IS NOT NULL AS known_question
FROM rollouts r LEFT JOIN (SELECT * FROM questions WHERE user_id % 7 <> 0) q USING (question_id)""",
)
def j1(v: Views) -> DataFrame:
    return joins.enrich(v.rollouts, _some_questions(v)).select(
        "rollout_id", "question_id", "split", "known_question"
    )


@query(
    "j1_unknown_keys",
    """
SELECT question_id, count(*) AS rows FROM rollouts WHERE user_id % 7 = 0 GROUP BY ALL""",
)
def j1_unknown(v: Views) -> DataFrame:
    return joins.unknown_keys(v.rollouts, _some_questions(v))


@query(
    "j2_same_key_set",
    """
SELECT coalesce(a.k, b.k) AS key, coalesce(a.n, 0) AS left_rows, coalesce(b.n, 0) AS right_rows,
  CASE WHEN a.n IS NULL THEN 'missing_left' WHEN b.n IS NULL THEN 'missing_right'
    ELSE 'duplicate' END AS problem
FROM (SELECT c_custkey AS k, count(*) AS n FROM customer GROUP BY ALL) a
FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY ALL) b ON a.k = b.k
WHERE coalesce(a.n, 0) <> 1 OR coalesce(b.n, 0) <> 1""",
)
def j2(v: Views) -> DataFrame:
    left = v.table("customer").select(F.col("c_custkey").alias("key"))
    right = v.table("orders").select(F.col("o_custkey").alias("key"))
    return joins.same_key_set(left, right, "key")


def _certified(v: Views) -> DataFrame:
    payload = canonical_json({"gold": F.col("gold_answer"), "id": F.col("question_id")})
    tampered = F.col("user_id") % 11 == 3
    return v.questions.filter(F.col("user_id") % 13 != 1).select(
        "question_id",
        payload.alias("payload"),
        F.when(tampered, F.lit("0")).otherwise(canonical_digest(payload)).alias("digest"),
        F.sha2("prompt", 256).alias("prompt_sha256"),
        F.when(F.col("user_id") % 5 == 2, "9").otherwise(F.col("gold_answer")).alias("gold_answer"),
        "target_answer",
    )


@query(
    "j3_verify_digests",
    """
SELECT question_id, rule FROM questions, (VALUES ('missing_certificate'), ('payload_digest'),
  ('gold_answer')) r(rule)
WHERE CASE rule WHEN 'missing_certificate' THEN user_id % 13 = 1
  WHEN 'payload_digest' THEN user_id % 13 <> 1 AND user_id % 11 = 3
  ELSE user_id % 13 <> 1 AND user_id % 5 = 2 END""",
)
def j3(v: Views) -> DataFrame:
    return interventions.verify_digests(v.questions, _certified(v))


_TAMPERED = {
    "payload_digest": "user_id % 11 = 3", "prompt_digest": "user_id % 7 = 4", "gold_answer": "user_id % 5 = 2",
    "target_is_wrong": "user_id % 17 = 5", "target_answer": "user_id % 17 = 5 OR user_id % 19 = 6",
    "parent_digest": "user_id % 23 = 7", "field:family": "user_id % 29 = 8",
}


@query(
    "j3_all_rules",
    "SELECT question_id, 'missing_certificate' AS rule FROM questions WHERE user_id % 13 = 1"
    + "".join(
        f"\nUNION ALL SELECT question_id, '{rule}' FROM questions WHERE user_id % 13 <> 1 AND ({where})"
        for rule, where in _TAMPERED.items()
    )
    + "\nUNION ALL SELECT DISTINCT 'other:' || family, 'missing_problem' FROM questions",
)
def j3_all(v: Views) -> DataFrame:
    def either(rule: str, bad, good) -> F.Column:
        return F.when(F.expr(_TAMPERED[rule]), bad).otherwise(good)

    payload = canonical_json({"gold": F.col("gold_answer"), "id": F.col("question_id")})
    other = v.questions.filter(F.col("user_id") % 13 != 1).select("user_id", "question_id", "gold_answer", "target_answer", "prompt", "family")
    unknown = other.select(F.concat(F.lit("other:"), "family").alias("question_id")).distinct()
    held = other.select(
        "question_id",
        payload.alias("payload"),
        either("payload_digest", F.lit("0"), canonical_digest(payload)).alias("digest"),
        either("prompt_digest", F.lit("0"), F.sha2("prompt", 256)).alias("prompt_sha256"),
        either("gold_answer", F.lit("9"), F.col("gold_answer")).alias("gold_answer"),
        either("target_is_wrong", F.col("gold_answer"),
               either("target_answer", F.lit("8"), F.col("target_answer"))).alias("target_answer"),
        F.sha2("question_id", 256).alias("parent_sha256"),
        either("field:family", F.lit("fx"), F.col("family")).alias("family"),
    )
    sources = v.questions.select(
        "question_id", either("parent_digest", F.lit("0"), F.sha2("question_id", 256)).alias("digest")
    )
    return interventions.verify_digests(
        v.questions, held.unionByName(unknown, allowMissingColumns=True), sources=sources, fields={"family": "family"}
    )


_ALLCONDS = ("clean", "correct_continuation")


def _plan(v: Views) -> DataFrame:
    return joins.collection_plan(
        v.questions, _ALLCONDS, samples=2, base_seed=100, model="m"
    )


_PLAN_SQL = """
SELECT s.sample_index, q.round, q.template_group, c.i AS condition_index, q.question_id,
  c.condition, 100 + (q.i - 1) * 1000 + c.i * 100 + s.sample_index AS seed,
  substr(sha256(q.question_id || '|' || c.condition || '|'
    || (100 + (q.i - 1) * 1000 + c.i * 100 + s.sample_index) || '|m'), 1, 20) AS rollout_id
FROM (SELECT question_id, template_group, row_number() OVER (ORDER BY question_id) AS i,
    row_number() OVER (PARTITION BY template_group ORDER BY question_id) AS round
  FROM questions) q
CROSS JOIN (VALUES (0::BIGINT, 'clean'), (1::BIGINT, 'correct_continuation')) c(i, condition)
CROSS JOIN (VALUES (0::BIGINT), (1::BIGINT)) s(sample_index)"""


@query("j11_collection_plan", _PLAN_SQL)
def j11(v: Views) -> DataFrame:
    return _plan(v)


@query(
    "j11_choice_plan",
    """
SELECT s.sample_index, q.i AS round, q.template_group, 0::BIGINT AS condition_index, q.question_id,
  'clean' AS condition, 7 + (q.i - 1) * 1000 + s.sample_index AS seed,
  list_filter(['0', '1', '2', '3'], lambda x: x <> q.gold_answer)[(q.i - 1) % 3 + 1]
    AS hinted_option,
  substr(sha256(q.question_id || '|clean|' || (7 + (q.i - 1) * 1000 + s.sample_index) || '|m'),
    1, 20) AS rollout_id
FROM (SELECT *, row_number() OVER (ORDER BY question_id) AS i FROM questions) q
CROSS JOIN (VALUES (0::BIGINT), (1::BIGINT)) s(sample_index)""",
)
def j11_choices(v: Views) -> DataFrame:
    return joins.collection_plan(
        v.questions, ["clean"], samples=2, base_seed=7, model="m", choices=True
    )


_DONE_SQL = f"""
SELECT *, CASE WHEN seed % 3 = 0 THEN 'm' ELSE 'other' END AS model,
  CASE WHEN seed % 2 = 0 THEN 'length_truncated' ELSE 'clean_stop' END AS status
FROM ({_PLAN_SQL}) WHERE sample_index = 0"""


def _done(v: Views) -> DataFrame:
    rows = _plan(v).filter("sample_index = 0")
    return rows.select(
        "*",
        F.when(F.col("seed") % 3 == 0, "m").otherwise("other").alias("model"),
        F.when(F.col("seed") % 2 == 0, "length_truncated").otherwise("clean_stop").alias("status"),
        F.concat(F.lit("r"), F.col("seed").cast("string")).alias("provider_request_id"),
    )


@query(
    "j4_pending_work",
    f"""
SELECT p.rollout_id, p.seed FROM ({_PLAN_SQL}) p WHERE p.rollout_id NOT IN (
  SELECT rollout_id FROM ({_DONE_SQL}) WHERE model = 'm' AND status <> 'length_truncated')""",
)
def j4(v: Views) -> DataFrame:
    rows = joins.pending_work(_plan(v), _done(v), model="m", retry_truncated=True)
    return rows.select("rollout_id", "seed")


# Stored results of two runs: the second one had another sampling temperature.
_CONFIGS = """CASE WHEN seed % 3 = 0 THEN sha256('{"arms":3,"model":"m","temperature":0.5}')
  ELSE sha256('{"arms":3,"model":"m","temperature":1.0}') END"""


def _configured(v: Views) -> DataFrame:
    payload = {
        "arms": F.lit(3), "model": F.lit("m"), "temperature": F.when(F.col("seed") % 3 == 0, 0.5).otherwise(1.0),
    }
    done = _done(v)
    twice = done.unionByName(done.filter(F.col("seed") % 7 == 0))
    return twice.withColumn("config_sha256", canonical_digest(canonical_json(payload)))


_CONFIG = {"temperature": 1.0, "model": "m", "arms": 3}


@query(
    "j4_resume_configuration",
    f"""
SELECT p.rollout_id, p.seed FROM ({_PLAN_SQL}) p WHERE p.rollout_id NOT IN (
  SELECT rollout_id FROM ({_DONE_SQL}) WHERE model = 'm'
    AND {_CONFIGS} = sha256('{{"arms":3,"model":"m","temperature":1.0}}'))""",
)
def j4_resume(v: Views) -> DataFrame:
    rows = joins.pending_work(_plan(v), _configured(v), model="m", config_sha256=config_digest(_CONFIG))
    return rows.select("rollout_id", "seed")


@query(
    "j4_resume_problems",
    f"""
WITH done AS (SELECT *, {_CONFIGS} AS config FROM ({_DONE_SQL})),
twice AS (SELECT * FROM done UNION ALL SELECT * FROM done WHERE seed % 7 = 0)
SELECT rollout_id, 'duplicate_id' AS problem FROM twice GROUP BY rollout_id HAVING count(*) > 1
UNION ALL SELECT DISTINCT rollout_id, 'outside_plan' FROM twice
  WHERE rollout_id NOT IN (SELECT rollout_id FROM ({_PLAN_SQL}))
UNION ALL SELECT DISTINCT rollout_id, 'different_configuration' FROM twice
  WHERE config <> sha256('{{"arms":3,"model":"m","temperature":1.0}}')""",
)
def j4_problems(v: Views) -> DataFrame:
    return joins.resume_problems(_plan(v), _configured(v), config_sha256=config_digest(_CONFIG))


@query(
    "j4_outside_plan",
    f"""
SELECT rollout_id, condition FROM rollouts
WHERE rollout_id NOT IN (SELECT rollout_id FROM ({_PLAN_SQL}))""",
)
def j4_outside(v: Views) -> DataFrame:
    return joins.outside_plan(_plan(v), v.rollouts).select("rollout_id", "condition")


@query(
    "j5_overlap",
    """
SELECT DISTINCT c_custkey AS question_id FROM customer
WHERE c_custkey IN (SELECT s_suppkey FROM supplier UNION SELECT n_nationkey * 40 FROM nation)""",
)
def j5(v: Views) -> DataFrame:
    fresh = v.table("customer").select(F.col("c_custkey").alias("question_id"))
    a = v.table("supplier").select(F.col("s_suppkey").alias("question_id"))
    b = v.table("nation").select((F.col("n_nationkey").cast("long") * 40).alias("question_id"))
    return joins.overlap(fresh, a, b)


@query("j6_loo_answer_shift", "SELECT * FROM shifts")
def j6(v: Views) -> DataFrame:
    return v.shifts.drop("reject_reason")


@query(
    "j6_all_focal_rows",
    """
WITH counted AS (
  SELECT f.rollout_id, f.question_id, f.parsed_answer, f.status,
    count(s.rollout_id) FILTER (s.condition = 'clean') AS n1,
    count(s.rollout_id) FILTER (s.condition = 'correct_continuation') AS n2,
    count(s.rollout_id) FILTER (s.condition = 'corrupted_continuation') AS n3,
    count(*) FILTER (s.condition = 'clean' AND s.parsed_answer = f.parsed_answer) AS h1,
    count(*) FILTER (s.condition = 'correct_continuation' AND s.parsed_answer = f.parsed_answer) AS h2,
    count(*) FILTER (s.condition = 'corrupted_continuation' AND s.parsed_answer = f.parsed_answer) AS h3
  FROM rollouts f LEFT JOIN siblings s
    ON s.question_id = f.question_id AND s.rollout_id <> f.rollout_id GROUP BY ALL),
judged AS (SELECT *, CASE WHEN parsed_answer IS NULL THEN 'no_answer'
  WHEN status <> 'clean_stop' THEN 'not_scorable' WHEN least(n1, n2, n3) = 0 THEN 'cell_empty' END
  AS reject_reason FROM counted)
SELECT rollout_id, question_id, parsed_answer AS focal_answer, reject_reason,
  CASE WHEN reject_reason IS NULL THEN (h3 / n3::DOUBLE - greatest(h1 / n1::DOUBLE, h2 / n2::DOUBLE)
    + 1.0::DOUBLE) / 2.0::DOUBLE END AS score FROM judged""",
)
def j6_all(v: Views) -> DataFrame:
    # Every rollout is a focal row here, those that cannot be scored included.
    rows = monitors.loo_answer_shift(v.rollouts, v.rollouts)
    return rows.select("rollout_id", "question_id", "focal_answer", "reject_reason", "score")


@query(
    "j7_label_join",
    """
WITH hinted AS (SELECT question_id, hinted_option, count(*) AS n,
    count(*) FILTER (parsed_answer = hinted_option) AS hits FROM rollouts
  WHERE hinted_option IS NOT NULL AND parsed_answer IS NOT NULL GROUP BY ALL),
base AS (SELECT question_id, parsed_answer FROM rollouts
  WHERE condition = 'clean' AND parsed_answer IS NOT NULL),
effects AS (SELECT question_id, hinted_option, hits / n::DOUBLE
    - (SELECT count(*) FROM base b WHERE b.question_id = h.question_id
        AND b.parsed_answer = h.hinted_option)
      / (SELECT count(*) FROM base b WHERE b.question_id = h.question_id)::DOUBLE AS hint_effect
  FROM hinted h)
SELECT rollout_id, condition, hint_effect FROM rollouts LEFT JOIN effects
  USING (question_id, hinted_option)""",
)
def j7(v: Views) -> DataFrame:
    shifts = aggregates.hint_answer_shift(v.rollouts)
    return joins.label_join(v.rollouts, shifts).select("rollout_id", "condition", "hint_effect")


@query(
    "j8_component_matrix",
    """
SELECT example_id,
  max(score) FILTER (component = 'counterfactual_answer_shift') AS counterfactual_answer_shift,
  max(score) FILTER (component = 'corrupted_recurrence_only') AS corrupted_recurrence_only,
  max(score) FILTER (component = 'control_suppression_only') AS control_suppression_only
FROM scores GROUP BY example_id""",
)
def j8(v: Views) -> DataFrame:
    return joins.component_matrix(v.scores, _TRIO)


@query(
    "j9_coverage",
    """
WITH expected AS (SELECT DISTINCT example_id, view FROM judge_attempts,
    (VALUES ('transcript_only'), ('context_aware')) w(view2) WHERE view = view2 OR TRUE),
plan AS (SELECT DISTINCT a.example_id, w.view FROM judge_attempts a,
    (VALUES ('transcript_only'), ('context_aware')) w(view)),
seen AS (SELECT example_id, view, count(*) AS n FROM judge_attempts GROUP BY ALL)
SELECT p.example_id, p.view, 1::BIGINT AS expected_rows, coalesce(s.n, 0) AS observed_rows
FROM plan p LEFT JOIN seen s USING (example_id, view) WHERE coalesce(s.n, 0) <> 1""",
)
def j9(v: Views) -> DataFrame:
    views = F.explode(F.array(F.lit("transcript_only"), F.lit("context_aware"))).alias("view")
    plan = v.judge_attempts.select("example_id").distinct().select("example_id", views)
    return joins.coverage(plan, v.judge_attempts, ["example_id", "view"])


def _cases(v: Views, pairs: int = 12) -> tuple[DataFrame, DataFrame]:
    rows = v.table("part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("question_id"),
        F.col("p_type").alias("family"),
        F.concat(F.lit("t"), (F.col("p_size") % 3).cast("string")).alias("tier"),
        (F.col("p_size") % 3).alias("tier_rank"),
        (F.col("p_partkey") % 2).alias("renderer_id"),
        (F.col("p_partkey") % 5 == 0).alias("truncated"),
    )
    chosen = balanced_select(
        rows.filter("truncated"), ["tier", "renderer_id"], pairs, 3
    ).withColumn("case_index", F.expr(
        "row_number() OVER (ORDER BY turn, tier, renderer_id) - 1"
    ))
    return chosen.withColumnRenamed("question_id", "case_id"), rows.filter(
        "NOT truncated"
    ).withColumnRenamed("question_id", "control_id")


@query(
    "j10_matched_controls",
    """
WITH base AS (SELECT 'p' || p_partkey AS id, p_type AS family, p_size % 3 AS tier_rank,
    p_partkey % 2 AS renderer_id, p_partkey % 5 = 0 AS truncated FROM part),
turns AS (SELECT *, row_number() OVER (PARTITION BY tier_rank, renderer_id
    ORDER BY sha256('3|' || id)) AS turn FROM base WHERE truncated),
cases AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY turn, tier_rank, renderer_id) - 1
    AS i FROM turns) WHERE i < 12),
near AS (SELECT c.i, c.id AS case_id, c.family, b.id AS control_id,
    abs(b.tier_rank - c.tier_rank) AS distance,
    (b.renderer_id <> c.renderer_id)::INT AS mismatch,
    row_number() OVER (PARTITION BY c.i ORDER BY abs(b.tier_rank - c.tier_rank),
      (b.renderer_id <> c.renderer_id)::INT, sha256((3 + c.i) || '|' || b.id)) AS choice
  FROM cases c JOIN base b ON b.family = c.family AND NOT b.truncated),
short AS MATERIALIZED (SELECT * FROM near WHERE choice <= 12),
steps AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS used
  UNION ALL
  SELECT s.i + 1, list_append(s.used, (SELECT arg_min(n.control_id, n.choice) FROM short n
    WHERE n.i = s.i AND NOT list_contains(s.used, n.control_id)))
  FROM steps s WHERE s.i < 12)
SELECT n.i AS case_index, n.case_id, n.control_id, n.family, n.distance::BIGINT AS distance,
  n.mismatch::BIGINT AS mismatch
FROM short n JOIN (SELECT unnest(used) AS control_id, generate_subscripts(used, 1) - 1 AS i
  FROM steps WHERE i = 12) u ON u.i = n.i AND u.control_id = n.control_id""",
)
def j10(v: Views) -> DataFrame:
    cases, pool = _cases(v)
    return joins.matched_controls(cases, pool, seed=3, pairs=12)


@query(
    "j12_judge_plan",
    """
SELECT e.example_id, w.view, 50 + (e.i - 1) * 10 + w.j AS seed,
  substr(sha256(e.example_id || '|' || w.view || '|jm|v1|' || (50 + (e.i - 1) * 10 + w.j)), 1, 24)
    AS score_id
FROM (SELECT example_id, row_number() OVER (ORDER BY example_id) AS i FROM examples
  WHERE is_primary) e
CROSS JOIN (VALUES (0::BIGINT, 'transcript_only'), (1::BIGINT, 'context_aware')) w(j, view)""",
)
def j12(v: Views) -> DataFrame:
    return joins.judge_plan(
        v.examples.filter("is_primary"), model="jm", prompt_version="v1", base_seed=50
    )


@query(
    "j13_transfer_threshold",
    """
SELECT component, max(t) AS threshold, count(*) FILTER (label = 1) AS positives,
  count(*) FILTER (label = 0) AS negatives,
  count(*) FILTER (label = 1 AND score >= t) AS true_positives,
  count(*) FILTER (label = 0 AND score >= t) AS false_positives,
  count(*) FILTER (label = 1 AND score >= t) / count(*) FILTER (label = 1)::DOUBLE AS recall,
  count(*) FILTER (label = 0 AND score >= t) / count(*) FILTER (label = 0)::DOUBLE
    AS false_positive_rate
FROM scores JOIN (VALUES ('counterfactual_answer_shift', 0.6::DOUBLE),
  ('corrupted_recurrence_only', 0.5::DOUBLE)) x(component, t) USING (component) GROUP BY component""",
)
def j13(v: Views) -> DataFrame:
    from shiftlens.session import literal_rows

    chosen = literal_rows(
        v.spark,
        [("counterfactual_answer_shift", 0.6), ("corrupted_recurrence_only", 0.5)],
        "component string, threshold double",
    )
    return joins.transfer_threshold(v.scores, chosen)


@query(
    "u1_union",
    """
SELECT component, count(*) AS n FROM scores GROUP BY ALL
UNION ALL SELECT view, count(*) FROM judge_attempts GROUP BY ALL""",
)
def u1(v: Views) -> DataFrame:
    judge = v.judge_attempts.select("example_id", F.col("view").alias("component"))
    rows = quality.score_union(v.scores.select("example_id", "component"), judge)
    return rows.groupBy("component").agg(F.count("*").alias("n"))


@query(
    "u2_identity_difference",
    """
SELECT k AS key, 'left' AS side FROM (SELECT o_custkey AS k FROM orders EXCEPT ALL
  SELECT c_custkey FROM customer)
UNION ALL
SELECT k, 'right' FROM (SELECT c_custkey AS k FROM customer EXCEPT ALL SELECT o_custkey FROM orders)""",
)
def u2(v: Views) -> DataFrame:
    left = v.table("orders").select(F.col("o_custkey").alias("key"))
    right = v.table("customer").select(F.col("c_custkey").alias("key"))
    return quality.identity_difference(left, right, ["key"])


_LEAKY = """
SELECT *, CASE WHEN rn <= round_even(n * 0.2, 0) THEN 'test' ELSE 'train' END AS leaky_split
FROM (SELECT *, row_number() OVER (PARTITION BY binary_label
      ORDER BY sha256('7|' || example_id)) AS rn, count(*) OVER (PARTITION BY binary_label) AS n
  FROM examples WHERE is_primary)"""


def _leaky(v: Views) -> DataFrame:
    rows = v.examples.filter("is_primary").withColumn("label", F.col("binary_label"))
    return leaky_split(rows, 7)


@query(
    "u3_groups_crossing",
    f"""
SELECT count(*) AS question_groups_crossing_split FROM (
  SELECT question_id FROM ({_LEAKY}) WHERE leaky_split = 'train'
  INTERSECT SELECT question_id FROM ({_LEAKY}) WHERE leaky_split = 'test')""",
)
def u3(v: Views) -> DataFrame:
    return groups_crossing(_leaky(v), "leaky_split")


@query(
    "q1_group_leakage",
    f"""
SELECT question_id, count(DISTINCT leaky_split) AS splits FROM ({_LEAKY}) GROUP BY question_id
HAVING count(DISTINCT leaky_split) > 1""",
)
def q1(v: Views) -> DataFrame:
    return quality.group_leakage(_leaky(v), split="leaky_split")


@query(
    "q2_missing_classes",
    """
SELECT s.split, count(DISTINCT label) AS classes
FROM (VALUES ('de'), ('en'), ('es'), ('fr'), ('it')) s(split)
LEFT JOIN labelled_text l ON l.family = s.split GROUP BY s.split
HAVING count(DISTINCT label) <> 2""",
)
def q2(v: Views) -> DataFrame:
    # Languages take the place of splits: one of them has no texts.
    return quality.missing_classes(
        v.labelled_text.drop("split").withColumnRenamed("family", "split"),
        label="label",
        splits=("de", "en", "es", "fr", "it"),
    )


@query(
    "q3_freeze_validation",
    r"""
WITH pages_q AS (SELECT doc_id::VARCHAR AS question_id, source AS template_group,
    lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS prompt, doc_id FROM documents)
SELECT 'duplicate_prompt' AS rule, sha256(prompt) AS value, count(*) AS rows FROM pages_q
GROUP BY prompt HAVING count(*) > 1
UNION ALL
SELECT 'option_set', question_id, 1 FROM pages_q WHERE doc_id % 10 = 4""",
)
def q3(v: Views) -> DataFrame:
    full = F.create_map(*[F.lit(x) for x in ("A", "1", "B", "2", "C", "3", "D", "4")])
    three = F.create_map(*[F.lit(x) for x in ("A", "1", "B", "2", "C", "3")])
    rows = v.table("documents").select(
        F.col("doc_id").cast("string").alias("question_id"),
        F.col("source").alias("template_group"),
        F.col("text").alias("prompt"),
        F.when(F.col("doc_id") % 10 == 4, three).otherwise(full).alias("options"),
    )
    return quality.freeze_validation(rows)


@query(
    "q4_uniqueness",
    """
SELECT count(*) AS rows, count(DISTINCT doc_id) AS distinct_ids,
  count(DISTINCT text) AS distinct_prompts,
  count(*) = count(DISTINCT doc_id) AND count(*) = count(DISTINCT text) AS unique
FROM documents""",
)
def q4(v: Views) -> DataFrame:
    rows = v.table("documents").select(
        F.col("doc_id").alias("question_id"), F.col("text").alias("prompt")
    )
    return quality.uniqueness(rows)


_SUMMARY_SQL = """
SELECT count(*) AS completed, count(*) FILTER (parsed_answer IS NULL) AS invalid,
  count(*) FILTER (status = 'clean_stop') AS scorable,
  count(*) FILTER (status = 'length_truncated') AS truncated,
  count(*) FILTER (status = 'malformed') AS malformed,
  count(*) FILTER (status = 'parse_invalid') AS parse_invalid,
  count(*) FILTER (length(reasoning) > 0) AS reasoning_present,
  count(DISTINCT provider_request_id) AS unique_provider_request_ids,
  (sum(latency_seconds::DECIMAL(18, 6)) / count(*))::DOUBLE AS mean_latency_seconds,
  max(latency_seconds) AS max_latency_seconds
FROM rollout_texts"""


@query(
    "q6_smoke_gate",
    f"""
SELECT completed, scorable, truncated, truncated / completed::DOUBLE AS truncation_rate,
  good AS smoke_gate_passed, CASE WHEN invalid > 0 THEN 'complete_with_invalid' ELSE 'complete' END AS run_status,
  CASE WHEN NOT good THEN 'quality_failed' WHEN invalid > 0 THEN 'complete_with_invalid' ELSE 'complete' END AS smoke_status
FROM (SELECT *, scorable >= 1 AND truncated / completed::DOUBLE <= 0.1::DOUBLE AND parse_invalid = 0
  AND malformed = 0 AND unique_provider_request_ids = completed AS good FROM ({_SUMMARY_SQL}))""",
)
def q6(v: Views) -> DataFrame:
    report = gates.smoke_gate(
        aggregates.run_summary(v.rollout_texts),
        planned=F.col("completed"), min_scorable=1, max_truncation=0.1,
    )
    return report.select(
        "completed", "scorable", "truncated", "truncation_rate", "smoke_gate_passed",
        "run_status", "smoke_status",
    )


@query(
    "k1_path_counts",
    """
WITH walks AS (SELECT 0 AS step, 's1' AS node, 1::HUGEINT AS walks
  UNION ALL
  SELECT step + 1, node, sum(walks)::HUGEINT FROM (
    SELECT w.step, e.dst AS node, w.walks FROM walks w JOIN edges e ON e.src = w.node
    WHERE w.step < 5) GROUP BY step, node)
SELECT node, walks::BIGINT AS walks FROM walks WHERE step = 5""",
)
def k1(v: Views) -> DataFrame:
    found = graph.path_counts(v.edges, "s1", 5)
    return found.select("node", F.col("walks").cast("long").alias("walks"))


