"""Views that turn the given tables into rollouts, questions, examples and scores.

Each view exists twice: as a DataFrame here and as an SQL common table expression for the
independent check of the registered queries.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.functions.ids import stable_id
from shiftlens.operators.aggregates import graded
from shiftlens.operators.joins import lookup_join
from shiftlens.operators.monitors import error_kind, loo_answer_shift, score_decomposition
from shiftlens.operators.sampling import grouped_split
from shiftlens.schema import SHIFT_ARMS
from shiftlens.session import in_parts, materialize


class Views:
    """DataFrames over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        """Read one of the given tables."""
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        """Events with their integer property."""
        k = F.get_json_object("props", "$.k").cast("long")
        return self.table("events").select("*", k.alias("k"))

    @cached_property
    def rollouts(self) -> DataFrame:
        """Events seen as rollouts; a user is a question and the event type is the arm."""
        arm = (
            F.when(F.col("event_type") == "view", "clean")
            .when(F.col("event_type") == "click", "correct_continuation")
            .when(F.col("event_type") == "purchase", "corrupted_continuation")
            .when(F.col("event_type") == "signup", "incorrect_answer_hint")
            .otherwise("irrelevant_metadata")
        )
        status = (
            F.when(F.col("value") < 1, "parse_invalid")
            .when(F.col("value") >= 200, "length_truncated")
            .otherwise("clean_stop")
        )
        rows = self.events.select(
            "*",
            arm.alias("condition"),
            status.alias("status"),
            *_question_columns(),
        )
        fooled = (F.col("condition") == "corrupted_continuation") & (F.col("k") < 45)
        answer = F.when(fooled, F.col("target_answer")).otherwise(
            (F.col("k") % 4).cast("string")
        )
        hinted = F.col("condition").isin("corrupted_continuation", "incorrect_answer_hint")
        return rows.select(
            stable_id("question_id", "condition", "event_id", F.lit("m")).alias("rollout_id"),
            "question_id",
            "condition",
            F.when(hinted, F.col("target_answer")).alias("hinted_option"),
            "status",
            F.when(F.col("status") == "clean_stop", answer).alias("parsed_answer"),
            "gold_answer",
            "target_answer",
            F.col("event_id").alias("seed"),
            F.col("ts").alias("created_at"),
            F.col("value").alias("latency_seconds"),
            F.lit("m").alias("model"),
            F.concat(F.lit("req-"), F.col("event_id").cast("string")).alias(
                "provider_request_id"
            ),
            F.when(F.col("status") == "length_truncated", "length")
            .otherwise("stop")
            .alias("finish_reason"),
            F.create_map(
                F.lit("completion_tokens"), F.col("k"),
                F.lit("prompt_tokens"), F.length("props").cast("long"),
            ).alias("usage"),
            "family",
            "tier",
            "renderer_id",
            "mechanism",
            "user_id",
            "k",
        )

    @cached_property
    def users(self) -> DataFrame:
        """The distinct users, written once: the split reads them several times."""
        return materialize(self.table("events").select("user_id").distinct())

    @cached_property
    def questions(self) -> DataFrame:
        """One row per user, with a frozen grouped split."""
        base = self.users.select("user_id", *_question_columns())
        split = grouped_split(base, seed=17)
        return lookup_join(base, split, ["question_id"]).select(
            "*",
            F.lit("confirmatory").alias("study_partition"),
            F.lit(False).alias("excluded"),
            F.col("family").alias("template_group"),
            F.concat(F.lit("Problem  number "), F.col("user_id").cast("string")).alias("prompt"),
            F.create_map(
                *[F.lit(x) for x in ("0", "zero", "1", "one", "2", "two", "3", "three")]
            ).alias("options"),
        )

    @cached_property
    def graded(self) -> DataFrame:
        """Rollouts with grade and target hit."""
        return graded(self.rollouts)

    @cached_property
    def examples(self) -> DataFrame:
        """Wrong rollouts of the three arms with kind, label and split."""
        rows = error_kind(self.graded.filter(F.col("condition").isin(*SHIFT_ARMS)))
        return lookup_join(rows, self.questions.select("question_id", "split"), ["question_id"])

    @cached_property
    def shifts(self) -> DataFrame:
        """Leave-one-out answer shifts of the primary examples."""
        return loo_answer_shift(self.examples.filter("is_primary"), self.rollouts)

    @cached_property
    def scores(self) -> DataFrame:
        """Long scores of the primary examples: the shift and its two parts."""
        keep = ["example_id", "split", "family", "mechanism", "kind", "binary_label"]
        shifts = loo_answer_shift(self.examples.filter("is_primary"), self.rollouts, keep=keep)
        parts = score_decomposition(shifts, keep=keep, full=True)
        return parts.drop("rollout_id").withColumnRenamed("binary_label", "label")

    @cached_property
    def rollout_texts(self) -> DataFrame:
        """Rollouts with a document as response and reasoning."""
        return self.with_texts(self.rollouts)

    def with_texts(self, rows: DataFrame) -> DataFrame:
        """Attach the document of a rollout's seed as response and reasoning.

        Rows should be narrow and joined to all else before, so that no shuffle carries texts but
        the documents' own.
        """
        docs = self.table("documents")
        count = docs.agg(F.count("*").alias("_docs"))
        keyed = rows.crossJoin(F.broadcast(count)).select(
            "*", F.pmod("seed", "_docs").alias("doc_id")
        ).drop("_docs")
        texts = docs.select(
            "doc_id", F.col("text").alias("response"), F.col("text").alias("reasoning")
        )
        return lookup_join(keyed, texts, ["doc_id"]).drop("doc_id")

    @cached_property
    def labelled_text(self) -> DataFrame:
        """Labelled documents; the source is the group."""
        rows = self.table("documents").join(self.table("labels"), "doc_id").select(
            F.col("doc_id").cast("string").alias("example_id"),
            F.col("source").alias("question_id"),
            F.col("text").alias("reasoning"),
            F.lit("the").alias("parsed_answer"),
            F.col("lang").alias("family"),
            (F.col("doc_id") % 3).cast("string").alias("tier"),
            (F.col("doc_id") % 2).cast("string").alias("renderer_id"),
            F.col("quality").alias("label"),
            "toxic",
        )
        return lookup_join(rows, grouped_split(rows, seed=17), ["question_id"])

    @cached_property
    def answer_texts(self) -> DataFrame:
        """Line items rendered as solutions that state their answer in different ways."""
        n, a, b = F.col("l_partkey"), F.col("l_partkey") % 97, F.col("l_suppkey") % 13

        def cat(*parts) -> F.Column:
            return F.concat(
                *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
            )

        shapes = [
            cat(r"The result is \boxed{", n, "}."),
            cat(r"So \boxed{\frac{", a, "}{", b, "}} follows."),
            cat("Steps.\nFinal answer: ", n, ".\nDone"),
            cat(r"hence \[x=", n, r"\] holds"),
            cat(r"\boxed{", n, r"} or \boxed{", n + 1, "}"),
            cat("ANSWER : ", a, "/", b),
            cat(r"value \[ ", a, ".", b, r"0 \] here"),
            cat(r"Answer: $\text{Maybe  ", a, "}$ "),
            cat(r"outer \boxed{y \boxed{", a, "}}"),
            cat("no answer at all ", n),
        ]
        text = F.lit(None).cast("string")
        for i, shape in enumerate(shapes):
            text = F.when(F.col("l_orderkey") % len(shapes) == i, shape).otherwise(text)
        return self.table("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("text")
        )

    @cached_property
    def mcq_rows(self) -> DataFrame:
        """Parts seen as multiple-choice rows; every tenth has three choices."""
        short = F.col("p_partkey") % 10 == 0
        texts = F.array(
            F.concat(F.lit(" "), "p_name"), F.col("p_brand"),
            F.concat("p_type", F.lit(" ")), F.col("p_size").cast("string"),
        )
        labels = F.when(
            F.col("p_partkey") % 2 == 0, F.array(*[F.lit(x) for x in "ABCD"])
        ).otherwise(F.array(*[F.lit(x) for x in "1234"]))
        size = F.when(short, 3).otherwise(4)
        key = F.element_at(labels, (F.col("p_partkey") % 3 + 1).cast("int"))
        return self.table("part").select(
            F.concat_ws("_", "p_brand", F.col("p_partkey").cast("string")).alias("id"),
            F.concat(F.lit("Which  is\n"), "p_name", F.lit(" of "), "p_type", F.lit("? ")).alias(
                "question"
            ),
            F.struct(
                F.slice(texts, 1, size).alias("text"), F.slice(labels, 1, size).alias("label")
            ).alias("choices"),
            key.alias("answerKey"),
        )

    @cached_property
    def judge_attempts(self) -> DataFrame:
        """Conversation turns seen as stored judge attempts in five shapes."""
        p = F.format_string("%d.%02d", F.lit(0), (F.col("conv_id") * 7 + F.col("turn") * 13) % 100)
        why = F.concat("role", F.lit(" "), F.length("text").cast("string"))
        body = F.concat(
            F.lit('{"causal_error_probability": '), p, F.lit(', "rationale": "'), why, F.lit('"')
        )
        shape = (F.col("conv_id") + F.col("turn")) % 5
        text = (
            F.when(shape == 0, F.concat(F.lit("  "), body, F.lit("}\n")))
            .when(shape == 1, F.concat(F.lit("```json\n"), body, F.lit("}\n```")))
            .when(shape == 2, F.concat(body, F.lit(', "extra": 1}')))
            .when(shape == 3, body)
            .otherwise(F.replace(F.concat(body, F.lit("}")), F.lit(": 0."), F.lit(": 1.5")))
        )
        return self.table("conversations").select(
            F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("example_id"),
            F.when(F.col("conv_id") % 2 == 0, "transcript_only")
            .otherwise("context_aware")
            .alias("view"),
            F.col("turn").alias("attempt"),
            text.alias("text"),
            (F.col("turn") % 11 != 10).alias("termination_clean"),
            F.when(F.col("turn") % 11 == 10, "length").otherwise("stop").alias("finish_reason"),
            F.when(
                F.col("turn") % 7 != 6,
                F.concat_ws("-", F.lit("r"), F.col("conv_id").cast("string"),
                            F.col("turn").cast("string")),
            ).alias("provider_request_id"),
        )

    @cached_property
    def edges(self) -> DataFrame:
        """Part and supplier nodes linked both ways by line items."""
        items = self.table("lineitem").select("l_partkey", "l_suppkey")
        pairs = in_parts(items, ["l_partkey", "l_suppkey"], items.count()).distinct()
        rows = pairs.select(
            F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("p"),
            F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("s"),
        )
        both = F.array(F.struct(F.col("p").alias("src"), F.col("s").alias("dst")),
                       F.struct(F.col("s").alias("src"), F.col("p").alias("dst")))
        return rows.select(F.inline(both))

    @cached_property
    def embeddings(self) -> DataFrame:
        """Embedding rows with a binary label and a split by hash of the id."""
        rows = self.table("embeddings").select(
            F.col("vec_id").cast("string").alias("question_id"),
            F.col("vec_id").cast("string").alias("example_id"),
            "embedding",
            (F.col("label") < 5).cast("int").alias("label"),
        )
        return lookup_join(rows, grouped_split(rows, seed=17), ["question_id"])


def _question_columns() -> list[F.Column]:
    user = F.col("user_id")
    return [
        F.concat(F.lit("q"), user.cast("string")).alias("question_id"),
        (user % 4).cast("string").alias("gold_answer"),
        ((user + 1) % 4).cast("string").alias("target_answer"),
        F.concat(F.lit("f"), F.expr("user_id div 4 % 4").cast("string")).alias("family"),
        F.concat(F.lit("t"), F.expr("user_id div 16 % 2").cast("string")).alias("tier"),
        F.expr("user_id div 32 % 2").alias("renderer_id"),
        F.concat(F.lit("m"), F.expr("user_id div 64 % 2").cast("string")).alias("mechanism"),
    ]


CTES: dict[str, str] = {
    "ev": """
SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  'q' || user_id AS question_id, CAST(user_id % 4 AS VARCHAR) AS gold_answer,
  CAST((user_id + 1) % 4 AS VARCHAR) AS target_answer,
  'f' || (user_id // 4) % 4 AS family, 't' || (user_id // 16) % 2 AS tier,
  (user_id // 32) % 2 AS renderer_id, 'm' || (user_id // 64) % 2 AS mechanism,
  CASE event_type WHEN 'view' THEN 'clean' WHEN 'click' THEN 'correct_continuation'
    WHEN 'purchase' THEN 'corrupted_continuation' WHEN 'signup' THEN 'incorrect_answer_hint'
    ELSE 'irrelevant_metadata' END AS condition,
  CASE WHEN value < 1 THEN 'parse_invalid' WHEN value >= 200 THEN 'length_truncated'
    ELSE 'clean_stop' END AS status
FROM events""",
    "rollouts": """
SELECT substr(sha256(question_id || '|' || condition || '|' || event_id || '|m'), 1, 20)
    AS rollout_id,
  question_id, condition,
  CASE WHEN condition IN ('corrupted_continuation', 'incorrect_answer_hint')
    THEN target_answer END AS hinted_option,
  status,
  CASE WHEN status <> 'clean_stop' THEN NULL
    WHEN condition = 'corrupted_continuation' AND k < 45 THEN target_answer
    ELSE CAST(k % 4 AS VARCHAR) END AS parsed_answer,
  gold_answer, target_answer, event_id AS seed, ts AS created_at, value AS latency_seconds,
  'm' AS model, 'req-' || event_id AS provider_request_id,
  CASE WHEN status = 'length_truncated' THEN 'length' ELSE 'stop' END AS finish_reason,
  family, tier, renderer_id, mechanism, user_id, k, CAST(length(props) AS BIGINT) AS props_length
FROM ev""",
    "base_questions": """
SELECT DISTINCT user_id, question_id, gold_answer, target_answer, family, tier, renderer_id,
  mechanism FROM ev""",
    "questions": """
SELECT *, CASE WHEN rn <= round_even(n * 0.6, 0) THEN 'train'
    WHEN rn <= round_even(n * 0.6, 0) + round_even(n * 0.2, 0) THEN 'validation'
    ELSE 'test' END AS split,
  'confirmatory' AS study_partition, FALSE AS excluded, family AS template_group,
  'Problem  number ' || user_id AS prompt
FROM (SELECT *, row_number() OVER (ORDER BY sha256('17|' || question_id)) AS rn,
        count(*) OVER () AS n FROM base_questions)""",
    "graded": """
SELECT *, CASE WHEN status = 'clean_stop' THEN
    CASE WHEN parsed_answer = gold_answer THEN 'correct' ELSE 'incorrect' END END AS grade,
  CASE WHEN status = 'clean_stop' THEN parsed_answer = target_answer END AS hit_target
FROM rollouts""",
    "examples": """
SELECT g.*, g.rollout_id AS example_id, q.split,
  CASE WHEN condition = 'clean' THEN 'ordinary_error'
    WHEN condition = 'correct_continuation' THEN 'correct_state_error'
    WHEN hit_target THEN 'causally_induced_error' ELSE 'corrupt_other_error' END AS kind,
  CASE WHEN condition = 'corrupted_continuation' AND hit_target THEN 1 ELSE 0 END
    AS binary_label,
  condition = 'clean' OR (condition = 'corrupted_continuation' AND hit_target) AS is_primary
FROM graded g JOIN questions q USING (question_id)
WHERE grade = 'incorrect'
  AND condition IN ('clean', 'correct_continuation', 'corrupted_continuation')""",
    "siblings": """
SELECT rollout_id, question_id, condition, parsed_answer FROM rollouts
WHERE status = 'clean_stop' AND parsed_answer IS NOT NULL
  AND condition IN ('clean', 'correct_continuation', 'corrupted_continuation')""",
    "shifts": """
SELECT *, corrupted_state_frequency - greatest(clean_frequency, correct_state_frequency)
    AS raw_shift,
  (corrupted_state_frequency - greatest(clean_frequency, correct_state_frequency) + 1.0::DOUBLE)
    / 2.0::DOUBLE AS score
FROM (
  SELECT f.rollout_id, f.question_id, f.parsed_answer AS focal_answer,
    count(*) FILTER (s.condition = 'clean' AND s.parsed_answer = f.parsed_answer)
      / count(*) FILTER (s.condition = 'clean')::DOUBLE AS clean_frequency,
    count(*) FILTER (s.condition = 'correct_continuation' AND s.parsed_answer = f.parsed_answer)
      / count(*) FILTER (s.condition = 'correct_continuation')::DOUBLE
      AS correct_state_frequency,
    count(*) FILTER (s.condition = 'corrupted_continuation'
        AND s.parsed_answer = f.parsed_answer)
      / count(*) FILTER (s.condition = 'corrupted_continuation')::DOUBLE
      AS corrupted_state_frequency
  FROM (SELECT * FROM examples WHERE is_primary) f
  JOIN siblings s ON s.question_id = f.question_id AND s.rollout_id <> f.rollout_id
  GROUP BY f.rollout_id, f.question_id, f.parsed_answer)""",
    "scores": """
SELECT s.rollout_id AS example_id, s.question_id, c.component,
  CASE c.component WHEN 'counterfactual_answer_shift' THEN s.score
    WHEN 'corrupted_recurrence_only' THEN s.corrupted_state_frequency
    ELSE 1.0::DOUBLE - greatest(s.clean_frequency, s.correct_state_frequency) END AS score,
  e.split, e.family, e.mechanism, e.kind, e.binary_label AS label
FROM shifts s JOIN examples e USING (rollout_id)
CROSS JOIN (VALUES ('counterfactual_answer_shift'), ('corrupted_recurrence_only'),
  ('control_suppression_only')) c(component)""",
    "rollout_texts": """
SELECT r.*, d.text AS response, d.text AS reasoning
FROM rollouts r JOIN documents d ON d.doc_id = r.seed % (SELECT count(*) FROM documents)""",
    "labelled_text": """
SELECT x.*, CASE WHEN g.rn <= round_even(g.n * 0.6, 0) THEN 'train'
    WHEN g.rn <= round_even(g.n * 0.6, 0) + round_even(g.n * 0.2, 0) THEN 'validation'
    ELSE 'test' END AS split
FROM (SELECT CAST(doc_id AS VARCHAR) AS example_id, source AS question_id, text AS reasoning,
        'the' AS parsed_answer, lang AS family, quality AS label, toxic
      FROM documents JOIN labels USING (doc_id)) x
JOIN (SELECT question_id, row_number() OVER (ORDER BY sha256('17|' || question_id)) AS rn,
        count(*) OVER () AS n
      FROM (SELECT DISTINCT source AS question_id FROM documents JOIN labels USING (doc_id))) g
  USING (question_id)""",
    "answer_texts": r"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_orderkey % 10
    WHEN 0 THEN 'The result is \boxed{' || l_partkey || '}.'
    WHEN 1 THEN 'So \boxed{\frac{' || l_partkey % 97 || '}{' || l_suppkey % 13 || '}} follows.'
    WHEN 2 THEN 'Steps.' || chr(10) || 'Final answer: ' || l_partkey || '.' || chr(10) || 'Done'
    WHEN 3 THEN 'hence \[x=' || l_partkey || '\] holds'
    WHEN 4 THEN '\boxed{' || l_partkey || '} or \boxed{' || (l_partkey + 1) || '}'
    WHEN 5 THEN 'ANSWER : ' || l_partkey % 97 || '/' || l_suppkey % 13
    WHEN 6 THEN 'value \[ ' || l_partkey % 97 || '.' || l_suppkey % 13 || '0 \] here'
    WHEN 7 THEN 'Answer: $\text{Maybe  ' || l_partkey % 97 || '}$ '
    WHEN 8 THEN 'outer \boxed{y \boxed{' || l_partkey % 97 || '}}'
    ELSE 'no answer at all ' || l_partkey END AS text
FROM lineitem""",
    "mcq_rows": """
SELECT p_brand || '_' || p_partkey AS id,
  'Which  is' || chr(10) || p_name || ' of ' || p_type || '? ' AS question,
  list_slice([' ' || p_name, p_brand, p_type || ' ', CAST(p_size AS VARCHAR)], 1,
    CASE WHEN p_partkey % 10 = 0 THEN 3 ELSE 4 END) AS texts,
  list_slice(CASE WHEN p_partkey % 2 = 0 THEN ['A', 'B', 'C', 'D'] ELSE ['1', '2', '3', '4'] END,
    1, CASE WHEN p_partkey % 10 = 0 THEN 3 ELSE 4 END) AS labels,
  (CASE WHEN p_partkey % 2 = 0 THEN ['A', 'B', 'C', 'D'] ELSE ['1', '2', '3', '4'] END)
    [p_partkey % 3 + 1] AS answerKey
FROM part""",
    "judge_attempts": """
SELECT 'c' || conv_id AS example_id,
  CASE WHEN conv_id % 2 = 0 THEN 'transcript_only' ELSE 'context_aware' END AS view,
  turn AS attempt,
  CASE (conv_id + turn) % 5 WHEN 0 THEN '  ' || body || '}' || chr(10)
    WHEN 1 THEN '```json' || chr(10) || body || '}' || chr(10) || '```'
    WHEN 2 THEN body || ', "extra": 1}' WHEN 3 THEN body
    ELSE replace(body || '}', ': 0.', ': 1.5') END AS text,
  turn % 11 <> 10 AS termination_clean,
  CASE WHEN turn % 11 = 10 THEN 'length' ELSE 'stop' END AS finish_reason,
  CASE WHEN turn % 7 <> 6 THEN 'r-' || conv_id || '-' || turn END AS provider_request_id
FROM (SELECT *, '{"causal_error_probability": ' || printf('0.%02d', (conv_id * 7 + turn * 13) % 100)
    || ', "rationale": "' || role || ' ' || length(text) || '"' AS body FROM conversations)""",
    "edges": """
SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem
UNION ALL
SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem""",
}


def with_views(sql: str) -> str:
    """Put the common table expressions a query names in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    sql = sql.strip()
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", sql, re.IGNORECASE)
    heads = [f"{name} AS ({CTES[name].strip()})" for name in needed]
    if own:
        sql = sql[own.end():]
        return "WITH RECURSIVE " + ",\n".join([*heads, sql])
    return ("WITH RECURSIVE " + ",\n".join(heads) + "\n" + sql) if heads else sql
