"""Record schemas and fixed vocabularies."""

from __future__ import annotations

# Treatment arms, statuses, grades, labels and component names.
CLEAN = "clean"
CORRECT_CONTINUATION = "correct_continuation"
CORRUPTED_CONTINUATION = "corrupted_continuation"
CONDITIONS = (
    "clean",
    "incorrect_answer_hint",
    "intermediate_incorrect_answer_hint",
    "peer_scratch_note",
    "authority_informational_hint",
    "ordinary_directive_hint",
    "authority_directive_hint",
    "trusted_incorrect_answer_hint",
    "irrelevant_metadata",
    "correct_partial_solution",
    "corrupted_partial_solution",
    "correct_continuation",
    "corrupted_continuation",
    "correct_assistant_prefill",
    "corrupted_assistant_prefill",
)
HINT_CONDITIONS = (
    "incorrect_answer_hint",
    "intermediate_incorrect_answer_hint",
    "peer_scratch_note",
    "authority_informational_hint",
    "ordinary_directive_hint",
    "authority_directive_hint",
    "trusted_incorrect_answer_hint",
    "corrupted_partial_solution",
    "corrupted_continuation",
    "corrupted_assistant_prefill",
)
SHIFT_ARMS = (CLEAN, CORRECT_CONTINUATION, CORRUPTED_CONTINUATION)
CLEAN_STOP = "clean_stop"
PARSE_INVALID = "parse_invalid"
LENGTH_TRUNCATED = "length_truncated"
MALFORMED = "malformed"
SPLITS = ("train", "validation", "test")
JUDGE_VIEWS = ("transcript_only", "context_aware")
PREVALENCES = (0.5, 0.1, 0.05, 0.01)
OPTION_LABELS = ("A", "B", "C", "D")

QUESTION = (
    "question_id STRING, task_family STRING, prompt STRING, options MAP<STRING,STRING>, "
    "gold_answer STRING, difficulty STRING, template_group STRING, source STRING, metadata STRING"
)
MATH_PROBLEM = (
    "question_id STRING, task_family STRING, prompt STRING, gold_answer STRING, "
    "difficulty STRING, template_group STRING, source STRING, metadata STRING"
)
ROLLOUT = (
    "rollout_id STRING, question_id STRING, task_family STRING, condition STRING, "
    "hinted_option STRING, hint_template STRING, prompt STRING, response STRING, "
    "reasoning STRING, final_response STRING, parsed_answer STRING, gold_answer STRING, "
    "seed INT, model STRING, generation MAP<STRING,DOUBLE>, finish_reason STRING, "
    "created_at TIMESTAMP, usage MAP<STRING,BIGINT>, provider_request_id STRING, "
    "provider_model STRING, latency_seconds DOUBLE, status STRING, parse_termination STRING, "
    "raw_response STRING, assistant_prefill STRING, generated_reasoning STRING, "
    "prefill_tokens INT"
)
JUDGE_SCORE = (
    "score_id STRING, example_id STRING, question_id STRING, split STRING, view STRING, "
    "score DOUBLE, rationale STRING, model STRING, prompt_version STRING, seed INT, "
    "attempts INT, provider_request_id STRING, finish_reason STRING, usage MAP<STRING,BIGINT>"
)
COMPONENT_SCORE = (
    "example_id STRING, question_id STRING, split STRING, component STRING, score DOUBLE, "
    "score_origin STRING"
)
