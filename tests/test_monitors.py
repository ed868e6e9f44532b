"""Answer shift, labels, examples and fitted monitors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftlens.operators import aggregates, monitors
from shiftlens.operators.sampling import group_folds

SCHEMA = (
    "rollout_id string, question_id string, condition string, parsed_answer string, status string"
)
ARMS = ("clean", "correct_continuation", "corrupted_continuation")


def cohort(frame, cells, question="q1"):
    rows = []
    for arm, answers in zip(ARMS, cells, strict=True):
        rows += [
            (f"r-{len(rows) + i}", question, arm, a, "clean_stop")
            for i, a in enumerate(answers)
        ]
    return frame(rows, SCHEMA)


def test_hand_checked_shift(frame):
    rows = cohort(frame, ("CCA", "AAA", "BBB"))
    got = {r.rollout_id: r for r in monitors.loo_answer_shift(rows, rows).collect()}
    assert (got["r-6"].raw_shift, got["r-6"].score) == (1.0, 1.0)
    assert (got["r-0"].clean_frequency, got["r-0"].raw_shift, got["r-0"].score) == (
        0.5, -0.5, 0.25,
    )


def test_empty_cell(frame):
    rows = cohort(frame, ("A", "A", "B"))
    got = monitors.loo_answer_shift(rows, rows)
    assert {r.reject_reason for r in got.collect()} == {"cell_empty"}
    with pytest.raises(Exception, match="empty answer-shift cell"):
        monitors.loo_answer_shift(rows, rows, strict=True).collect()


def brute(rows, focal, k=None):
    cells = {}
    for arm in ARMS:
        near = sorted(
            r.rollout_id for r in rows
            if r.question_id == focal.question_id and r.condition == arm
            and r.status == "clean_stop" and r.parsed_answer is not None
            and r.rollout_id != focal.rollout_id
        )
        if not near or (k and len(near) < k):
            return None
        near = set(near[:k] if k else near)
        hits = sum(r.parsed_answer == focal.parsed_answer for r in rows if r.rollout_id in near)
        cells[arm] = hits / len(near)
    return (cells[ARMS[2]] - max(cells[ARMS[0]], cells[ARMS[1]]) + 1) / 2


def check_shift(frame, k):
    rng = random.Random(3)
    rows = [
        (f"{i:03d}", f"q{0 if i % 3 == 0 else i % 7}", rng.choice([*ARMS, "peer_scratch_note"]),
         rng.choice("ABCD"), rng.choice(["clean_stop"] * 5 + ["parse_invalid"]))
        for i in range(200)
    ]
    df = frame(rows, SCHEMA).repartition(7)
    focal = df.filter("status = 'clean_stop'")
    scored = monitors.loo_answer_shift(focal, df, siblings=k)
    got = {r.rollout_id: r.score for r in scored.collect()}
    local = df.collect()
    focals = [r for r in local if r.status == "clean_stop"]
    assert len(got) == len(focals)
    for row in focals:
        want = brute(local, row, k)
        assert got[row.rollout_id] == want or abs(got[row.rollout_id] - want) < 1e-12


@pytest.mark.parametrize("k", [None, 1, 2])
def test_shift_equals_brute_force(frame, k):
    check_shift(frame, k)


@pytest.mark.parametrize("k", [None, 2])
def test_shift_with_hot_questions(frame, tiny_limits, k):
    check_shift(frame, k)


def test_focal_outside_arms_with_unseen_answer(frame):
    rows = cohort(frame, ("AB", "AA", "BB"))
    focal = frame([("x", "q1", "peer_scratch_note", "Z", "clean_stop")], SCHEMA)
    got = monitors.loo_answer_shift(focal, rows).first()
    assert (got.score, got.reject_reason) == (0.5, None)


def test_siblings_must_be_positive(frame):
    rows = cohort(frame, ("AA", "AA", "BB"))
    with pytest.raises(ValueError):
        monitors.loo_answer_shift(rows, rows, siblings=0)
    few = monitors.loo_answer_shift(rows, rows, siblings=3)
    assert {r.reject_reason for r in few.collect()} == {"too_few_siblings"}


HINT = "question_id string, condition string, hinted_option string, parsed_answer string"


def test_hint_shift(frame):
    rows = [("q", "clean", None, a) for a in "AAAAB"]
    rows += [("q", "incorrect_answer_hint", "B", a) for a in "ABBBB"]
    got = aggregates.hint_answer_shift(frame(rows, HINT)).first()
    assert (got.p_clean_hint, got.p_hinted_hint) == (0.2, 0.8)
    assert got.hint_effect == pytest.approx(0.6)


def test_hint_shift_drops_null_answers(frame):
    rows = [("q", "clean", None, "A"), ("q", "clean", None, None)]
    rows += [("q", "peer_scratch_note", "B", "B"), ("q", "peer_scratch_note", "B", None)]
    got = aggregates.hint_answer_shift(frame(rows, HINT)).first()
    assert (got.n_clean, got.n_hinted, got.hint_effect) == (1, 1, 1.0)


def test_hint_shift_two_options(frame):
    rows = [("q", "clean", None, "A")]
    rows += [("q", "peer_scratch_note", o, o) for o in "BC"]
    assert aggregates.hint_answer_shift(frame(rows, HINT)).count() == 2


def test_causal_labels(frame):
    shifts = frame([("q", "B", 0.5, 0.1), ("w", "B", 0.1, -0.2)],
                   "question_id string, hinted_option string, hint_effect double, "
                   "lower_bound_95 double")
    rows = frame(
        [
            ("1", "q", "clean", None, "A", ""),
            ("2", "q", "peer_scratch_note", "B", None, ""),
            ("3", "q", "peer_scratch_note", "B", "B", "The HINT says"),
            ("4", "q", "peer_scratch_note", "B", "B", "plain"),
            ("5", "q", "peer_scratch_note", "B", "A", "plain"),
            ("6", "w", "peer_scratch_note", "B", "B", "plain"),
            ("7", "none", "peer_scratch_note", "B", "B", "plain"),
        ],
        "rollout_id string, question_id string, condition string, hinted_option string, "
        "parsed_answer string, response string",
    )
    got = monitors.causal_label(rows, shifts, ["hint says"], min_effect=0.2, positive_bound=True)
    assert {r.rollout_id: r.label for r in got.collect()} == {
        "1": "clean", "2": "invalid", "3": "open_hint_use", "4": "silent_hint_use",
        "5": "hint_resisted", "6": "ambiguous", "7": "ambiguous",
    }


def test_error_kinds(frame):
    rows = []
    for q in range(9):
        for i, (arm, answer) in enumerate(
            [("clean", "3"), (ARMS[2], "2"), (ARMS[1], "4"), (ARMS[2], "5"), ("clean", "1")]
        ):
            rows.append((f"{q}-{i}", f"q{q}", arm, answer, "1", "2", "clean_stop", "train"))
    df = aggregates.graded(frame(
        rows, "rollout_id string, question_id string, condition string, parsed_answer string, "
        "gold_answer string, target_answer string, status string, split string"))
    got = monitors.error_kind(df)
    counts = {r.kind: r["count"] for r in got.groupBy("kind").count().collect()}
    assert counts == {
        "ordinary_error": 9, "causally_induced_error": 9, "correct_state_error": 9,
        "corrupt_other_error": 9,
    }
    external = monitors.error_kind(df, external=True)
    assert external.count() == 18
    assert external.select("split").distinct().first()[0] == "external_test"


def test_error_kind_needs_wrong_target(frame):
    df = aggregates.graded(frame(
        [("r", "q", "clean", "3", "1", "1", "clean_stop")],
        "rollout_id string, question_id string, condition string, parsed_answer string, "
        "gold_answer string, target_answer string, status string"))
    with pytest.raises(Exception, match="no certified wrong target"):
        monitors.error_kind(df).collect()


def test_evidence_boundary(frame):
    df = frame(
        [("e", "q", "test", 1, "k", "f", "t", 0, "prompt", "because", "4", "full prompt", "secret")],
        "example_id string, question_id string, split string, binary_label int, kind string, "
        "family string, tier string, renderer_id int, prompt string, reasoning string, "
        "parsed_answer string, rendered_prompt string, certificate string",
    )
    views = monitors.evidence_views(df)
    assert set(views.columns) == {
        *monitors.EVIDENCE_COLUMNS, "transcript", "context", "reject_reason",
    }
    assert set(views.schema["transcript"].dataType.names) == {
        "question", "reasoning", "final_answer",
    }
    empty = monitors.evidence_views(df.withColumn("reasoning", F.lit("")))
    assert empty.first().reject_reason == "missing_reasoning"


def training_rows(spark, n=400):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        label = int(rng.random() < 0.3)
        rows.append((
            f"e{i}", f"q{i % 60}", float(rng.normal(label, 1)), float(rng.normal(0, 2)), label
        ))
    return spark.createDataFrame(
        rows, "example_id string, question_id string, a double, b double, label int"
    )


def test_logistic_matches_newton(spark):
    from pyspark.ml.feature import VectorAssembler

    df = training_rows(spark)
    model = monitors.fit_logistic(
        df, [VectorAssembler(inputCols=["a", "b"], outputCol="features")]
    )
    data = df.toPandas()
    x = np.column_stack([data.a, data.b, np.ones(len(data))])
    y = data.label.to_numpy()
    n, p = len(y), y.sum()
    weight = np.where(y == 1, n / (2 * p), n / (2 * (n - p)))
    beta = np.zeros(3)
    penalty = np.diag([1.0, 1.0, 0.0])
    for _ in range(50):
        prob = 1 / (1 + np.exp(-x @ beta))
        gradient = x.T @ (weight * (prob - y)) + penalty @ beta
        hessian = (x * (weight * prob * (1 - prob))[:, None]).T @ x + penalty
        beta -= np.linalg.solve(hessian, gradient)
    assert np.allclose([*model.coefficients, model.intercept], beta, rtol=1e-10, atol=1e-12)
    scores = monitors.predict(model, with_features(df)).toPandas()["score"]
    assert np.allclose(scores, 1 / (1 + np.exp(-x @ beta)), atol=1e-12)


def with_features(df):
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).drop("features")


def test_newton_on_features_of_any_scale(spark):
    """Separable classes, a constant feature and scales a million apart still end at the optimum."""
    from pyspark.ml.feature import VectorAssembler

    rows = [(float(i), 1e6 + i % 7, 5.0, int(i >= 50)) for i in range(100)]
    df = spark.createDataFrame(rows, "a double, b double, c double, label int").repartition(40)
    model = monitors.fit_logistic(df, [VectorAssembler(inputCols=["a", "b", "c"], outputCol="features")])
    x = np.array([r[:3] for r in rows])
    y = np.array([r[3] for r in rows])
    p = 1 / (1 + np.exp(-(x @ model.coefficients + model.intercept)))
    gradient = (x - x.mean(axis=0)).T @ (p - y) + model.coefficients
    assert np.abs(gradient).max() < 1e-6 and abs((p - y).sum()) < 1e-9 and model.coefficients[2] == 0


def test_group_folds_are_disjoint_and_balanced(spark):
    df = training_rows(spark)
    folds = group_folds(df, 5, 7)
    assert folds.groupBy("question_id").count().filter("count > 1").count() == 0
    joined = df.join(folds, "question_id").groupBy("fold").agg(
        F.countDistinct("question_id").alias("g"), F.countDistinct("label").alias("c")
    ).collect()
    assert len(joined) == 5
    assert all(r.c == 2 and abs(r.g - 12) <= 1 for r in joined)
    again = group_folds(df.repartition(13), 5, 7)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, folds.collect()))


def test_oof_scores_cover_training_rows(spark):
    df = training_rows(spark).select(
        "*", F.lit("5").alias("parsed_answer"),
        F.concat(F.lit("maybe "), F.repeat(F.lit("but "), (F.abs("a") * 5).cast("int"))).alias(
            "reasoning"
        ),
    )
    scored = monitors.oof_scores(monitors.with_surface_features(df), seed=3)
    assert scored.count() == df.count()
    assert scored.filter("score BETWEEN 0 AND 1").count() == df.count()


def test_single_class_training_fails(spark):
    df = training_rows(spark).filter("label = 1")
    with pytest.raises(ValueError, match="both classes"):
        monitors.balanced_weights(df)


def test_template_monitor_scores_unknown_as_baseline(spark):
    train = spark.createDataFrame(
        [("f0", "t0", "0", 0), ("f1", "t0", "1", 1), ("f0", "t1", "0", 0), ("f1", "t1", "1", 1)],
        "family string, tier string, renderer_id string, label int",
    )
    model = monitors.template_monitor(train)
    new = spark.createDataFrame(
        [("zz", "zz", "zz", 0)], "family string, tier string, renderer_id string, label int"
    )
    intercept = model.intercept
    assert monitors.predict(model, new).first().score == pytest.approx(
        1 / (1 + np.exp(-intercept)), abs=1e-9
    )


def test_hybrid_refuses_in_fold_scores(spark):
    primary = spark.createDataFrame(
        [("a", "q", "train", 0), ("b", "q2", "train", 1)],
        "example_id string, question_id string, split string, label int",
    )
    local = spark.createDataFrame(
        [(e, "train", c, 0.5, "full_train_model") for e in "ab"
         for c in ("surface", "counterfactual_answer_shift")],
        "example_id string, split string, component string, score double, score_origin string",
    )
    judge = spark.createDataFrame(
        [(e, w, 0.5) for e in "ab" for w in ("transcript_only", "context_aware")],
        "example_id string, view string, score double",
    )
    with pytest.raises(Exception, match="out of fold"):
        monitors.hybrid_scores(primary, local, judge)


def test_hybrid_without_an_answer_shift(spark):
    """An example whose shift has no value is not fitted on, or comes without a score."""
    splits = ["train"] * 8 + ["validation", "test"]
    names = [f"e{i}" for i in range(10)]
    none = {"e1", "e8"}
    shift, surface = "counterfactual_answer_shift", "surface"

    def fused(kept, stored=True):
        primary = spark.createDataFrame(
            [(e, f"q{e}", s, i % 2) for i, (e, s) in enumerate(zip(names, splits, strict=True)) if e in kept],
            "example_id string, question_id string, split string, label int",
        )
        local = [(e, surface, i / 10, "five_fold_question_oof") for i, e in enumerate(names)]
        local += [(e, shift, None if e in none else i % 3 / 2, "fixed_label_free") for i, e in enumerate(names)
                  if stored or e not in none]
        judge = [(e, v, i * k % 7 / 7) for i, e in enumerate(names) for k, v in ((2, "transcript_only"), (3, "context_aware"))]
        found = monitors.hybrid_scores(
            primary,
            spark.createDataFrame(local, "example_id string, component string, score double, score_origin string"),
            spark.createDataFrame(judge, "example_id string, view string, score double"),
        )
        return {r.example_id: r.score for r in found.collect()}

    got, without = fused(set(names)), fused(set(names) - none)
    assert got == {"e8": None, "e9": pytest.approx(without["e9"], abs=1e-12)}
    with pytest.raises(Exception, match="no counterfactual_answer_shift score"):
        fused(set(names), stored=False)


def test_judge_attempts(frame):
    df = frame(
        [("e", "v", 0, False, "length", None, None, None), ("e", "v", 1, True, "stop", None, 0.4, "ok"),
         ("e", "v", 2, True, "stop", "r2", 0.5, "ok"), ("f", "v", 0, True, "stop", "r", None, None)],
        "example_id string, view string, attempt int, termination_clean boolean, "
        "finish_reason string, provider_request_id string, p double, w string",
    ).select("*", F.struct(
        F.col("p").alias("probability"), F.col("w").alias("rationale"),
        F.when(F.col("p").isNull(), "not_json").alias("reject_reason")).alias("payload"))
    got = {r.example_id: r for r in monitors.judge_attempts(df).collect()}
    assert (got["e"].score, got["e"].attempts) == (0.5, 3)
    assert got["f"].error == "attempt 1: not_json"


def test_focal_rows_that_cannot_be_scored_come_back(frame):
    rows = [
        ("c1", "clean", "A", "clean_stop"), ("c2", "clean", "B", "clean_stop"),
        ("k1", "correct_continuation", "B", "clean_stop"), ("x1", "corrupted_continuation", "A", "clean_stop"),
        ("t1", "clean", "A", "length_truncated"), ("n1", "clean", None, "clean_stop"),
    ]
    schema = "rollout_id string, question_id string, condition string, parsed_answer string, status string"
    rollouts = frame([(i, "q", c, a, s) for i, c, a, s in rows], schema)
    got = {r.rollout_id: r for r in monitors.loo_answer_shift(rollouts, rollouts).collect()}
    assert len(got) == len(rows)
    reasons = {k: r.reject_reason for k, r in got.items()}
    assert reasons == {"c1": None, "c2": None, "k1": "cell_empty", "x1": "cell_empty", "t1": "not_scorable", "n1": "no_answer"}
    assert got["t1"].score is None and got["t1"].clean_frequency is None and got["c1"].clean_frequency == 0.0
    with pytest.raises(Exception, match="without an answer|did not stop cleanly|empty"):
        monitors.loo_answer_shift(rollouts, rollouts, strict=True).collect()
    with pytest.raises(ValueError, match="unique"):
        monitors.loo_answer_shift(rollouts.unionByName(rollouts), rollouts, strict=True)
