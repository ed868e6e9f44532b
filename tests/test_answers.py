"""Answer extraction, normalisation, grading and text features."""

import hashlib
import time
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from shiftlens.functions import answers, text


def values(frame, inputs, function):
    df = frame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("x"))).collect()]


def test_normalize(frame):
    inputs = [
        r"\frac53", r"\frac{5}{3}", r"\dfrac{10}{-6}", "0.5", ".50", "1.", "+007", "-0", "4/0",
        r"\frac{1}{0}", r"\frac{a}{2}", r"\text{Yes  Sir}", "$ 3 / 6 $.", "x\ny", "", None,
        "9" * 40, "x" * 201, r"\mathrm{A}\,", "6/-3",
    ]
    expected = [
        "5/3", "5/3", "-5/3", "1/2", "1/2", "1", "7", "0", None, None, None, "yes sir", "1/2",
        "x", None, None, "9" * 40, None, "a", "6/-3",
    ]
    assert values(frame, inputs, answers.normalize_answer) == expected


def test_large_fractions(frame):
    inputs = ["12345678901234567890123/24691357802469135780246", "100000000000000000000/3"]
    assert values(frame, inputs, answers.normalize_answer) == [
        "1/2", "100000000000000000000/3",
    ]


def test_extract(frame):
    inputs = [
        r"\boxed{1} then \boxed{2}",
        r"so \boxed{\frac{5}{3}}",
        r"\[a_{8}=7194\]",
        r"\[x=2, y=3\]",
        r"\[x=2=2\]",
        r"outer \boxed{\text{\boxed{4}}}",
        r"unclosed \boxed{ 1 and \boxed{7}",
        "Answer: 3\nFinal answer: 3.0",
        r"\[1\] \[ 2.5 \]",
        "nothing",
        r"\boxed{1} answer: 2",
    ]
    expected = [None, "5/3", "7194", None, None, None, "7", "3", "5/2", None, "1"]
    assert values(frame, inputs, answers.extract_final_answer) == expected


def test_grade(frame):
    rows = [
        (".5", "1/2"), (r"\dfrac{5}{3}", "5/3"), ("(-15,0)", "(-15, 0)"), ("3", "4"),
        (r"\sin x", "0"), ("2*x + 2*y = 2", "x + y = 1"), (None, "1"), ("12", "12"),
    ]
    df = frame([(i, *r) for i, r in enumerate(rows)], "i int, p string, g string")
    found = df.orderBy("i").select(answers.grade(F.col("p"), F.col("g"))).collect()
    assert [r[0] for r in found] == [
        "correct", "correct", "correct", "incorrect", "review", "review", "review", "correct",
    ]


def test_near_wrong_number(frame):
    rows = [(str(g), f"q{g}") for g in (1, 2, 10, 30, 50, 99, 1000)]
    df = frame(rows, "g string, q string")
    got = {r[0]: r[1] for r in df.select(
        "g", answers.near_wrong_number(F.col("g"), F.col("q"))).collect()}
    for g, q in rows:
        gold, scale = int(g), max(1, round(int(g) * 0.05))
        odd = int(hashlib.sha256(q.encode()).hexdigest(), 16) % 2
        moved = gold + scale if odd else gold - scale
        assert got[g] == str(gold + scale if moved <= 0 else moved)


def test_surface_features(frame):
    body = "Maybe, perhaps not sure. However the button; but wait. Answer 5, 55, 5."
    df = frame([(body, "5")], "t string, a string")
    row = df.select(
        *[c.alias(n) for n, c in text.surface_features(F.col("t"), F.col("a")).items()]
    ).first()
    assert row.character_count == len(body)
    assert row.token_proxy_count == len(body.split())
    assert row.uncertainty_count == 3
    assert row.backtrack_count == 2
    assert row.contradiction_count == 2
    assert row.answer_mentions == 2


def test_judge_payload(frame):
    good = '{"causal_error_probability": 0.25, "rationale": "r"}'
    inputs = [
        good,
        f"```json\n{good}\n```",
        '{"causal_error_probability": 0.25}',
        '{"causal_error_probability": 0.25, "rationale": "r", "x": 1}',
        '{"causal_error_probability": 1.25, "rationale": "r"}',
        '{"causal_error_probability": 0.25, "rationale": ""}',
        '{"causal_error_probability": 0.25, "rationale": 7}',
        "[1]",
        "oops",
    ]
    got = values(frame, inputs, lambda c: text.parse_judge_payload(c)["reject_reason"])
    assert got == [
        None, None, "wrong_keys", "wrong_keys", "probability_range", "rationale_length",
        "rationale_type", "not_json", "not_json",
    ]


def test_token_audit(frame):
    df = frame(
        [(0, [1, 2, 3], [1, 9, 3]), (1, [1, 2, 3], [9, 2, 9]), (2, [1], [1, 2]), (3, [1], [1])],
        "i int, a array<int>, b array<int>",
    )
    rows = df.orderBy("i").select(
        text.token_pair_audit(F.col("a"), F.col("b")).alias("r")
    ).collect()
    assert [r.r.single_contiguous_changed_span for r in rows] == [True, False, False, False]
    assert rows[0].r.changed_token_start == 1


def test_naturalize(frame):
    got = values(
        frame,
        ["Use D_2=5, Use it. Continue to 9.", "The table is complete to the checkpoint 4"],
        text.naturalize_prefix,
    )
    assert got == ["I'll use D_2=5, I'll use it. ", "My table is complete to 4 "]


@pytest.mark.parametrize(
    ("reasoning", "expected"), [("r \n", "r\n\nbody"), ("", "  body"), (None, "  body")]
)
def test_transcript(frame, reasoning, expected):
    df = frame([(reasoning, "  body")], "r string, t string")
    assert df.select(text.assemble_transcript(F.col("r"), F.col("t"))).first()[0] == expected


def test_status(frame):
    df = frame(
        [(0, True, "stop", "a"), (1, True, "stop", None), (2, False, "length", "a"),
         (3, False, "error", None)],
        "i int, clean boolean, finish string, parsed string",
    )
    status = answers.rollout_status(F.col("clean"), F.col("finish"), F.col("parsed"))
    assert [r[0] for r in df.orderBy("i").select(status).collect()] == [
        "clean_stop", "parse_invalid", "length_truncated", "malformed",
    ]


def test_boxes_at_any_depth_and_long_fractions(frame):
    long = "1" * 34 + "/" + "7" * 33
    cases = [
        (r"\boxed{x}\boxed{{{{{y}}}}}", None),
        (r"\boxed{a{b{c{d{e}}}}}", "a{b{c{d{e}}}}"),
        (r"\boxed{" + "{" * 40 + "3" + "}" * 40 + "}", "{" * 40 + "3" + "}" * 40),
        (r"\boxed{1 \boxed{2", None),
        (r"\boxed{" + long + "}", long),
    ]
    rows = frame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.a for r in rows.select("i", answers.extract_final_answer(F.col("t")).alias("a")).collect()}
    assert [got[i] for i in range(5)] == [w for _, w in cases]


def test_grades_of_long_fractions_and_names(frame):
    a, b = "1" * 34 + "/" + "7" * 33, "1" * 34 + "/" + "7" * 34
    pairs = [(a, a, "correct"), (a, b, "incorrect"), ("b", "a", "incorrect"), ("1" * 50, "2" * 50, "incorrect"),
             ("x + 1", "a", "review"), (a, "1/2", "incorrect")]
    rows = frame([(i, p, g) for i, (p, g, _) in enumerate(pairs)], "i int, p string, g string")
    got = {r.i: r.v for r in rows.select("i", answers.grade(F.col("p"), F.col("g")).alias("v")).collect()}
    assert [got[i] for i in range(len(pairs))] == [w for *_, w in pairs]


def test_long_fractions_reduce_and_grade_exactly(frame):
    d = 10**39 + 7
    inputs = [
        f"{3 * d}/{5 * d}", f"\\frac{{{-3 * d}}}{{{5 * d}}}", f"0.{'5' * 40}", f"{d}/{d}", f"{d}/0", f"0/{d}",
        f"\\frac{{{d}}}{{{-7 * d}}}", "9" * 5000 + "/" + "3" * 5000,
    ]
    expected = ["3/5", "-3/5", str(Fraction(f"0.{'5' * 40}")), "1", None, "0", "-1/7", "3"]
    assert values(frame, inputs, answers.normalize_answer) == expected
    rows = [
        (f"{3 * d}/{5 * d}", f"{6 * d}/{10 * d}", "correct"), (f"{3 * d}/{5 * d}", "3/5", "correct"),
        (f"{3 * d}/{5 * d}", "0.6", "correct"), (f"-{3 * d}/{5 * d}", "3/5", "incorrect"),
        (f"{3 * d + 1}/{5 * d}", "3/5", "incorrect"), (f"{d}/{d}", "1", "correct"), (f"{d}/{d}", "x", "review"),
        (f"\\frac{{{-d}}}{{{-2 * d}}}", "1/2", "correct"), (f"0/{d}", "0", "correct"),
        ("7" * 700 + "/" + "1" * 700, "7", "correct"), ("7" * 700 + "/" + "1" * 699 + "2", "7", "incorrect"),
    ]
    df = frame([(i, *r) for i, r in enumerate(rows)], "i int, p string, g string, want string")
    found = df.orderBy("i").select(answers.grade(F.col("p"), F.col("g")).alias("got"), "want").collect()
    assert [r.got for r in found] == [r.want for r in found]
    same = f"\\boxed{{{3 * d}/{5 * d}}} so \\boxed{{0.6}}"
    assert values(frame, [same], answers.extract_final_answer) == ["3/5"]


def test_boxes_at_any_depth_and_number(frame):
    many = "".join("} \\boxed{%d} {" % i for i in range(10_000))
    nested = "\\boxed{" * 300 + "1" + "}" * 300
    inputs = ["a } \\boxed{x{y}z} {", "\\boxed{a\\boxed{b}} \\boxed{", many, nested, "none", None, "\\boxed{}", "{\\boxed{q}"]
    found = values(frame, inputs, answers.boxed_answers)
    assert found[:2] == [["x{y}z"], ["a\\boxed{b}", "b"]] and found[2] == [str(i) for i in range(10_000)]
    assert len(found[3]) == 300 and found[3][-1] == "1" and found[4:] == [[], [], [""], ["q"]]
    start = time.perf_counter()
    values(frame, ["\\boxed{1} " * 100_000], answers.extract_final_answer)
    assert time.perf_counter() - start < 60
