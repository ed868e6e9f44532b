"""Sources, sinks, streaming, joins, certificates and graph walks."""

import hashlib
import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shiftlens.functions.digests import canonical_digest, canonical_json, raw_json_digest
from shiftlens.operators import aggregates, gates, graph, interventions, joins, quality
from shiftlens.schema import QUESTION
from shiftlens.sources import tables
from shiftlens.streaming import collection


def question(i, **change):
    record = {
        "question_id": f"q{i}", "task_family": "f", "prompt": "p", "options": {"A": "1", "B": "2"},
        "gold_answer": "A",
    }
    return {**record, **change}


def test_scan_jsonl(spark, tmp_path):
    path = tmp_path / "questions.jsonl"
    lines = [
        json.dumps(question(1, prompt="a b"), ensure_ascii=False), "", "   ",
        json.dumps(question(2, gold_answer="Z")), "{broken",
        json.dumps(question(3, options={"A": "1"})),
    ]
    path.write_text("\n".join(lines), encoding="utf-8")
    rows = tables.scan_jsonl(spark, str(path), QUESTION, tables.QUESTION_RULES)
    valid, rejects = tables.split_rejects(rows)
    assert [r.prompt for r in valid.collect()] == ["a b"]
    assert sorted(r.reject_reason for r in rejects.collect()) == [
        "gold_not_an_option", "not_json", "too_few_options",
    ]
    assert all(r.source_file.endswith("questions.jsonl") for r in rejects.collect())
    with pytest.raises(Exception, match="invalid JSONL record"):
        tables.scan_jsonl(
            spark, str(path), QUESTION, tables.QUESTION_RULES, strict=True
        ).collect()


def test_scan_json_objects(spark, tmp_path):
    path = tmp_path / "objects.jsonl"
    path.write_text('{"a": 1}\n\n[1]\n3\n{oops\n', encoding="utf-8")
    rows = tables.scan_json_objects(spark, str(path))
    reasons = [r.reject_reason for r in rows.select("reject_reason").collect()]
    assert reasons == [None, "not_an_object", "not_an_object", "not_json"]


def test_write_once(spark, tmp_path):
    path = str(tmp_path / "out")
    tables.write_once(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="already exists"):
        tables.write_once(spark.range(3), path)


MCQ = (
    "id string, question string, choices struct<text: array<string>, label: array<string>>, "
    "answerKey string"
)


def test_mcq_parquet(spark, tmp_path):
    four = ["a ", " b", "c", "d"]
    rows = [
        ("Src_1", "What  is\nit?", (four, ["1", "2", "3", "4"]), "2"),
        ("Src_2", "x?", (four[:3], ["A", "B", "C"]), "A"),
        ("Src_3", "x?", (four, ["A", "B", "C", "D"]), "E"),
    ]
    path = str(tmp_path / "mcq")
    spark.createDataFrame(rows, MCQ).write.parquet(path)
    valid, rejects = tables.split_rejects(
        tables.scan_mcq_parquet(spark, path, source_split="test")
    )
    row = valid.first()
    assert (row.gold_answer, row.prompt, row.options["A"]) == ("B", "What is it?", "a")
    assert (row.template_group, rejects.count()) == ("Src", 2)


@pytest.mark.parametrize(
    "bad",
    [
        ("S_1", "x?", (["a", "b", "c", " "], ["A", "B", "C", "D"]), "A"),
        ("S_1", "x?", (["a", "b", "c", "d"], ["A", "A", "C", "D"]), "A"),
        ("S_1", " ", (["a", "b", "c", "d"], ["A", "B", "C", "D"]), "A"),
        ("_1", "x?", (["a", "b", "c", "d"], ["A", "B", "C", "D"]), "A"),
        ("S_1", "x?", (None, ["A", "B", "C", "D"]), "A"),
    ],
)
def test_malformed_mcq_fails(spark, bad):
    rows = spark.createDataFrame([bad], MCQ)
    with pytest.raises(Exception, match="malformed choices"):
        tables.normalize_mcq(rows, source_split="t", prefix="p").collect()


def test_hard_answerable(spark, tmp_path):
    rows = [("Level 5", r"\boxed{3}"), ("Level 3", r"\boxed{3}"), ("level4", "none"), ("4", "answer: 2")]
    df = spark.createDataFrame(rows, "level string, solution string")
    df.filter("level <> '4'").write.parquet(str(tmp_path / "a"))
    df.filter("level = '4'").write.parquet(str(tmp_path / "b"))
    got = tables.scan_math_parquet(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert sorted(r.gold_answer for r in got.collect()) == ["2", "3"]


def test_artifact_digests(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_bytes(name.encode() * 10)
    manifest = tables.artifact_digests(spark, str(tmp_path))
    got = {r.path[-1]: r.sha256 for r in manifest.collect()}
    assert got == {n: hashlib.sha256(n.encode() * 10).hexdigest() for n in ("a", "b")}
    first = tables.manifest_digest(manifest).first()
    assert first.bytes == 20
    assert tables.manifest_digest(manifest.repartition(3)).first() == first
    (tmp_path / "b").write_bytes(b"changed")
    moved = tables.artifact_digests(spark, str(tmp_path))
    assert tables.manifest_digest(moved).first() != first


def test_artifact_digests_of_large_files(spark, tmp_path):
    sizes = {"small": 3, "limit": 100, "above": 101, "odd %20, \u00fc": 5000, "huge": (2 << 30) + 1}
    want = {}
    for name, size in sizes.items():
        with open(tmp_path / name, "wb") as file:
            file.write(name.encode()[:size])
            file.truncate(size)  # a sparse file
        with open(tmp_path / name, "rb") as file:
            want[name] = (size, hashlib.file_digest(file, "sha256").hexdigest())

    def got():
        rows = tables.artifact_digests(spark, str(tmp_path)).collect()
        assert len(rows) == len(sizes)
        return {r.path.rsplit("/", 1)[-1]: (r.length, r.sha256) for r in rows}

    assert got() == want  # the file of over 2 GiB is streamed
    spark.conf.set("spark.shiftlens.bytesPerFile", "100")
    try:
        assert got() == want
    finally:
        spark.conf.unset("spark.shiftlens.bytesPerFile")


def test_canonical_digest(frame):
    df = frame([("a\"b", 3, None), ("é𝄞\x1f", 4, "x")], "s string, n int, z string")
    fields = {name: F.col(name) for name in ("z", "s", "n")}
    rows = df.select("s", "n", "z", canonical_digest(canonical_json(fields)).alias("d"),
                     raw_json_digest(F.lit('{"b": 1, "a": [1.5]}')).alias("r")).collect()
    for row in rows:
        body = json.dumps({"s": row.s, "n": row.n, "z": row.z}, sort_keys=True,
                          separators=(",", ":"))
        assert row.d == hashlib.sha256(body.encode()).hexdigest()
        assert row.r == hashlib.sha256(b'{"a":[1.5],"b":1}').hexdigest()


ROLL = "rollout_id string, question_id string, status string, latency_seconds double, created_at timestamp"


def test_stream_ingest_and_quality(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def drop(name, rows):
        body = "\n".join(
            json.dumps({"rollout_id": r, "question_id": "q", "status": s, "latency_seconds": 1.0,
                        "created_at": t}) for r, s, t in rows
        )
        (folder / name).write_text(body)

    drop("1.json", [("a", "clean_stop", "2024-01-01T00:10:00Z"),
                    ("b", "length_truncated", "2024-01-01T00:20:00Z"),
                    ("a", "clean_stop", "2024-01-01T00:10:00Z"),
                    ("z", "no_such_status", "2024-01-01T00:10:00Z")])

    def run():
        rows = collection.stream_rollouts(spark, str(folder), schema=ROLL)
        query = collection.write_stream(
            collection.stream_ingest(rows), out, str(tmp_path / "cp"), once=True
        )
        query.awaitTermination(120)

    run()
    drop("2.json", [("b", "length_truncated", "2024-01-01T00:20:00Z"),
                    ("c", "clean_stop", "2024-01-01T01:20:00Z")])
    run()
    stored = spark.read.schema(ROLL).parquet(out)
    assert sorted(r.rollout_id for r in stored.collect()) == ["a", "b", "c"]
    windows = collection.window_quality(stored, max_truncation=0.4).orderBy("window_start").collect()
    assert [(r.rollouts, r.truncated, r.alert) for r in windows] == [(2, 1, True), (1, 0, False)]


def test_streamed_windows_drop_late_rows(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def drop(name, rows):
        (folder / name).write_text("\n".join(
            json.dumps({"rollout_id": r, "question_id": "q", "status": "clean_stop",
                        "latency_seconds": 1.0, "created_at": t}) for r, t in rows))

    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        rows = collection.stream_rollouts(spark, str(folder), schema=ROLL)
        stream = collection.window_quality(rows, delay="1 hour")
        collection.write_stream(stream, out, cp, once=True).awaitTermination(120)

    drop("1.json", [("a", "2024-01-01T00:10:00Z"), ("b", "2024-01-01T05:00:00Z")])
    run()
    drop("2.json", [("late", "2024-01-01T00:20:00Z"), ("c", "2024-01-01T12:00:00Z")])
    run()
    drop("3.json", [("d", "2024-01-01T13:00:00Z")])
    run()
    rows = spark.read.parquet(out).orderBy("window_start").collect()
    assert [(r.window_start.hour, r.rollouts) for r in rows][:2] == [(0, 1), (5, 1)]


def test_lookup_join_with_hot_keys(spark, tiny_limits):
    facts = spark.range(300).select(
        F.col("id").cast("string").alias("row"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20).alias("k"),
    )
    dim = spark.range(15).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = joins.hot_keys(facts, ["k"])
    assert [r.k for r in hot.collect()] == [0]
    for how in ("left", "inner"):
        plain = joins.lookup_join(facts, dim, ["k"], how).select("row", "k", "v")
        salted = joins.lookup_join(facts, dim, ["k"], how, hot=hot, row_id="row")
        assert sorted(map(tuple, plain.collect()), key=str) == sorted(
            map(tuple, salted.select("row", "k", "v").collect()), key=str)


def test_enrich_reports_unknown_keys(spark):
    rollouts = spark.createDataFrame([("r1", "q1"), ("r2", "q9")], "rollout_id string, question_id string")
    questions = spark.createDataFrame([("q1", "f")], "question_id string, family string")
    got = {r.rollout_id: r.known_question for r in joins.enrich(rollouts, questions).collect()}
    assert got == {"r1": True, "r2": False}
    assert joins.unknown_keys(rollouts, questions).first().question_id == "q9"


def test_collection_plan_order(spark):
    df = spark.createDataFrame([("a1", "A"), ("a2", "A"), ("b1", "B")],
                               "question_id string, template_group string")
    plan = joins.collection_plan(df, ["clean"], samples=2, base_seed=100, model="m")
    rows = plan.orderBy("sample_index", "round", "template_group", "condition_index").collect()
    assert [r.question_id for r in rows] == ["a1", "b1", "a2", "a1", "b1", "a2"]
    assert [r.seed for r in rows][:3] == [100, 2100, 1100]


def test_pending_work(spark):
    plan = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "rollout_id string")
    done = spark.createDataFrame(
        [("a", "m", "r", "clean_stop"), ("b", "x", "r", "clean_stop"), ("c", "m", None, "clean_stop"),
         ("d", "m", "r", "length_truncated"), ("z", "m", "r", "clean_stop")],
        "rollout_id string, model string, provider_request_id string, status string")
    pending = joins.pending_work(plan, done, model="m")
    assert sorted(r.rollout_id for r in pending.collect()) == ["b", "c"]
    again = joins.pending_work(plan, done, model="m", retry_truncated=True)
    assert sorted(r.rollout_id for r in again.collect()) == ["b", "c", "d"]
    assert joins.outside_plan(plan, done).first().rollout_id == "z"


def certificate_frames(spark):
    problems = spark.createDataFrame(
        [("q1", "p1", "1", "2", "note"), ("q2", "p2", "3", "4", "note")],
        "question_id string, prompt string, gold_answer string, target_answer string, note string")
    payload = canonical_json({"gold": F.col("gold_answer"), "id": F.col("question_id")})
    certs = problems.select(
        "question_id", payload.alias("payload"), canonical_digest(payload).alias("digest"),
        F.sha2("prompt", 256).alias("prompt_sha256"), "gold_answer", "target_answer",
        F.col("note").alias("planted"), F.lit("s").alias("parent_sha256"))
    sources = problems.select("question_id", F.lit("s").alias("digest"))
    return problems, certs, sources


@pytest.mark.parametrize(
    ("column", "value", "rule"),
    [("digest", "0", "payload_digest"), ("prompt_sha256", "0", "prompt_digest"),
     ("gold_answer", "9", "gold_answer"), ("planted", "x", "field:note"),
     ("parent_sha256", "x", "parent_digest"), ("payload", '{"gold":"7"}', "payload_digest")],
)
def test_tampering_is_found(spark, column, value, rule):
    problems, certs, sources = certificate_frames(spark)
    check = lambda c: interventions.verify_digests(
        problems, c, sources=sources, fields={"note": "planted"})
    assert check(certs).count() == 0
    broken = certs.withColumn(
        column, F.when(F.col("question_id") == "q2", F.lit(value)).otherwise(F.col(column)))
    assert [tuple(r) for r in check(broken).collect()] == [("q2", rule)]


def test_target_must_be_wrong(spark):
    problems, certs, sources = certificate_frames(spark)
    same = problems.withColumn("target_answer", F.col("gold_answer"))
    bad = certs.withColumn("target_answer", F.col("gold_answer"))
    rules = {r.rule for r in interventions.verify_digests(same, bad, sources=sources).collect()}
    assert rules == {"target_is_wrong"}


def test_render_variants_rejects(spark):
    df = spark.createDataFrame(
        [("q1", "P", {"A": "x", "B": "y"}, "A", "A"), ("q2", "P", {"A": "x", "B": "y"}, "A", "C"),
         ("q3", "P", {"A": "x", "B": "y"}, "A", None)],
        "question_id string, prompt string, options map<string,string>, gold_answer string, "
        "hinted_option string")
    rows = interventions.render_variants(df, ["incorrect_answer_hint", "correct_continuation"])
    got = {(r.question_id, r.condition): r for r in rows.collect()}
    assert got["q1", "incorrect_answer_hint"].reject_reason == "hint_is_gold"
    assert got["q2", "incorrect_answer_hint"].reject_reason == "hint_not_an_option"
    assert got["q3", "incorrect_answer_hint"].hinted_option == "B"
    assert got["q3", "correct_continuation"].reject_reason == "unsupported_condition"
    text = got["q3", "incorrect_answer_hint"].rendered_prompt
    assert text.startswith("Metadata from an earlier system suggests the answer is B.\n\nP\n\nA. x")


def test_rebind_ids(spark):
    df = spark.createDataFrame([("old:1", "a")], "question_id string, gold_answer string")
    row = interventions.rebind_ids(df, "old:", "new:", ["question_id", "gold_answer"]).first()
    body = json.dumps({"gold_answer": "a", "question_id": "new:1"}, separators=(",", ":"))
    assert row.digest == hashlib.sha256(body.encode()).hexdigest()
    with pytest.raises(Exception, match="outside namespace"):
        interventions.rebind_ids(df, "x", "y", ["question_id"]).collect()


def test_prefills_flag_exposure(spark):
    df = spark.createDataFrame(
        [("q", "Use D_1=2. Continue to 3", "the provided 4")],
        "question_id string, correct_text string, corrupted_text string")
    for name in interventions.INTERVENTION_FIELDS:
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    row = interventions.assistant_prefills(df, version="v3").first()
    assert (row.correct_text, row.reject_reason) == ("I'll use D_1=2. ", "exposes_provenance")


def test_walks(spark):
    edges = spark.createDataFrame(
        [("a", "b"), ("a", "b"), ("b", "c"), ("b", "a"), ("c", "a")], "src string, dst string")
    got = {r.node: int(r.walks) for r in graph.path_counts(edges, "a", 3, checkpoint_every=2).collect()}
    assert got == {"a": 2, "b": 4}
    assert graph.path_counts(edges, "a", 0).first().node == "a"


def test_quality_rules(spark):
    rows = spark.createDataFrame(
        [("q1", "train", 0), ("q1", "test", 1), ("q2", "train", 1)],
        "question_id string, split string, binary_label int")
    assert quality.group_leakage(rows).first().question_id == "q1"
    assert {r.split for r in quality.missing_classes(rows).collect()} == {"validation", "test"}
    with pytest.raises(ValueError, match="leak"):
        quality.require_empty(quality.group_leakage(rows), "leak")
    full = {"A": "1", "B": "2", "C": "3", "D": "4"}
    bank = spark.createDataFrame(
        [("q1", "Same  text", full, "g"), ("q1", "same text", full, "g"), ("q3", "x", {"A": "1"}, None)],
        "question_id string, prompt string, options map<string,string>, template_group string")
    rules = {r.rule for r in quality.freeze_validation(bank).collect()}
    assert rules == {"duplicate_id", "duplicate_prompt", "option_set", "no_collection",
                     "fewer_than_two_collections"}
    assert quality.freeze_validation(bank.limit(0)).filter("rule = 'empty'").count() == 1


def test_matched_controls_run_short(spark):
    cases = spark.createDataFrame([(0, "c0", "f", 0, 0), (1, "c1", "f", 0, 0)],
                                  "case_index int, case_id string, family string, tier_rank int, renderer_id int")
    pool = spark.createDataFrame([("p", "f", 0, 0)],
                                 "control_id string, family string, tier_rank int, renderer_id int")
    with pytest.raises(Exception, match="no unused control"):
        joins.matched_controls(cases, pool, seed=1, pairs=2).collect()


def test_summary_and_reconstruction(spark):
    rows = spark.createDataFrame(
        [("a", None, None, 0, "x"), ("b", "use ", "use ", 3, "use it"), ("c", "use ", "use ", 3, "no"),
         ("d", "use ", None, 3, "use it"), ("e", None, "x", 0, "x")],
        "rollout_id string, expected_prefill string, assistant_prefill string, prefill_tokens int, "
        "reasoning string")
    bad = aggregates.reconstruction_check(rows)
    assert sorted(r.rollout_id for r in bad.collect()) == ["c", "d", "e"]


def test_smoke_gate(spark):
    summary = spark.createDataFrame(
        [(4, 0, 4, 0, 0, 0, 4, 4)],
        "completed long, invalid long, scorable long, truncated long, malformed long, "
        "parse_invalid long, reasoning_present long, unique_provider_request_ids long")
    good = gates.smoke_gate(summary, planned=4, min_scorable=4).first()
    assert (good.smoke_gate_passed, good.smoke_status) == (True, "complete")
    bad = gates.smoke_gate(summary, planned=5, min_scorable=4).first()
    assert bad.smoke_status == "quality_failed"
    errors = gates.smoke_gate(summary, planned=4, min_scorable=4, request_errors=1).first()
    assert errors.run_status == "complete_with_errors"


def test_python_steps_run_without_the_package_on_executors(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(
        "import sys\n"
        f"sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})\n"
        "from shiftlens.session import build_session\n"
        "from shiftlens.functions.digests import raw_json_digest\n"
        "from shiftlens.operators.metrics import exact_binomial_ci\n"
        "spark = build_session('t', 'local[1]', **{'spark.ui.enabled': 'false'})\n"
        "df = spark.createDataFrame([(1, 2, '{}')], 'k int, n int, j string')\n"
        "out = exact_binomial_ci(df, 'k', 'n').select('low', raw_json_digest(df.j))\n"
        "print('rows', out.count(), len(out.collect()))\n"
    )
    done = subprocess.run(
        [sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert "rows 1 1" in done.stdout, done.stderr[-2000:]
