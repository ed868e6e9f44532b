"""Matched controls by rounds, joins on keys of few values, resumption, deleted tables."""

import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shiftlens.functions.digests import config_digest
from shiftlens.operators import bootstrap, graph, joins
from shiftlens.plans import metric_queries, text_queries
from shiftlens.plans.views import Views
from shiftlens.session import checkpoint_folder, discard, materialize


def served_in_order(cases, pool, seed):
    """Give each case its nearest free control, one case after the other."""
    used, out = set(), []
    for i, case, family, tier, renderer in sorted(cases):
        free = [
            (abs(t - tier), int(r != renderer), hashlib.sha256(f"{seed + i}|{c}".encode()).hexdigest(), c)
            for c, f, t, r in pool if f == family and c not in used
        ]
        distance, mismatch, _, control = min(free)
        used.add(control)
        out.append((i, case, control, family, distance, mismatch))
    return out


@pytest.mark.parametrize("spare", [0, 5])
def test_rounds_end_where_serving_in_order_does(spark, spare, tiny_limits):
    draw = random.Random(spare)
    cases = [(i, f"c{i}", f"f{i % 2}", draw.randrange(3), draw.randrange(2)) for i in range(24)]
    pool = [(f"p{i}", f"f{i % 2}", draw.randrange(4), draw.randrange(3)) for i in range(24 + spare)]
    found = joins.matched_controls(
        spark.createDataFrame(cases, "case_index int, case_id string, family string, tier_rank int, renderer_id int"),
        spark.createDataFrame(pool, "control_id string, family string, tier_rank int, renderer_id int"),
        seed=3, pairs=24,
    )
    assert sorted(map(tuple, found.collect())) == served_in_order(cases, pool, 3)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_is_a_join(spark, tiny_limits, how):
    facts = spark.range(200).select((F.col("id") % 4).alias("k"), F.col("id").alias("row"))
    dim = spark.createDataFrame([(0, "a"), (1, "b"), (3, "d")], "k long, name string")
    joined = joins.spread_join(facts, dim, ["k"], how, salt="row")
    want = facts.join(dim, ["k"], how)
    assert sorted(map(tuple, joined.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_resume_needs_one_row_an_id_and_the_same_configuration(spark):
    one, two = config_digest({"a": 1, "b": [2]}), config_digest({"b": [2], "a": 1})
    assert one == two != config_digest({"a": 2, "b": [2]})
    plan = spark.createDataFrame([("x",), ("y",), ("z",), ("w",)], "rollout_id string")
    done = spark.createDataFrame(
        [("x", one), ("y", one), ("y", one), ("z", "other"), ("v", one), ("w", None)], "rollout_id string, config_sha256 string"
    ).select("*", F.lit("m").alias("model"), F.lit("r").alias("provider_request_id"), F.lit("clean_stop").alias("status"))
    problems = joins.resume_problems(plan, done, config_sha256=one).collect()
    assert sorted(map(tuple, problems)) == [
        ("v", "outside_plan"), ("w", "different_configuration"), ("y", "duplicate_id"), ("z", "different_configuration")
    ]
    left = joins.pending_work(plan, done, model="m", config_sha256=one).collect()
    assert sorted(r.rollout_id for r in left) == ["w", "z"]
    with pytest.raises(ValueError, match="cannot resume"):
        joins.pending_work(plan, done, model="m", config_sha256=one, strict=True)
    good = done.filter("rollout_id = 'x'")
    assert joins.pending_work(plan, good, model="m", config_sha256=one, strict=True).count() == 3


def test_discarded_tables_are_gone(spark):
    table = materialize(spark.range(5))
    path = Path(table.written_path.removeprefix("file:"))
    assert path.is_dir() and path.parent == Path(checkpoint_folder(spark).removeprefix("file:"))
    discard(table, spark.range(3))
    assert not path.exists()


def test_hub_walks(spark, tiny_limits):
    draw = random.Random(1)
    edges = [("hub", f"n{i}") for i in range(60)] + [(f"n{i}", "hub") for i in range(0, 60, 3)]
    edges += [(f"n{draw.randrange(60)}", f"n{draw.randrange(60)}") for _ in range(80)]
    walks = {"hub": 1}
    for _ in range(4):
        step = {}
        for a, b in edges:
            if a in walks:
                step[b] = step.get(b, 0) + walks[a]
        walks = step
    found = graph.path_counts(spark.createDataFrame(edges, "src string, dst string"), "hub", 4)
    assert {r.node: int(r.walks) for r in found.collect()} == walks


def test_draws_are_shuffled_to_their_clusters(spark, frame):
    """Draws are many times the clusters that their size is estimated from: never broadcast."""
    clusters = frame([(f"q{i}", i) for i in range(40)], "question_id string, hits long")
    sums = bootstrap.resampled_sums(clusters, [], "question_id", ["hits"], samples=50, seed=3)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan
    order = sorted(range(40), key=lambda i: hashlib.sha256(f"cluster|q{i}".encode()).hexdigest())
    expected = {
        r: sum(order[int(hashlib.sha256(f"3|{r}|{s}".encode()).hexdigest()[:15], 16) % 40] for s in range(40))
        for r in range(50)
    }
    assert {row["replicate"]: row["hits"] for row in sums.collect()} == expected


def test_replicate_lists_are_not_broadcast(spark, frame):
    """Nor are the clusters' lists of replicates, or the weights made from them."""
    rows = [("a", f"q{i}", i / 9, i % 2, 1 - i % 2) for i in range(30)]
    counts = frame(rows, "component string, question_id string, score double, pos long, neg long")
    drawn = bootstrap.replicate_counts(counts, ["component"], samples=20, seed=5)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert not any("_slot" in line for line in joins) and "SortMergeJoin" in plan
    total = drawn.groupBy("replicate").agg(F.sum(F.col("pos") + F.col("neg")).alias("n")).collect()
    assert len(total) == 20 and all(row["n"] == 30 for row in total)


def test_texts_are_attached_last(spark, tmp_path, tiny_limits):
    """No shuffle carries the texts of rollouts: documents go once to narrow rows."""
    events = [(i, i % 7, ("view", "click", "purchase")[i % 3], 5.0, f'{{"k": {i % 99}}}') for i in range(60)]
    rows = spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double, props string")
    rows.withColumn("ts", F.timestamp_seconds("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    docs = spark.range(4).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    views = Views(spark, str(tmp_path))
    for made in (text_queries._evidence(views), metric_queries._text_examples(views)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        top = plan[: plan.index("Join")]
        assert "Exchange" not in top and "doc_id" in plan[plan.index("Join") :].splitlines()[0]
    found = {r["rollout_id"]: r["reasoning"] for r in text_queries._evidence(views).collect()}
    primary = views.examples.filter("is_primary").select("example_id", "seed").collect()
    assert primary and found == {r["example_id"]: f"text {r['seed'] % 4}" for r in primary}


def test_merged_edges_are_dealt_by_their_number(spark, tiny_limits, monkeypatch):
    rows, write = [], graph.materialize

    def counted(df):
        rows.append(df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0])
        return write(df)

    monkeypatch.setattr(graph, "materialize", counted)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(4000)] + [("n0", "n1")]
    found = graph.path_counts(spark.createDataFrame(edges, "src string, dst string").coalesce(1), "n0", 3)
    assert [tuple(r) for r in found.collect()] == [("n3", 2)]
    assert rows[1] < 400  # the merged edges; a task had a thousand or more by the session's partitions
