"""Queries over metrics, bootstraps and fitted monitors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlens.operators import bootstrap, gates, metrics, monitors, quality
from shiftlens.operators.joins import lookup_join
from shiftlens.operators.weights import weights_sql
from shiftlens.plans.fit_sql import logistic_fit, score
from shiftlens.plans.registry import ORACLES, query
from shiftlens.plans.report_queries import _SIBLING_SQL, CONTROL, TREATED, _tail_sql
from shiftlens.plans.text_queries import _PAYLOADS, judged
from shiftlens.plans.views import Views
from shiftlens.session import materialize

SAMPLES = 1000
METRIC_SAMPLES = 1000


def _curve_sql(source: str, by: str) -> str:
    """Return SQL for score counts with running sums, class totals and kept corners."""
    return f"""
SELECT *, coalesce(NOT (pos = next_pos AND neg = next_neg), TRUE) OR (tp = pos AND fp = neg)
  AS corner
FROM (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
    sum(pos) OVER (PARTITION BY {by}) AS p, sum(neg) OVER (PARTITION BY {by}) AS n,
    lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg
  FROM (SELECT {by}, score, count(*) FILTER (label = 1) AS pos,
      count(*) FILTER (label = 0) AS neg FROM {source} GROUP BY ALL)
  WINDOW w AS (PARTITION BY {by} ORDER BY score DESC))"""


def _metrics_sql(source: str, by: str, *, counts: bool = False) -> str:
    """Return SQL evaluating scores per group with the operating point at recall one half."""
    curve = _curve_sql(source, by) if not counts else f"""
SELECT *, coalesce(NOT (pos = next_pos AND neg = next_neg), TRUE) OR (tp = pos AND fp = neg)
  AS corner
FROM (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
    sum(pos) OVER (PARTITION BY {by}) AS p, sum(neg) OVER (PARTITION BY {by}) AS n,
    lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg FROM {source}
  WINDOW w AS (PARTITION BY {by} ORDER BY score DESC))"""
    return f"""
SELECT {by}, (p + n)::BIGINT AS n, p::BIGINT AS positives, p > 0 AND n > 0 AS available,
  CASE WHEN p > 0 AND n > 0 THEN area::DOUBLE / (2.0::DOUBLE * p * n) END AS auroc,
  CASE WHEN p > 0 AND n > 0 THEN steps / p END AS auprc,
  CASE WHEN p > 0 AND n > 0 THEN best.threshold END AS threshold,
  CASE WHEN p > 0 AND n > 0 THEN best.tpr END AS achieved_recall,
  CASE WHEN p > 0 AND n > 0 THEN best.fpr END AS false_positive_rate
FROM (SELECT {by}, max(p) AS p, max(n) AS n, sum(neg * (2 * tp - pos)) AS area,
    sum(pos * (tp / (tp + fp)::DOUBLE)) AS steps,
    arg_min({{'threshold': score, 'tpr': tp / p::DOUBLE, 'fpr': fp / n::DOUBLE}}, (fp, -score))
      FILTER (corner AND tp / p::DOUBLE >= 0.5) AS best
  FROM ({curve}) GROUP BY {by})"""


def _rounded(df: DataFrame, columns: tuple[str, ...] = ("auprc",)) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if c in columns else c for c in df.columns])


def _rounded_sql(sql: str, columns: tuple[str, ...] = ("auprc",)) -> str:
    inner = ", ".join(f"round({c}, 9) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({inner}) FROM ({sql})"


_CURVE = _curve_sql("scores", "component")


@query(
    "m1_roc_curve",
    f"""
SELECT component, score AS threshold, fp / n::DOUBLE AS fpr, tp / p::DOUBLE AS tpr
FROM ({_CURVE}) WHERE corner
UNION ALL SELECT DISTINCT component, 'inf'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM scores""",
)
def m1(v: Views) -> DataFrame:
    return metrics.roc_curve(v.scores, ["component"])


_ALL = _metrics_sql("scores", "component")


@query("m2_auroc", f"SELECT component, auroc FROM ({_ALL})")
def m2(v: Views) -> DataFrame:
    return metrics.auroc(v.scores, ["component"])


@query("m3_average_precision", f"SELECT component, round(auprc, 9) AS auprc FROM ({_ALL})")
def m3(v: Views) -> DataFrame:
    return _rounded(metrics.average_precision(v.scores, ["component"]))


@query(
    "m4_threshold_for_recall",
    f"SELECT component, threshold, achieved_recall, false_positive_rate FROM ({_ALL})",
)
def m4(v: Views) -> DataFrame:
    return metrics.threshold_for_recall(v.scores, 0.5, ["component"])


@query(
    "m5_precision_at_prevalence",
    f"""
SELECT component, prevalence, round(CASE
    WHEN achieved_recall * prevalence + false_positive_rate * (1 - prevalence) = 0
    THEN 'nan'::DOUBLE
  ELSE achieved_recall * prevalence
    / (achieved_recall * prevalence + false_positive_rate * (1 - prevalence)) END, 9) AS precision
FROM ({_ALL}), (VALUES (0.5::DOUBLE), (0.1::DOUBLE), (0.05::DOUBLE), (0.01::DOUBLE)) t(prevalence)""",
)
def m5(v: Views) -> DataFrame:
    out = metrics.precision_at_prevalence(metrics.evaluate_scores(v.scores, ["component"]))
    return out.select("component", "prevalence", F.round("precision", 9).alias("precision"))


@query("m6_evaluate_scores", _rounded_sql(_ALL))
def m6(v: Views) -> DataFrame:
    return _rounded(metrics.evaluate_scores(v.scores, ["component"]))


_STRATA = _metrics_sql(
    "(SELECT component, family, mechanism, score, CASE WHEN family = 'f3' THEN 0 ELSE label END "
    "AS label FROM scores)",
    "component, family, mechanism",
)


@query(
    "m7_evaluate_by_stratum",
    f"""
SELECT *, CASE WHEN NOT available THEN 'single_class' END AS reason
FROM ({_rounded_sql(_STRATA)})""",
)
def m7(v: Views) -> DataFrame:
    rows = v.scores.withColumn(
        "label", F.when(F.col("family") == "f3", 0).otherwise(F.col("label"))
    )
    return _rounded(metrics.evaluate_by_stratum(rows, ["component", "family", "mechanism"]))


_VALIDATION = _metrics_sql(
    "(SELECT component, score, label FROM scores WHERE split = 'validation')", "component"
)


@query(
    "m8_validation_operating_point",
    f"""
SELECT t.component, t.threshold, t.achieved_recall AS validation_recall,
  t.false_positive_rate AS validation_false_positive_rate,
  count(*) FILTER (label = 1 AND score >= t.threshold) / count(*) FILTER (label = 1)::DOUBLE
    AS test_recall,
  count(*) FILTER (label = 0 AND score >= t.threshold) / count(*) FILTER (label = 0)::DOUBLE
    AS test_false_positive_rate
FROM ({_VALIDATION}) t JOIN scores s ON s.component = t.component AND s.split = 'test'
GROUP BY ALL""",
)
def m8(v: Views) -> DataFrame:
    return metrics.validation_operating_point(v.scores)


@query(
    "m9_score_decomposition",
    f"""
SELECT * FROM ({_rounded_sql(_ALL)})
WHERE component IN ('corrupted_recurrence_only', 'control_suppression_only')""",
)
def m9(v: Views) -> DataFrame:
    parts = v.scores.filter("component <> 'counterfactual_answer_shift'")
    return _rounded(metrics.evaluate_scores(parts, ["component"]))


_SIBLING_METRICS = _metrics_sql(
    "(SELECT 'all' AS siblings, s.score, e.binary_label AS label FROM shifts s JOIN examples e "
    f"USING (rollout_id) UNION ALL SELECT 'one', s.score, e.binary_label FROM "
    f"({_SIBLING_SQL.format(k=1)}) s JOIN examples e USING (rollout_id) UNION ALL "
    f"SELECT 'two', s.score, e.binary_label FROM ({_SIBLING_SQL.format(k=2)}) s "
    "JOIN examples e USING (rollout_id))",
    "siblings",
)


@query(
    "m10_sibling_sensitivity",
    f"""
WITH m AS ({_SIBLING_METRICS})
SELECT siblings, auroc, auroc >= 0.90::DOUBLE * f AND f - auroc <= 0.05::DOUBLE AS qualifies,
  siblings = CASE WHEN (SELECT auroc >= 0.90::DOUBLE * f AND f - auroc <= 0.05::DOUBLE FROM m
      WHERE siblings = 'one') THEN 'one'
    WHEN (SELECT auroc >= 0.90::DOUBLE * f AND f - auroc <= 0.05::DOUBLE FROM m
      WHERE siblings = 'two') THEN 'two' ELSE 'none' END AS cheapest
FROM m, (SELECT auroc AS f FROM m WHERE siblings = 'all')""",
)
def m10(v: Views) -> DataFrame:
    return monitors.sibling_sensitivity(
        v.examples.filter("is_primary"), v.rollouts, label="binary_label"
    )


_SWAPPED = """
(SELECT f.rollout_id, f.binary_label AS label, 'placebo' AS component,
    (count(*) FILTER (s.condition = 'correct_continuation' AND hit) / count(*) FILTER
      (s.condition = 'correct_continuation')::DOUBLE
    - greatest(count(*) FILTER (s.condition = 'clean' AND hit) / count(*) FILTER
      (s.condition = 'clean')::DOUBLE,
      count(*) FILTER (s.condition = 'corrupted_continuation' AND hit) / count(*) FILTER
      (s.condition = 'corrupted_continuation')::DOUBLE) + 1.0::DOUBLE) / 2.0::DOUBLE AS score
  FROM (SELECT * FROM examples WHERE is_primary) f JOIN (SELECT *, FALSE AS unused FROM siblings) s
    ON s.question_id = f.question_id AND s.rollout_id <> f.rollout_id,
  LATERAL (SELECT s.parsed_answer = f.parsed_answer AS hit) GROUP BY ALL)"""


@query("m11_placebo_eval", _rounded_sql(_metrics_sql(_SWAPPED, "component")))
def m11(v: Views) -> DataFrame:
    out = monitors.placebo_eval(
        v.examples.filter("is_primary"), v.rollouts, label="binary_label"
    )
    return _rounded(out)


def _draws(groups: str, samples: int, seed: str) -> str:
    """Return CTEs ``clusters_n`` and ``draws_n`` over a table of groups."""
    return f"""
clusters_n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY sha256('cluster|' || question_id)) - 1
    AS slot, count(*) OVER () AS g FROM {groups}),
draws_n AS (SELECT r.r AS replicate, ('0x' || substr(sha256('{seed}|' || r.r || '|' || slot), 1, 15))
    ::BIGINT % g AS slot FROM clusters_n, range({samples}) r(r))"""


_EFFECT_GROUPS = f"""(SELECT question_id,
    count(*) FILTER (condition = '{TREATED}' AND hit_target) AS t_hits,
    count(hit_target) FILTER (condition = '{TREATED}') AS t_rows,
    count(*) FILTER (condition = '{CONTROL}' AND hit_target) AS c_hits,
    count(hit_target) FILTER (condition = '{CONTROL}') AS c_rows FROM graded GROUP BY ALL)"""


@query(
    "b1_cluster_bootstrap_effect",
    f"""
WITH {_draws(_EFFECT_GROUPS, SAMPLES, "17")},
vals AS (SELECT list_sort(list(e)) AS l FROM (SELECT replicate,
  sum(t_hits) / sum(t_rows)::DOUBLE - sum(c_hits) / sum(c_rows)::DOUBLE AS e
  FROM draws_n JOIN clusters_n USING (slot) GROUP BY replicate))
SELECT len(l) AS successful_samples, l[floor(0.025::DOUBLE * (len(l) - 1))::INT + 1] AS low,
  l[floor(0.975::DOUBLE * (len(l) - 1))::INT + 1] AS high FROM vals""",
)
def b1(v: Views) -> DataFrame:
    return bootstrap.cluster_bootstrap_effect(
        v.graded, TREATED, CONTROL, samples=SAMPLES, seed=17
    )


_ACCURACY_GROUPS = """(SELECT question_id, count(*) FILTER (grade = 'correct') AS hits,
    count(grade) AS rows FROM graded WHERE condition = 'clean' AND grade IS NOT NULL GROUP BY ALL)"""


@query(
    "b2_cluster_bootstrap_accuracy",
    f"""
WITH {_draws(_ACCURACY_GROUPS, SAMPLES, "18")},
vals AS (SELECT list_sort(list(e)) AS l FROM (SELECT replicate,
  sum(hits) / sum(rows)::DOUBLE AS e FROM draws_n JOIN clusters_n USING (slot) GROUP BY replicate))
SELECT len(l) AS successful_samples, l[floor(0.025::DOUBLE * (len(l) - 1))::INT + 1] AS low,
  l[floor(0.975::DOUBLE * (len(l) - 1))::INT + 1] AS high FROM vals""",
)
def b2(v: Views) -> DataFrame:
    clean = v.graded.filter("condition = 'clean'")
    return bootstrap.cluster_bootstrap_accuracy(clean, samples=SAMPLES, seed=18)


_TEST = "(SELECT * FROM scores WHERE split = 'test')"
_TEST_GROUPS = "(SELECT DISTINCT question_id FROM scores WHERE split = 'test')"


def _weighted_sql(seed: str) -> str:
    """Return SQL for the metrics of replicates whose weights are drawn by cluster."""
    merged = f"""(SELECT s.component, d.replicate, s.score, sum(s.label * d.w)::BIGINT AS pos,
    sum((1 - s.label) * d.w)::BIGINT AS neg
  FROM weights_n d JOIN {_TEST} s USING (question_id) WHERE d.w > 0 GROUP BY ALL)"""
    return f"""weights_n AS MATERIALIZED ({weights_sql(_TEST_GROUPS, "question_id", METRIC_SAMPLES, seed)}),
{_long_sql(merged)}"""


def _long_sql(merged: str) -> str:
    return f"""reps_n AS (SELECT * FROM ({_metrics_sql(merged, "component, replicate", counts=True)})
  WHERE available),
long_n AS (SELECT component, replicate, unnest(['auroc', 'auprc', 'false_positive_rate']) AS metric,
  unnest([auroc, auprc, false_positive_rate]) AS value FROM reps_n)"""


def _drawn_sql(seed: str) -> str:
    """Return SQL for the metrics of replicates that draw whole clusters."""
    merged = f"""(SELECT s.component, d.replicate, s.score, sum(s.label)::BIGINT AS pos,
    sum(1 - s.label)::BIGINT AS neg
  FROM draws_n d JOIN clusters_n c USING (slot) JOIN {_TEST} s USING (question_id)
  GROUP BY ALL)"""
    return f"{_draws(_TEST_GROUPS, METRIC_SAMPLES, seed)},\n{_long_sql(merged)}"


_METRIC_EDGES = f"""
vals AS (SELECT component, metric, list_sort(list(value)) AS l FROM long_n GROUP BY ALL)
SELECT component, metric, len(l) AS successful_samples,
  round(l[floor(0.025::DOUBLE * (len(l) - 1))::INT + 1], 9) AS low,
  round(l[floor(0.975::DOUBLE * (len(l) - 1))::INT + 1], 9) AS high,
  {METRIC_SAMPLES}::BIGINT AS requested_samples FROM vals"""


@query("b3_cluster_bootstrap_metrics", f"WITH {_weighted_sql('19')}, {_METRIC_EDGES}")
def b3(v: Views) -> DataFrame:
    out = bootstrap.cluster_bootstrap_metrics(
        v.scores.filter("split = 'test'"), samples=METRIC_SAMPLES, seed=19
    )
    return _rounded(out, ("low", "high"))


@query("b3_exact_draws", f"WITH {_drawn_sql('19')}, {_METRIC_EDGES}")
def b3_exact(v: Views) -> DataFrame:
    out = bootstrap.cluster_bootstrap_metrics(
        v.scores.filter("split = 'test'"), samples=METRIC_SAMPLES, seed=19, method="draws"
    )
    return _rounded(out, ("low", "high"))


_PAIR = ("counterfactual_answer_shift", "control_suppression_only")


@query(
    "b4_paired_bootstrap_difference",
    f"""
WITH {_weighted_sql("20")},
diffs AS (SELECT a.metric, a.value - b.value AS value FROM long_n a JOIN long_n b
  ON a.replicate = b.replicate AND a.metric = b.metric
  WHERE a.component = '{_PAIR[0]}' AND b.component = '{_PAIR[1]}'),
point_n AS (SELECT unnest(['auroc', 'auprc', 'false_positive_rate']) AS metric, component,
  unnest([auroc, auprc, false_positive_rate]) AS value
  FROM ({_metrics_sql(_TEST, "component")}))
SELECT d.metric, round((SELECT max(value) FROM point_n p WHERE p.metric = d.metric
    AND component = '{_PAIR[0]}') - (SELECT max(value) FROM point_n p WHERE p.metric = d.metric
    AND component = '{_PAIR[1]}'), 9) AS point, count(*) AS successful_samples,
  round(quantile_cont(value, 0.025), 9) AS low, round(quantile_cont(value, 0.975), 9) AS high
FROM diffs d GROUP BY d.metric""",
)
def b4(v: Views) -> DataFrame:
    out = bootstrap.paired_bootstrap_difference(
        v.scores.filter("split = 'test'"), *_PAIR, samples=METRIC_SAMPLES, seed=20
    )
    return _rounded(out, ("point", "low", "high"))


@query(
    "b5_interval",
    """
WITH g AS (SELECT o_orderpriority AS g, list_sort(list(o_totalprice)) AS l,
    quantile_cont(o_totalprice, 0.025) AS a, quantile_cont(o_totalprice, 0.975) AS b
  FROM orders GROUP BY ALL)
SELECT g, 'order' AS method, len(l) AS successful_samples,
  round(l[floor(0.025::DOUBLE * (len(l) - 1))::INT + 1], 6) AS low,
  round(l[floor(0.975::DOUBLE * (len(l) - 1))::INT + 1], 6) AS high FROM g
UNION ALL SELECT g, 'linear', len(l), round(a, 6), round(b, 6) FROM g""",
)
def b5(v: Views) -> DataFrame:
    rows = v.table("orders").select(F.col("o_orderpriority").alias("g"), "o_totalprice")
    parts = [
        bootstrap.interval(rows, "o_totalprice", ["g"], method=m).select(
            "g", F.lit(m).alias("method"), "successful_samples",
            F.round("low", 6).alias("low"), F.round("high", 6).alias("high"),
        )
        for m in ("order", "linear")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "b6_cluster_bootstrap_effect_by",
    f"""
WITH c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY mechanism
      ORDER BY sha256('cluster|' || question_id)) - 1 AS slot,
    count(*) OVER (PARTITION BY mechanism) AS g
  FROM (SELECT question_id, 'm' || (substr(question_id, 2)::BIGINT // 64) % 2 AS mechanism,
    t_hits, t_rows, c_hits, c_rows FROM {_EFFECT_GROUPS})),
d AS (SELECT mechanism, r.r AS replicate, ('0x' || substr(sha256((21 + length(mechanism)) || '|'
    || r.r || '|' || slot), 1, 15))::BIGINT % g AS slot FROM c, range({SAMPLES}) r(r)),
vals AS (SELECT mechanism, list_sort(list(e)) AS l FROM (SELECT mechanism, replicate,
  sum(t_hits) / sum(t_rows)::DOUBLE - sum(c_hits) / sum(c_rows)::DOUBLE AS e
  FROM d JOIN c USING (mechanism, slot) GROUP BY ALL) GROUP BY mechanism)
SELECT mechanism, len(l) AS successful_samples,
  l[floor(0.025::DOUBLE * (len(l) - 1))::INT + 1] AS low,
  l[floor(0.975::DOUBLE * (len(l) - 1))::INT + 1] AS high FROM vals""",
)
def b6(v: Views) -> DataFrame:
    return bootstrap.cluster_bootstrap_effect(
        v.graded, TREATED, CONTROL, samples=SAMPLES, seed=21, by=["mechanism"],
        seed_from="mechanism",
    )


# ---- fitted monitors ---------------------------------------------------------------------
# Both sides fit to the optimum by themselves; scores are compared to four digits.

_FEATURED = """
featured AS MATERIALIZED (SELECT l.example_id, l.question_id, l.family, l.split, l.label,
  [character_count, token_proxy_count, uncertainty_count, backtrack_count, contradiction_count,
    answer_mentions]::DOUBLE[] AS f
  FROM labelled_text l JOIN (""" + ORACLES["p18_surface_features"] + """) s ON l.example_id = s.doc_id::VARCHAR)"""
_TRAIN = "SELECT 'all' AS g, label AS y, f FROM featured WHERE split = 'train'"


def _scores_sql(width: int, train: str, features: str = "f", rows: str = "featured", before: str = _FEATURED) -> str:
    """Return SQL that fits one model and scores all rows."""
    return f"""
WITH RECURSIVE {before},
{logistic_fit(train, width)}
SELECT example_id, split, label, round({score(features)}, 4) AS score FROM {rows}, fit_n"""


def _featured(v: Views) -> DataFrame:
    return monitors.surface_table(v.labelled_text)


def _shown(scored: DataFrame, *columns: str) -> DataFrame:
    return scored.select(*columns, F.round("score", 4).alias("score"))


def _fit_and_score(rows: DataFrame, fit) -> DataFrame:
    model = fit(rows.filter("split = 'train'"))
    return _shown(monitors.predict(model, rows), "example_id", "split", "label")


@query("l1_surface_monitor", _scores_sql(6, _TRAIN))
def l1(v: Views) -> DataFrame:
    return _fit_and_score(_featured(v), monitors.surface_monitor)


@query("l2_length_monitor", _scores_sql(1, _TRAIN.replace(" f FROM", " f[1:1] AS f FROM"), "f[1:1]"))
def l2(v: Views) -> DataFrame:
    return _fit_and_score(_featured(v), monitors.length_monitor)


_TEMPLATES = """
cells AS (SELECT * FROM (SELECT DISTINCT 'family' AS kind, family AS name FROM labelled_text WHERE split = 'train'
  UNION SELECT DISTINCT 'tier', (example_id::BIGINT % 3)::VARCHAR FROM labelled_text WHERE split = 'train'
  UNION SELECT DISTINCT 'renderer', (example_id::BIGINT % 2)::VARCHAR FROM labelled_text WHERE split = 'train')),
known AS (SELECT list(kind || ':' || name ORDER BY kind, name) AS names,
  list_transform(range(12 - count(*)::INT), lambda i: 0.0::DOUBLE) AS fill FROM cells),
templated AS MATERIALIZED (SELECT example_id, split, label, list_concat(list_transform(names, lambda c:
  CASE WHEN c IN ('family:' || family, 'tier:' || example_id::BIGINT % 3, 'renderer:' || example_id::BIGINT % 2)
    THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), fill) AS f FROM labelled_text, known)"""


@query(
    "l3_template_monitor",
    _scores_sql(12, "SELECT 'all' AS g, label AS y, f FROM templated WHERE split = 'train'", rows="templated",
                before=_TEMPLATES),
)
def l3(v: Views) -> DataFrame:
    return _fit_and_score(v.labelled_text, monitors.template_monitor)


_PERMUTED = _FEATURED + """,
slots AS (SELECT example_id, row_number() OVER (ORDER BY sha256('4|rows|' || example_id)) AS i
  FROM featured WHERE split = 'train'),
dealt AS (SELECT label, row_number() OVER (ORDER BY sha256('4|labels|' || example_id)) AS i
  FROM featured WHERE split = 'train')"""


@query(
    "l4_shuffled_label_monitor",
    _scores_sql(6, "SELECT 'all' AS g, d.label AS y, f FROM featured JOIN slots USING (example_id) JOIN dealt d USING (i)",
                before=_PERMUTED),
)
def l4(v: Views) -> DataFrame:
    rows = _featured(v)
    train = rows.filter("split = 'train'")
    permuted = monitors.permute_labels(train, "label", 4)
    shuffled = train.join(permuted, "example_id").withColumn("label", F.col("permuted_label"))
    model = monitors.surface_monitor(shuffled)
    return _shown(monitors.predict(model, rows), "example_id", "split", "label")


# Groups of one class mix are dealt back and forth, the mixes in order.
_FOLDS = _FEATURED + """,
mixes AS (SELECT question_id, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n
  FROM featured WHERE split = 'train' GROUP BY ALL),
places AS (SELECT question_id, row_number() OVER (ORDER BY p, n, sha256('5|' || question_id), question_id) - 1 AS i FROM mixes),
folded AS MATERIALIZED (SELECT f.*, CASE WHEN i // 5 % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END AS fold
  FROM featured f JOIN places USING (question_id) WHERE split = 'train')"""


@query(
    "l5_oof_scores",
    f"""
WITH RECURSIVE {_FOLDS},
{logistic_fit("SELECT t AS g, label AS y, f FROM folded, range(5) r(t) WHERE fold <> t", 6)}
SELECT example_id, fold::INT AS fold, label, round({score("f")}, 4) AS score FROM folded JOIN fit_n ON g = fold""",
)
def l5(v: Views) -> DataFrame:
    train = _featured(v).filter("split = 'train'")
    return _shown(monitors.oof_scores(train, seed=5), "example_id", "fold", "label")


@query(
    "l6_correctness_only",
    """
SELECT example_id, 'correctness_only' AS component, 1.0::DOUBLE AS score FROM examples""",
)
def l6(v: Views) -> DataFrame:
    return v.examples.select(
        "example_id", F.lit("correctness_only").alias("component"), F.lit(1.0).alias("score")
    )


def _text_examples(v: Views) -> DataFrame:
    """Return examples with their texts; what they are made of is joined once, before the texts."""
    keys = v.examples.select(
        F.col("example_id").alias("rollout_id"), "example_id", "split", "is_primary",
        F.col("binary_label").alias("label"),
    )
    rows = v.rollouts.select(
        "rollout_id", "question_id", "condition", "parsed_answer", "seed", "family", "tier",
        "renderer_id", "k",
    )
    return v.with_texts(materialize(lookup_join(rows, keys, ["rollout_id"])))


def _local(v: Views, rows: DataFrame) -> DataFrame:
    return monitors.local_component_scores(
        rows.filter("is_primary"), rows.filter("NOT is_primary"), v.rollouts, seed=7
    )


_SURFACE = ORACLES["p18_surface_features"]
_OWN_ANSWER = _SURFACE.replace("SELECT doc_id, ", "SELECT example_id, ").replace("w = 'the'", "w = answer").replace(
    "FROM documents", "FROM own"
)
# All examples with their features; primary ones of the training split fit the monitors.
_LOCAL = f"""
own AS MATERIALIZED (SELECT e.example_id, e.question_id, e.split, e.is_primary, e.binary_label AS label, e.family,
    e.tier, e.renderer_id, e.parsed_answer AS answer, e.k, t.response AS text
  FROM examples e JOIN rollout_texts t USING (rollout_id)),
rows_l AS MATERIALIZED (SELECT o.* EXCLUDE (text), is_primary AND split = 'train' AS training,
  [character_count, token_proxy_count, uncertainty_count, backtrack_count, contradiction_count, answer_mentions]::DOUBLE[] AS f
  FROM own o JOIN ({_OWN_ANSWER}) s USING (example_id)),
slots_l AS (SELECT example_id, row_number() OVER (ORDER BY sha256('8|rows|' || example_id)) AS i FROM rows_l WHERE training),
dealt_l AS (SELECT label, row_number() OVER (ORDER BY sha256('8|labels|' || example_id)) AS i FROM rows_l WHERE training),
mixes_l AS (SELECT question_id, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM rows_l
  WHERE training GROUP BY ALL),
places_l AS (SELECT question_id, row_number() OVER (ORDER BY p, n, sha256('7|' || question_id), question_id) - 1 AS i FROM mixes_l),
folded_l AS MATERIALIZED (SELECT r.*, CASE WHEN i // 5 % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END AS fold
  FROM rows_l r JOIN places_l USING (question_id) WHERE training),
names_l AS (SELECT list(name ORDER BY name) AS names, list_transform(range(16 - count(*)::INT), lambda i: 0.0::DOUBLE) AS fill
  FROM (SELECT DISTINCT unnest(['f:' || family, 't:' || tier, 'r:' || renderer_id]) AS name FROM rows_l WHERE training)),
templated_l AS MATERIALIZED (SELECT example_id, training, label, list_concat(list_transform(names, lambda c:
  CASE WHEN c IN ('f:' || family, 't:' || tier, 'r:' || renderer_id) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), fill) AS f
  FROM rows_l, names_l),
{logistic_fit("SELECT 'all' AS g, label AS y, f FROM rows_l WHERE training", 6, "surf", 25)},
{logistic_fit("SELECT 'all' AS g, label AS y, f[1:1] AS f FROM rows_l WHERE training", 1, "len", 25)},
{logistic_fit("SELECT 'all' AS g, label AS y, f FROM templated_l WHERE training", 16, "temp", 25)},
{logistic_fit("SELECT 'all' AS g, d.label AS y, f FROM rows_l JOIN slots_l USING (example_id) JOIN dealt_l d USING (i)", 6, "perm", 25)},
{logistic_fit("SELECT t AS g, label AS y, f FROM folded_l, range(5) r(t) WHERE fold <> t", 6, "oof", 25)},
surface_l AS MATERIALIZED (SELECT example_id, {score("f")} AS score, 'five_fold_question_oof' AS score_origin
    FROM folded_l JOIN oof_n ON g = fold
  UNION ALL SELECT example_id, {score("f")}, 'full_train_model' FROM rows_l, surf_n WHERE NOT training),
shift_l AS MATERIALIZED (SELECT f.example_id, (count(*) FILTER (s.condition = 'corrupted_continuation' AND hit)
      / count(*) FILTER (s.condition = 'corrupted_continuation')::DOUBLE
    - greatest(count(*) FILTER (s.condition = 'clean' AND hit) / count(*) FILTER (s.condition = 'clean')::DOUBLE,
      count(*) FILTER (s.condition = 'correct_continuation' AND hit)
        / count(*) FILTER (s.condition = 'correct_continuation')::DOUBLE) + 1.0::DOUBLE) / 2.0::DOUBLE AS score
  FROM examples f JOIN siblings s ON s.question_id = f.question_id AND s.rollout_id <> f.rollout_id,
    LATERAL (SELECT s.parsed_answer = f.parsed_answer AS hit) GROUP BY ALL)"""


@query(
    "l7_local_component_scores",
    f"""
WITH RECURSIVE {_LOCAL}
SELECT example_id, question_id, split, component, round(score, 4) AS score, score_origin FROM rows_l JOIN (
  SELECT example_id, 'correctness_only' AS component, 1.0::DOUBLE AS score,
    'constant_known_incorrect_control' AS score_origin FROM rows_l
  UNION ALL SELECT example_id, 'reasoning_length', {score("f[1:1]")}, 'full_train_model' FROM rows_l, len_n
  UNION ALL SELECT example_id, 'template_identity', {score("f")}, 'full_train_model' FROM templated_l, temp_n
  UNION ALL SELECT example_id, 'shuffled_label_surface', {score("f")}, 'full_train_model' FROM rows_l, perm_n
  UNION ALL SELECT example_id, 'counterfactual_answer_shift', score, 'fixed_label_free' FROM shift_l
  UNION ALL SELECT example_id, 'surface', score, score_origin FROM surface_l) USING (example_id)""",
)
def l7(v: Views) -> DataFrame:
    return _local(v, _text_examples(v)).withColumn("score", F.round("score", 4))


@query(
    "l8_hybrid_scores",
    f"""
WITH RECURSIVE {_LOCAL},
fused AS MATERIALIZED (SELECT r.example_id, question_id, split, label,
    [u.score, k / 99.0::DOUBLE, (99 - k) / 99.0::DOUBLE, h.score]::DOUBLE[] AS f
  FROM rows_l r JOIN surface_l u USING (example_id) JOIN shift_l h USING (example_id) WHERE is_primary),
{logistic_fit("SELECT 'all' AS g, label AS y, f FROM fused WHERE split = 'train'", 4, "fuse", 25)}
SELECT example_id, question_id, split, 'hybrid' AS component, round({score("f")}, 4) AS score,
  'five_fold_oof_component_fusion' AS score_origin
FROM fused, fuse_n WHERE split IN ('validation', 'test')""",
)
def l8(v: Views) -> DataFrame:
    rows = _text_examples(v)
    # Read three times below, and never for its texts.
    primary = materialize(
        rows.filter("is_primary").select("example_id", "question_id", "split", "label", "k")
    )
    view = F.explode(F.array(F.lit("transcript_only"), F.lit("context_aware"))).alias("view")
    # Stored judge scores: the conversation table has none for these examples, so the
    # judge's probability is taken from the example's own integer property.
    judge = primary.select("example_id", "k", view).select(
        "example_id", "view",
        (F.when(F.col("view") == "context_aware", 99 - F.col("k")).otherwise(F.col("k")) / 99.0)
        .alias("score"),
    )
    return monitors.hybrid_scores(primary, _local(v, rows), judge).withColumn("score", F.round("score", 4))


_EMBEDDED = """
base AS (SELECT vec_id::VARCHAR AS example_id, embedding::DOUBLE[] AS f, (label < 5)::INT AS label FROM embeddings),
ranked AS (SELECT *, row_number() OVER (ORDER BY sha256('17|' || example_id)) AS rn, count(*) OVER () AS n FROM base),
embedded AS MATERIALIZED (SELECT example_id, label, f, CASE WHEN rn <= round_even(n * 0.6, 0) THEN 'train'
  WHEN rn <= round_even(n * 0.6, 0) + round_even(n * 0.2, 0) THEN 'validation' ELSE 'test' END AS split FROM ranked)"""


@query(
    "l9_linear_probe",
    _scores_sql(64, "SELECT 'all' AS g, label AS y, f FROM embedded WHERE split = 'train'", rows="embedded", before=_EMBEDDED),
)
def l9(v: Views) -> DataFrame:
    rows = v.embeddings
    model = monitors.linear_probe(rows.filter("split = 'train'"))
    scored = monitors.predict(model, monitors.as_features(rows))
    return _shown(scored, "example_id", "split", "label")


def _report_sql(before: str, train: str, rows: str) -> str:
    """Return CTEs that score rows by a fitted model as ``scored``, in ``component`` surface."""
    return f"""{before},
{logistic_fit(train, 6)},
scored AS MATERIALIZED (SELECT *, 'surface' AS component, {score("f")} AS score FROM ({rows}), fit_n)"""


_LEAKY = _FEATURED + """,
leaky AS MATERIALIZED (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY sha256('10|' || example_id), example_id)
    <= round_even(count(*) OVER (PARTITION BY label) * 0.2, 0) THEN 'test' ELSE 'train' END AS leaky_split FROM featured)"""


@query(
    "l10_invalid_split_diagnostic",
    f"""
WITH RECURSIVE {_report_sql(_LEAKY, "SELECT 'all' AS g, label AS y, f FROM leaky WHERE leaky_split = 'train'",
                            "SELECT * FROM leaky WHERE leaky_split = 'test'")}
SELECT n, positives, available, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, round(threshold, 4) AS threshold,
  round(achieved_recall, 6) AS achieved_recall, round(false_positive_rate, 6) AS false_positive_rate,
  (SELECT count(*) FROM (SELECT question_id FROM leaky WHERE leaky_split = 'train' INTERSECT
    SELECT question_id FROM leaky WHERE leaky_split = 'test')) AS question_groups_crossing_split,
  'invalid_leakage_diagnostic_not_research_evidence' AS status
FROM ({_metrics_sql("scored", "component")})""",
)
def l10(v: Views) -> DataFrame:
    out = monitors.invalid_split_diagnostic(_featured(v), seed=10)
    return _rounded_metrics(out)


def _rounded_metrics(df: DataFrame) -> DataFrame:
    digits = {"auroc": 6, "auprc": 6, "achieved_recall": 6, "false_positive_rate": 6, "threshold": 4}
    return df.withColumns({c: F.round(c, n) for c, n in digits.items() if c in df.columns})


_HALVING = f"""
halving AS (SELECT *, 0 AS step, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b, 0.0::DOUBLE AS c, 1.0::DOUBLE AS d FROM cases
  UNION ALL
  SELECT what, k, n, step + 1, CASE WHEN low THEN m ELSE a END, CASE WHEN low THEN b ELSE m END,
    CASE WHEN high THEN w ELSE c END, CASE WHEN high THEN d ELSE w END
  FROM (SELECT *, {_tail_sql("k, n + 1", "m")} < 0.025::DOUBLE AS low, {_tail_sql("0, k + 1", "w")} > 0.025::DOUBLE AS high
    FROM (SELECT *, (a + b) / 2 AS m, (c + d) / 2 AS w FROM halving WHERE step < 60))),
ends AS (SELECT what, round(CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE a END, 6) AS low,
  round(CASE WHEN k = n THEN 1.0::DOUBLE ELSE d END, 6) AS high FROM halving WHERE step = 60)"""


@query(
    "l11_external_transfer",
    f"""
WITH RECURSIVE {_report_sql(_FEATURED, _TRAIN + " AND family <> 'de'", "SELECT * FROM featured")},
chosen AS (SELECT threshold AS t FROM ({_metrics_sql("(SELECT * FROM scored WHERE split = 'validation' AND family <> 'de')", "component")})),
away AS MATERIALIZED (SELECT * FROM scored WHERE family = 'de'),
moved AS (SELECT max(t) AS t, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n,
  count(*) FILTER (label = 1 AND score >= t) AS tp, count(*) FILTER (label = 0 AND score >= t) AS fp FROM away, chosen),
cases AS (SELECT 'recall' AS what, tp AS k, p AS n FROM moved UNION ALL SELECT 'fpr', fp, n FROM moved), {_HALVING}
SELECT component, r.n, positives, available, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc,
  round(threshold, 4) AS threshold, round(achieved_recall, 6) AS achieved_recall,
  round(false_positive_rate, 6) AS false_positive_rate, round(t, 4) AS transferred_threshold, tp AS true_positives,
  fp AS false_positives, moved.n AS negatives, round(tp / p::DOUBLE, 6) AS transferred_recall,
  round(fp / moved.n::DOUBLE, 6) AS transferred_false_positive_rate, a.low AS recall_low, a.high AS recall_high,
  b.low AS fpr_low, b.high AS fpr_high
FROM ({_metrics_sql("away", "component")}) r, moved, ends a, ends b WHERE a.what = 'recall' AND b.what = 'fpr'""",
)
def l11(v: Views) -> DataFrame:
    rows = _featured(v)
    home, away = rows.filter("family <> 'de'"), rows.filter("family = 'de'")
    model = monitors.surface_monitor(home.filter("split = 'train'"))
    validation = monitors.predict(model, home.filter("split = 'validation'")).withColumn(
        "component", F.lit("surface")
    )
    thresholds = metrics.threshold_for_recall(validation, 0.5, ["component"])
    out = monitors.external_transfer(model, thresholds, away, component="surface")
    rates = ("transferred_recall", "transferred_false_positive_rate", "recall_low", "recall_high", "fpr_low", "fpr_high")
    rounded = {c: F.round(c, 6) for c in rates} | {"transferred_threshold": F.round("transferred_threshold", 4)}
    return _rounded_metrics(out).withColumns(rounded)


@query(
    "l12_baseline_report",
    f"""
WITH RECURSIVE {_report_sql(_FEATURED, _TRAIN, "SELECT * FROM featured WHERE split = 'test'")}
SELECT n, positives, available, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, round(threshold, 4) AS threshold,
  round(achieved_recall, 6) AS achieved_recall, round(false_positive_rate, 6) AS false_positive_rate
FROM ({_metrics_sql("scored", "component")})""",
)
def l12(v: Views) -> DataFrame:
    return _rounded_metrics(monitors.baseline_report(_featured(v)))


@query(
    "q5_require_gate",
    f"""
SELECT study, "check", value, passed, bool_and(passed) OVER (PARTITION BY study) AS accepted,
  value <> value AS altered_accepted
FROM (SELECT * FROM ({ORACLES["a14_natural_error_gate"]}) UNION ALL
  SELECT * FROM ({ORACLES["a19_gate_mixed_outcome_v2"]}))""",
)
def q5(v: Views) -> DataFrame:
    rows = v.rollouts.filter("condition = 'clean'")
    even = F.col("user_id") % 2 == 0
    stratum = F.when(even, "previously_truncated").otherwise("matched_clean_control")
    questions = v.questions.withColumn("stratum", stratum)

    def accepted(stored: DataFrame, again: DataFrame) -> Column:
        try:
            gates.require_gate(stored, again)
        except PermissionError:
            return F.lit(False)
        return F.lit(True)

    parts = []
    for study in ("natural_errors", "mixed_outcome_v2"):
        report = materialize(gates.gate_report(questions, rows, gates.GATES[study]))
        altered = report.withColumn("value", F.col("value") + 1)
        parts.append(report.select(
            "study", "check", "value", "passed", accepted(report, report).alias("accepted"),
            accepted(altered, report).alias("altered_accepted"),
        ))
    return parts[0].unionByName(parts[1])


@query(
    "u1_component_scores",
    f"""
SELECT example_id, component, score FROM scores
UNION ALL
SELECT example_id, view, arg_min(probability, attempt) FROM ({_PAYLOADS})
WHERE attempt <= 2 AND termination_clean AND reject_reason IS NULL
  AND provider_request_id IS NOT NULL GROUP BY example_id, view""",
)
def u1_components(v: Views) -> DataFrame:
    judge = judged(v).filter("scored").select(
        "example_id", F.col("view").alias("component"), "score"
    )
    return quality.score_union(v.scores.select("example_id", "component", "score"), judge)
