"""Time the headline queries: one JSON line, warm median of three runs each."""

from __future__ import annotations

import json
import os
import statistics
import time

from shiftlens.plans import catalog
from shiftlens.session import build_session

HEADLINE = (
    "j6_loo_answer_shift",
    "m6_evaluate_scores",
    "m10_sibling_sensitivity",
    "b1_cluster_bootstrap_effect",
    "b3_cluster_bootstrap_metrics",
    "b4_paired_bootstrap_difference",
    "a3_hint_answer_shift",
    "a4_condition_report",
    "a6_effect_by",
    "a15_stratum_quantiles",
    "a19_gate_confirmatory",
    "w1_balanced_select",
    "w6_truncate_siblings",
    "p5_extract_final_answer",
    "p7_grade",
    "p18_surface_features",
    "p20_judge_prompts",
    "k1_path_counts",
    "l1_surface_monitor",
)
RUNS = 3


def main() -> None:
    """Run every headline query and print the result line."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    queries = catalog.queries()
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    result = {
        "metric": "headline_total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
