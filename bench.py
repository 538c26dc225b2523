"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from axisflow.catalog import load
from axisflow.session import build_session

HEADLINE = [
    "interior_peak", "window_mean", "kernel_smooth", "kernel_smooth_operators", "normalize_total_log1p", "tfidf", "highly_variable", "residualise_one",
    "knn_exact", "pseudotime_velocity", "proximal_join", "global_feature_rank", "project_features", "regulator_scores", "enrichment", "infer_regulators",
    "binned_pullback", "refine_grn", "sinkhorn_plan", "sinkhorn_points", "compare_regimes_by_cell_type", "operator_spectrum", "dft", "ranking_overlap",
    "rolling_mean", "empirical_p", "bandwidth_score",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]
    queries["binary_axis"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM and the scan path
    took = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf.group(1)) if sf else None}))


if __name__ == "__main__":
    main()
