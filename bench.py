"""Time the catalogue's headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

from gaugeflow.plans.catalog import QUERIES
from gaugeflow.session import local_session

HEADLINE = (
    "warehouse_summary", "failure_reading_counts", "minute_aggregate", "label_distribution",
    "label_dense_incidents", "prefailure_profile", "rolling_avg", "rolling_std",
    "normal_vs_prefailure", "zscore_exceedances", "median_impute", "standardize",
    "baseline_percentile", "anomaly_by_period", "calibrate_threshold", "model_comparison",
    "window_coverage", "prediction_behaviour", "linear_attribution", "top_drivers",
    "fuse_predictions", "risk_distribution", "alert_episodes", "cost_rollup", "drift_report",
    "weekly_monitoring", "view_kpis",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["telemetry_project"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
