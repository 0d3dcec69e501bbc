"""Time the headline queries: ``BENCH_SF_DIR`` (tables), ``BENCH_CPUS`` (cores), ``BENCH_RUNS`` (timed runs, median).

Prints one JSON line. Each query runs once before it is timed; ``cold`` in the output holds those first runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from driftline.catalog import QUERIES
from driftline.session import local_session

HEADLINE = [
    "season_means", "seasonal_trend", "annual_trend_long", "annual_copy_summary", "combined_trends",
    "pivot_periods", "clamp_rules", "monthly_fill_lm", "stepwise_regression", "cascade_fill",
    "interpolated_series", "clean_series", "five_number", "exact_quantiles", "avg_rank", "fdr_adjust",
    "year_vs_history_tests", "box_outliers", "permanova_two", "interpolated_by_time", "clamp_wide", "site_trends", "bootstrap_ci", "period_change", "permanova", "kde_grid", "threshold_band", "kmeans_clusters",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "4")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    cold, warm = {}, {}
    for name in names:
        cold[name] = round(run(spark, name, folder), 3)
        warm[name] = round(statistics.median(run(spark, name, folder) for _ in range(runs)), 3) if runs else cold[name]
    total = round(sum(warm.values()), 3)
    print(json.dumps({"metric": "total seconds of headline queries (warm median)", "value": total, "unit": "sec",
                      "queries": warm, "cold": cold, "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cpus": cores}))
    spark.stop()


if __name__ == "__main__":
    main()
