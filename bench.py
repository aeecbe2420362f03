"""Time the headline queries, median of three runs each: prints one JSON line.  ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidalspan.plans.registry import QUERIES  # noqa: E402

HEADLINE = [
    "a7_find_peaks", "a1_average_by_time", "w1_average_rolling", "w3_outlier_scores", "w7_v_slope", "w9_end_plateau",
    "c1_validate", "c3_detect_thresholds", "c4_extract_stages", "a4_stage_summary_last", "c5_protocol_config",
    "c12_assess_quality", "c20_report_record", "c22_analysis", "d1_panel_series",
    "long_find_peaks", "long_average_by_time", "long_thresholds",
]

RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/events.parquet").count()  # warm-up of the session only
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(median(runs), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(folder)}))
    spark.stop()


if __name__ == "__main__":
    main()
