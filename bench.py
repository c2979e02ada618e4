"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 1 timed run
after BENCH_WARM untimed ones, default 1), BENCH_QUERIES (comma-separated names).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import time

from pyspark.sql import SparkSession

from routegauge.plans.catalogue import all_plans

HEADLINE = "rec_metrics_wide,ir_metrics_wide,rec_features,policy_report,greedy_budget"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = os.environ.get("BENCH_QUERIES", HEADLINE).split(",")
    warm, runs = int(os.environ.get("BENCH_WARM", "1")), int(os.environ.get("BENCH_RUNS", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("routegauge-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    plans, seconds = all_plans(), {}
    for name in names:
        taken = []
        for i in range(warm + runs):
            start = time.perf_counter()
            plans[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i >= warm:
                taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(sf.group(1)) if sf else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
