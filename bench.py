"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every query runs whole: its result goes to the ``noop`` sink, so nothing is cut off or collected.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from weekloom.plans import catalog

HEADLINE = [
    "expanding_outbreak_labels",
    "weekly_case_rollup",
    "case_level_weekly",
    "spatial_daily",
    "weather_daily_to_weekly",
    "weather_hourly_to_daily",
    "weather_rolling",
    "case_lags_operational",
    "delayed_features",
    "live_delayed_features",
    "gate_cross",
    "recall_gate",
    "metric_average_precision",
    "profile_describe",
    "diff_join",
    "dedup_keep_last",
    "sink_vintage",
    "reconcile_metrics",
    "promotion_rules",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("weekloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed run pays for JIT and class loading.
    catalog.QUERIES["weekly_case_rollup"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
