"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query runs once to warm up and then BENCH_RUNS times (default 2); the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from sluice.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "flow_aggregate", "features_77", "flow_protocol_summary", "flow_tick_eviction", "stream_flow_sessions",
    "dedup_features_keep_first", "cross_split_anti_join", "combine_resplit", "stratified_split", "kfold_stratified",
    "balance_binary", "fit_medians", "corr_matrix", "profile_summary", "preprocess_fit_transform",
    "metric_table", "metric_roc_auc_ovr", "block_first_per_source", "alert_cooldown", "kpi_cards", "log_view",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    scratch = tempfile.TemporaryDirectory(prefix="sluice-bench-", ignore_cleanup_errors=True)
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "2"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", scratch.name).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs + 1):
            start = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            taken.append(time.time() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
