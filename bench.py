"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs $BENCH_RUNS times after one warm-up; the median counts. Results go to the
noop sink, so all rows are computed and none are sent to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "table_fingerprint", "fingerprint_history", "extend_fingerprints", "wy_fingerprint_history",
    "wy_document_fingerprints", "document_fingerprints", "regrain_finer", "regrain_coarser",
    "replay_coarser", "replay_finer", "compare_histories", "table_version_delta", "coalesce_ranges",
    "classify_changes", "version_catalog", "derived_ids", "aligned_ids", "coverage_gaps",
    "newest_common_versions", "throughput",
]


def main() -> None:
    from pyspark.sql import SparkSession
    from workloads.queries import load

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()

    def once(name):
        start = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.time() - start

    seconds = {}
    for name in names:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
