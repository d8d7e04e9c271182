"""Seconds of the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from pyspark.sql import SparkSession

SF_DIR, CPUS, RUNS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "1"))
HEADLINES = """timeline_window merge_sources errors_by_fingerprint error_trend bookmark_context actions_around state_at state_nearest state_diff bookmark_outliers search_regex
content_severity role_index roles_never rle_collapse session_gap sliding_counts perf_metrics sag_vs_median health_score diagnose_rank crash_verdict retention_evict hamming_pairs grid_diff entropy flatten_json
source_exclusive_signatures watch_hits signal_suppression rate_limited level_source_rollup
text_severity content_role_index document_tails watch_table_hits code_signal_hits multiline_records hot_medians grid_regions interface_nodes map_deltas error_run stuck_screens frames_in_code""".split()


def main() -> None:
    from tidelog.plans import catalogue

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, took = catalogue.queries(), {}
    names = [n for n in HEADLINES if n in known]
    for name in names:
        times = []
        for _ in range(RUNS + 1):  # the first run warms up
            began = time.perf_counter()
            known[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(median(times[1:]), 3)
        print(name, took[name], file=sys.stderr)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
