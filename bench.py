"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names), BENCH_RUNS (default 2, the best run counts).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from queuelens.session import build_session  # noqa: E402
from queuelens.workload import registry  # noqa: E402

HEADLINE = ["kpi_summary", "wait_deciles", "boxplot_stats", "volume_by_dims", "hierarchy_rollup",
            "funnel_stages", "actor_diag_having", "heatmap_z_row", "outlier_list", "cascading_options",
            "text_any", "text_entity", "ownership_days", "running_breaker", "flat_request",
            "legacy_flat_16", "value_frequency", "profile_numeric", "upsert_latest",
            "stream_sliding_errors"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session("bench", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    known, seconds = registry(), {}
    for name in names:
        best = float("inf")
        for _ in range(runs):
            start = time.perf_counter()
            known[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        seconds[name] = round(best, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
