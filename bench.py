"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line:
{"metric": "total_query_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query's result goes to Spark's ``noop`` sink, so the whole plan runs and
no result passes through the driver.  Before timing, the headline queries run once over the
tiny sf0.001 tables: that starts the JVM's JIT and one Python worker per
task slot, fixed costs that do not grow with the data.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "blocks_by_reason",
    "final_actions",
    "evaluate_text",
    "pii_spans",
    "terms_theta",
    "rate_limit",
    "restart_budget",
    "failure_streak",
    "golden_relevance",
    "golden_cross",
    "flatten_chat",
    "replace_list",
    "version_diff",
    "pinned_replay",
    "rerank_topn",
    "apply_changes",
    "log_scan",
    "metrics_rows",
    "stream_decide",
    "stream_rate_limit",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from sluice.plans import all_queries
    from sluice.session import INPUT_PARTITIONS, build_session

    spark = build_session()
    spark.conf.set(INPUT_PARTITIONS, 2 * spark.sparkContext.defaultParallelism)
    reg, _ = all_queries()
    names = [n for n in HEADLINE if n in reg]
    if len(sys.argv) > 1:
        names = sys.argv[1:]
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        for n in names:
            reg[n](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.perf_counter()
        reg[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
