"""Headline queries on one machine; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "screen_packages", "screen_declarations", "evaluate_all", "declaration_table", "extract_mrp", "extract_net_quantity",
    "extract_dates", "extract_contacts", "kpi_overview", "admin_summary", "top_violations", "screening_summary", "risk_level",
    "review_fifo", "verdict_history", "stable_frames", "nms_dedup", "reading_rows", "evidence_match", "merge_declarations",
    "provision_tree", "asof_amendment", "rule_upsert", "override_checks", "mask_numbers", "suspicious_text",
]


def main() -> None:
    from panelmark.queries import QUERIES
    from panelmark.session import build_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(cores, "panelmark-bench")
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in HEADLINE:
        times = []
        # one warm-up, then the timed runs
        for attempt in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            if attempt or runs == 0:
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf.rstrip("/")), "cores": cores,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
