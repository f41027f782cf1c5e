"""Benchmark: warm median of three per headline query; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, ``BENCH_QUERIES`` a comma-separated choice.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "core_totals", "active_cohorts", "source_cohorts", "reconcile", "dup_top", "health_digest", "top_per_category", "board_page",
    "duplicate_survivors", "archive_duplicates", "insert_new", "prospect_candidates", "search", "search_index", "source_health",
    "rate_limit_streak", "link_strikes", "incident_actions", "health_sliding", "activity_sessions", "sanitize_urls", "add_keys",
    "enrich_columns", "clean_text_rss", "detect_language", "geo_gate", "scan_landing_pages", "classify_links", "robots_verdicts",
    "extract_rss", "extract_lever", "extract_html", "apply_verdicts", "ingest_run",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from checks.all import QUERIES
    from listingspark.session import configure

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = configure(
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).config("spark.sql.shuffle.partitions", cpus)
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(4):  # the first one warms up
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    spark.stop()
    print(json.dumps({"metric": "sum of warm medians over headline queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
