"""Headline queries on one machine: one warm-up, then the median of three runs.

Prints one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma list or
``all``) change what is run.
"""

from __future__ import annotations

import json
import os
import pathlib
import statistics
import sys
import time

ROOT = pathlib.Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from touchline.catalog import all_queries  # noqa: E402
from touchline.session import local_session  # noqa: E402

HEADLINE = [
    "team_perspective",
    "match_results",
    "opponent_form",
    "rolling_mean_k",
    "feature_master",
    "ewm",
    "congestion_teams",
    "asof_latest",
    "interval_count",
    "fixture_features",
    "stats_long_to_wide",
    "quarantine_clean",
    "dedupe_keep_last",
    "no_vig",
    "markets",
    "drift_report",
    "quality_report",
    "quarantine_issues",
    "melt_and_clean",
    "spearman",
    "psi",
    "stream_dedupe",
    "coverage_extended",
    "chrono_split",
]


def run(query, spark, sf) -> float:
    start = time.perf_counter()
    query(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    chosen = os.environ.get("BENCH_QUERIES", "")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    queries = all_queries()
    names = list(queries) if chosen == "all" else (chosen.split(",") if chosen else HEADLINE)
    spark = local_session(cpus, shuffle_partitions=int(cpus), name="touchline-bench")
    seconds = {}
    for name in names:
        run(queries[name], spark, sf)
        seconds[name] = round(statistics.median(run(queries[name], spark, sf) for _ in range(repeats)), 3)
        spark.catalog.clearCache()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": pathlib.Path(sf).name, "cpus": cpus, "spark": spark.version,
                "statistic": f"median of {repeats} after one warm-up",
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
