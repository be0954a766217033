"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. Deriving and writing the stored
input tables is timed as ``store_inputs`` and counts in the total. Every query is computed in
full into a sink that drops the rows; the best of two runs counts, so that JVM warm-up does not.
"""

import json
import os
import time

from mailgrid.checks.fixtures import Fixtures
from mailgrid.checks.registry import PLAIN
from mailgrid.session import local_session

HEADLINE = [
    "weekly_split",
    "largest_remainder",
    "explode_pieces",
    "assign_capacity",
    "normalize_capacity",
    "results_by_sender",
    "results_by_courier",
    "capacity_setting",
    "modified_capacity_setting",
    "peak_map",
    "courier_summary",
    "courier_view",
    "merge_declared",
    "dedup_declared",
    "apply_overrides",
    "compare_runs",
]

INPUTS = [
    "geo", "estimates", "declared", "capacity_pages", "run_capacity", "runs", "pieces",
    "courier_results", "courier_residuals", "override_documents",
]


def seconds(spark, name, folder):
    start = time.perf_counter()
    PLAIN[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"), "16g")
    start = time.perf_counter()
    for name in INPUTS:
        getattr(Fixtures(spark, folder), name)()
    times = {"store_inputs": round(time.perf_counter() - start, 3)}
    for name in HEADLINE:
        times[name] = round(min(seconds(spark, name, folder) for _ in range(2)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(os.path.basename(folder.rstrip("/")).removeprefix("sf")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
