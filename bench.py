"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` is the table folder, ``BENCH_CPUS`` the local cores. Each query runs
once to warm up the JVM and once for the clock, into a sink that reads every
column and keeps nothing.
"""

from __future__ import annotations

import json
import os
import re
import time

from heatlens.checks.queries import QUERIES
from heatlens.staging import get_session

HEADLINE = (
    "trace_valid",
    "trace_by_bucket",
    "arrival_ordinal",
    "slice_ordinal_forward",
    "heat_forward",
    "heat_forward_by_clock",
    "heat_forward_runs",
    "heat_bounds",
    "topk_per_bucket",
    "hot_set_overlap",
    "classify_forward",
    "classify_neighbor",
    "classify_by_block",
    "classify_by_time",
    "classify_by_time_mem",
    "classify_backward",
    "classify_backward_bucketed",
    "classify_backward_fixed",
    "classify_total_by_block",
    "classify_total_by_time",
)


def run(spark, name: str, folder: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("heatlens-bench", cores=cores, spark__sql__shuffle__partitions=cores)
    spark.sparkContext.setLogLevel("OFF")
    for name in HEADLINE:
        run(spark, name, folder)
    timings = {name: round(run(spark, name, folder), 3) for name in HEADLINE}
    scale = re.search(r"sf([\d.]+)$", folder)
    print(
        json.dumps(
            {
                "metric": "headline query time, total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(scale.group(1)) if scale else folder,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
