"""Time the headline queries; prints one JSON line.

Every query starts from the tables: intermediates that queries of one session share are dropped before each.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from driftlens.plans import queries as registry  # noqa: E402
from driftlens.session import drop_run, local_session  # noqa: E402

WARM_UP = ("c3_usage_drift", "a1_evolution", "g5_documents")

HEADLINE = (
    "flagship_drift_categories",
    "c1_harvest",
    "c3_usage_drift",
    "c4_surface",
    "c5_surface_schema",
    "c7_dry_run",
    "sd4_field_diff",
    "a1_evolution",
    "s10_report_lines",
    "h13_reach",
    "h15_models",
    "j15_arguments",
    "g5_documents",
    "f3_position",
    "f4_position",
    "f1_normalise",
    "d1_blocks",
    "a6_categories",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    chosen = sys.argv[1:] or HEADLINE
    # The JVM's and the Python workers' first-use cost is paid on the smallest tables, before the clock.
    smallest = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    if os.path.isdir(smallest):
        for name in WARM_UP:
            registry.QUERIES[name](spark, smallest).write.format("noop").mode("overwrite").save()
    drop_run(spark)
    times, staged = {}, {}
    for name in chosen:
        registry.forget()
        start = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        staged[name] = round(drop_run(spark) / 1e6, 1)
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "staged_mb": staged,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
