"""Benchmark the headline analyses.

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]``, executes it fully through the ``noop`` sink (no rows
travel to the driver) and prints one JSON line with the median of
``$BENCH_RUNS`` warm runs per query (after one untimed warm-up pass; cached
intermediates are dropped after every run).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortlens.plans import catalog  # noqa: E402
from cohortlens.session import build_session  # noqa: E402

HEADLINE = [
    "null_profile_services",     # data-quality checks
    "key_uniqueness_services",
    "region_report",             # segment report by region x income
    "age_report",                # segment report by age bracket
    "rfm_table",                 # two RFM models with distributed n-tiles
    "churn_table",               # flagship: per-user churn table
    "attribution",               # 30-day outreach attribution
    "conversion_crosstab",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES")
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus,
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    qs = catalog.queries()
    names = sorted(qs) if names == "all" else (names.split(",") if names else HEADLINE)
    # warm-up pass (JIT, code generation, file listing), then timed runs
    for name in names:
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spark.catalog.clearCache()
    timings = {}
    for name in names:
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
            spark.catalog.clearCache()
        timings[name] = round(statistics.median(samples), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_median_query_sec", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "sf": float(sf) if sf else None,
                      "cpus": cpus, "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
