"""Headline queries on one node: prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from tidemark.plans.catalog import QUERIES
from tidemark.session import local_session

HEADLINE = ["flagship_ranked_trends", "A05_weighted_mean", "J20_point_in_polygon", "M24_leave_one_block_out",
            "M20_moran_permutation", "A20_quantiles", "W07_average_and_percentile_rank", "M23_sensitivity_sweep",
            "A39_parent_explained_share", "M15_detection_threshold"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(repeats + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        # The first run pays for class loading and code generation.
        times[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "headline queries, sum of median seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")), "cpus": cpus, "repeats": repeats}))
    spark.stop()


if __name__ == "__main__":
    main()
