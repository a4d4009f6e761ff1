"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line.  Each query is executed in full (noop sink, no
collect to the driver); one untimed warm-up query primes the JVM."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vectorlint.plans.catalog import QUERIES  # noqa: E402
from vectorlint.session import get_spark  # noqa: E402

HEADLINE = [
    "overlap_building",        # flagship: grid pair join + exact area kernel
    "touching_neighbours",     # pair join + boundary contacts
    "geometry_valid",          # edge self-join within features
    "isolated_road",           # node degrees + candidate-vs-all pair join
    "run_building",            # the 11-check building runner
    "connected_components",    # iterative label propagation
    "near_duplicate_name",     # segment-indexed fuzzy name join
    "latest_status",           # registry: latest status per violation
    "acute_angle",             # per-part column kernels
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus))
    QUERIES["geom_area"](spark, sf_dir).write.format("noop").mode("overwrite").save()   # warm-up
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
