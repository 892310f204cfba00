"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the number of local
cores. Every query is computed in full and counted; nothing is shared between
queries. One small untimed run warms up the JVM first.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidecore import checks  # noqa: E402
from tidecore.session import get_session  # noqa: E402

HEADLINE = [
    "core_numbers",
    "core_distribution",
    "windowed_core_numbers",
    "core_after_slide",
    "maintain_windows",
    "core_timeline",
    "mcd_index",
    "pcd_index",
    "simple_edges",
    "bin_equal_width",
    "bin_equal_count",
    "effective_delta",
    "window_step_sweep",
    "dataset_profile",
    "temporal_profile",
    "inter_event_gaps",
    "novelty_index",
    "quality_score",
]
WARM_UP = "/root/testdata/sf0.001"


def run(spark, fn, sf_dir: str) -> float:
    begin = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session(
        "bench", master=f"local[{cpus}]", shuffle_partitions=8 if cpus == "*" else int(cpus)
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = checks.queries()
    for name in ("core_numbers", "dataset_profile"):
        run(spark, queries[name], WARM_UP if os.path.isdir(WARM_UP) else sf_dir)
    times = {name: round(run(spark, queries[name], sf_dir), 3) for name in names}
    found = re.search(r"sf([0-9.]+)", os.path.basename(sf_dir.rstrip("/")))
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(found.group(1)) if found else None,
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
