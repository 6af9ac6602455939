"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full (a no-op sink consumes every row) three
times; the reported time per query is the fastest run (JIT warm).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from codesieve.plans import catalog  # noqa: E402
from codesieve.session import build_session  # noqa: E402

HEADLINE = [
    "review_files",
    "classify_files",
    "detect_topic",
    "complexity_hints",
    "review_with_replies",
    "annotate_files",
    "snapshot_diff",
    "select_smart",
    "existing_only",
    "review_corpus",
    "upsert_repositories",
    "list_reviews",
    "list_reviews_for_repo",
    "get_review",
    "parse_repo_url",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", app="codesieve-bench", shuffle_partitions=max(cpus, 8),
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(3):
            t0 = time.perf_counter()
            df = catalog.SPARK[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    sf_name = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    try:
        sf: float | str = float(sf_name)
    except ValueError:
        sf = sf_name
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
