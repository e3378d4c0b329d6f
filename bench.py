"""Benchmark: run the headline ledger queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set), BENCH_REPEAT (default 3).
Each query runs its whole plan into Spark's ``noop`` sink (no driver collect); the
reported time per query is the best of the repeats, and ``first_run`` holds the total of
the first (cold: plan compilation, JIT) runs.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = ["month_category", "widen_net_owes", "upsert_expenses", "category_cube", "mom_full",
            "member_balances", "text_search", "table_page", "snapshot_json", "dashboard_view", "exclusions",
            "stream_upsert"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "3")))

    from potluck.queries import QUERIES
    from potluck.session import local_session

    spark = local_session(cpus, shuffle_partitions=max(8, 2 * cpus), app="potluck-bench")
    # warm up the JVM and the Parquet readers (not timed)
    QUERIES["summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    first = 0.0
    for name in names:
        best = None
        for i in range(repeat):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            first += dt if i == 0 else 0.0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus, "repeat": repeat,
                      "first_run": round(first, 3)}))
    spark.stop()


if __name__ == "__main__":
    main()
