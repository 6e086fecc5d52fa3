"""Benchmark: run the registered queries at one scale factor and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated subset, default: all registered queries).

Each query is executed in full with the ``noop`` sink (every row is computed,
nothing is collected on the driver). The first pass over a query is timed; a
warm-up query runs once before timing starts so JVM start-up is not counted.
"""

from __future__ import annotations

import gc
import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vitrine.plans import QUERIES  # noqa: E402
from vitrine.session import get_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(QUERIES)
    spark = get_session(f"local[{cpus}]", cpus)
    # warm-up: JVM, Parquet footers, Python workers
    for warm in ("product_page", "assign_references"):
        try:
            QUERIES[warm].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception:  # noqa: BLE001
            pass
    times: dict[str, float] = {}
    failed: list[str] = []
    for name in names:
        t0 = time.perf_counter()
        try:
            QUERIES[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as exc:  # noqa: BLE001  (a failing query must not hide the others)
            failed.append(name)
            print(f"{name} failed: {type(exc).__name__}: {str(exc)[:200]}", file=sys.stderr)
            continue
        times[name] = round(time.perf_counter() - t0, 3)
        gc.collect()  # drop the finished query's JVM-side objects before timing the next
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus,
                      "failed": failed}))
    spark.stop()


if __name__ == "__main__":
    main()
