"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full through the ``noop`` sink (every row is
computed, nothing is collected to the driver).  Prints ONE JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n]

    from panelspark.session import get_session
    from panelspark.plans.registry import HEADLINE, QUERIES, load_all

    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    names = names or list(HEADLINE)
    # warm-up: JVM, codegen caches and file listing (not timed)
    QUERIES["session_trends"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings, rows = {}, {}
    for name in names:
        t0 = time.perf_counter()
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
    j1 = QUERIES["panel_features"](spark, sf_dir).count()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_total_wall_clock", "value": round(sum(timings.values()), 3), "unit": "sec",
           "queries": timings, "sf": float(m.group(1)) if m else sf_dir,
           "panel_features_rows": j1,
           "panel_features_rows_per_sec": round(j1 / timings["panel_features"], 1) if "panel_features" in timings else None}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
