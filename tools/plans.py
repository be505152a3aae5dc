"""Write PLANS.md: physical-plan facts of the headline queries (explain "formatted").

    python tools/plans.py [--sf-dir DIR] > PLANS.md
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarize(plan: str) -> dict:
    ops = re.findall(r"^\(\d+\) ([A-Za-z]+(?: [A-Za-z]+)?)", plan, flags=re.M)
    count = lambda name: sum(1 for o in ops if o.startswith(name))
    scans = re.findall(r"Location: InMemoryFileIndex \[file:[^\]]*/([a-z]+)\.parquet\]", plan)
    pushed = re.findall(r"PushedFilters: (\[.*?\])", plan)
    schema = re.findall(r"ReadSchema: (struct<.*?>)", plan)
    return {"exchanges": count("Exchange"), "broadcasts": count("BroadcastExchange"),
            "sorts": count("Sort"), "windows": count("Window"), "hash_aggs": count("HashAggregate"),
            "scans": scans, "pushed": pushed, "schema": schema}


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.1")
    args = ap.parse_args()
    from panelspark.plans.registry import HEADLINE, QUERIES, load_all
    from panelspark.session import get_session
    spark = get_session("local[8]", shuffle_partitions=16, extra={"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    print("# PLANS - physical plans of the headline queries\n")
    print(f"Generated by `tools/plans.py` on `{args.sf_dir}` (local[8], 16 shuffle partitions, AQE on; "
          "plans before AQE re-optimisation). Broadcasts of driver tables here come from their small file "
          "sizes at this scale factor; at cluster scale the same plans keep sort-merge joins, which AQE "
          "converts or skew-splits at runtime.\n")
    for name in HEADLINE:
        df = QUERIES[name](spark, args.sf_dir)
        plan = df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        s = summarize(plan)
        print(f"## {name}\n")
        print(f"- exchanges: {s['exchanges']} (of which broadcast: {s['broadcasts']}), hash aggregates: "
              f"{s['hash_aggs']}, sorts: {s['sorts']}, windows: {s['windows']}")
        print(f"- parquet scans: {', '.join(s['scans']) or '(checkpointed input)'}")
        for tbl, pf, rs in zip(s["scans"], s["pushed"], s["schema"]):
            print(f"  - `{tbl}` pushed {pf} read {rs}")
        tree = plan.split("\n\n")[0]
        print("\n```\n" + "\n".join(line for line in tree.splitlines()[:60]) + "\n```\n")
    spark.stop()


if __name__ == "__main__":
    main()
