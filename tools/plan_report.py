"""Summarise the final (adaptive) physical plan of every registered query:
operator counts per key, written as a Markdown table.

    python tools/plan_report.py [sf_dir] > PLANS.md

The plan tree is walked through the JVM objects: adaptive plans through their
final plan, query stages through their stage plan, scalar subqueries
included, and a cached relation's producing plan where it is first read.
Automatic broadcasts are off, so joins show as they would be on large tables.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortlens.plans import catalog  # noqa: E402
from cohortlens.session import build_session  # noqa: E402

STAGES = {"ShuffleQueryStage", "BroadcastQueryStage", "TableCacheQueryStage", "ResultQueryStage"}
COLUMNS = ["scans", "shuffles", "single-partition", "broadcasts", "smj", "bhj", "nested-loop", "windows",
           "hash-agg", "sort-agg", "cache-reads", "subqueries"]


def _seq(s):
    return [s.apply(i) for i in range(s.size())]


def walk(node, out: dict, seen: set):
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return walk(node.executedPlan(), out, seen)
    if name in STAGES:
        return walk(node.plan(), out, seen)
    if name.startswith("WholeStageCodegen") or name in ("InputAdapter", "AQEShuffleRead", "ColumnarToRow"):
        pass
    elif name.startswith("Scan") or name.startswith("FileScan"):
        out["scans"] += 1
    elif name == "Exchange":
        single = "SinglePartition" in node.outputPartitioning().toString()
        out["single-partition" if single else "shuffles"] += 1
    elif name == "BroadcastExchange":
        out["broadcasts"] += 1
    elif name == "SortMergeJoin":
        out["smj"] += 1
    elif name == "BroadcastHashJoin":
        out["bhj"] += 1
    elif name in ("BroadcastNestedLoopJoin", "CartesianProduct"):
        out["nested-loop"] += 1
    elif name == "Window":
        out["windows"] += 1
    elif name in ("HashAggregate", "ObjectHashAggregate"):
        out["hash-agg"] += 1
    elif name == "SortAggregate":
        out["sort-agg"] += 1
    elif name == "InMemoryTableScan":
        out["cache-reads"] += 1
        made = node.relation().cachedPlan()
        if made.toString() not in seen:
            seen.add(made.toString())
            walk(made, out, seen)
        return
    elif name in ("ReusedExchange", "ReusedSubquery"):
        return
    for sub in _seq(node.subqueries()):
        key = sub.toString()
        if key not in seen:
            seen.add(key)
            out["subqueries"] += 1
            walk(sub, out, seen)
    for child in _seq(node.children()):
        walk(child, out, seen)


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8, extra={"spark.sql.autoBroadcastJoinThreshold": "-1",
                                                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"})
    print("# Physical plans\n")
    print(f"Final adaptive plans of every registered query at `{sf_dir}`, from `tools/plan_report.py`. "
          "`shuffles` are hash or range exchanges; `single-partition` exchanges only feed one-row global "
          "aggregates (null profiles, key counts, scalar subqueries) or the total over the at most four status "
          "rows of `status_share`; never a window or sort over data that grows with the input; "
          "`cache-reads` read an intermediate persisted once for several consumers; its plan is counted where it "
          "is first read. Automatic broadcasts are off: the broadcasts left are those of bounded tables. Jobs that "
          "run while a query is built (hot keys, cutoffs, n-tile boundaries) are not in these plans.\n")
    print("| key | " + " | ".join(COLUMNS) + " |")
    print("|---|" + "---|" * len(COLUMNS))
    for key, fn in sorted(catalog.queries().items()):
        df = fn(spark, sf_dir)
        df.collect()  # on the DataFrame's own query execution, so its adaptive plan is final
        out = dict.fromkeys(COLUMNS, 0)
        walk(df._jdf.queryExecution().executedPlan(), out, set())
        print(f"| `{key}` | " + " | ".join(str(out[c]) for c in COLUMNS) + " |", flush=True)
        spark.catalog.clearCache()
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
