"""Bench: wall-clock of the headline queries at one scale factor.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is fully computed with the ``noop`` sink (no collect to the
driver); queries that write dumps or backups do their own writes. Every
query runs twice: ``queries`` / ``value`` are the second (warm) run, after
JVM code generation and Python worker start-up; the first runs are reported
as ``cold_queries`` / ``cold_sec``. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablecraft import examples as ex  # noqa: E402
from tablecraft.session import local_session  # noqa: E402

HEADLINE = [
    "table_stats_total",
    "row_counts",
    "copy_where",
    "merge_append",
    "schema_diff",
    "sync_changes",
    "four_way_join_sizes",
    "array_member_join",
    "hit_ratio",
    "usage_levels",
    "retention_plan",
    "due_rows",
    "cluster_health",
    "sql_literals_pages",
    "insert_batches",
    "dump_statements",
    "dump_roundtrip_orders",
    "dump_roundtrip_gz",
    "load_batch_outcomes",
    "stream_latest_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cpus, shuffle_partitions=max(int(cpus) * 2, 8))
    ex.load(spark, sf_dir, "region").count()  # JVM warm-up outside the timings
    times, cold = {}, {}
    for key in only:
        for run in ("cold", "warm"):
            t0 = time.time()
            ex.REGISTRY[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            (cold if run == "cold" else times)[key] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else None,
        "cold_sec": round(sum(cold.values()), 3),
        "cold_queries": cold,
        "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
