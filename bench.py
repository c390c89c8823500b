"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores. Each query runs once to warm up and
then ``BENCH_RUNS`` times into the noop sink; the best time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shardframe.plans import QUERIES  # noqa: E402
from shardframe.session import local_session  # noqa: E402

HEADLINE = [
    "d1_sample_order",
    "d5_assign_shards",
    "d8_pack_shard_files",
    "d9_shard_index",
    "d16_rescale_audit",
    "i1_named_ranges",
    "i8_locate",
    "x4_tensor_range",
    "c1_flatten_structure",
    "r7_transfer_plan",
    "r8_apply_plan",
    "r12_migrate_state",
    "a4_equal_shares",
    "p3_resolve_source",
    "p11_path_stats",
    "l2_step_times",
    "l3_throughput",
    "l9_smooth_50_5",
    "l10_marker_gaps",
    "s4_build_record_index",
    "s14_read_logs",
]


def main() -> None:
    """Run and print."""
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, partitions=int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        best = None
        for attempt in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if attempt:
                best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cores": int(cores),
            }
        )
    )


if __name__ == "__main__":
    main()
