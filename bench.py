"""Times the headline queries and prints one JSON line; BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS set where and how."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from keyloom import registry
from keyloom.operators.external import discard
from keyloom.session import build_session

HEADLINES = [
    "rn_single_key",
    "rn_inverse_key",
    "rn_key_two_orders",
    "rn_two_keys",
    "rn_owner_path",
    "rn_sql_window",
    "topk_per_key",
    "rn_array_passthrough",
    "received_total",
    "block_statistics",
    "node_weights",
    "subset_weights",
    "buffer_occupancy_sequential",
    "external_sort_position",
    "hash_bucket_keys",
    "split_files",
    "sorted_position_payload",
    "rn_skewed_key",
    "batch_near_unique",
    "split_file_sizes",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    discard(registry.QUERIES[HEADLINES[0]](spark, folder))  # starts the JVM's compiler and Spark's services
    took: dict[str, float] = {}
    for name in HEADLINES:
        each = []
        for _ in range(runs):
            start = time.perf_counter()
            discard(registry.QUERIES[name](spark, folder))
            each.append(time.perf_counter() - start)
        took[name] = round(median(each), 3)
    spark.stop()
    sf = os.path.basename(folder).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
