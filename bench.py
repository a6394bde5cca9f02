"""Times the headline queries: each runs twice, and the second time counts. Prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from lathe.queries import QUERIES

NAMES = ("flagship", "scan_pruned", "filter_col_col", "join_inner_equi", "join_hash", "join_sort_merge", "join_multiway_3", "join_multiway_6", "join_composite_key", "join_equi_plus_theta", "cross_join_large", "sort_multi_mixed", "sort_large", "sink_pipe_text", "stats_cardinality")


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in NAMES:
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - began, 3)
    sf = folder.rstrip("/").rpartition("sf")[2]
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
