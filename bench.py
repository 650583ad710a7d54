"""Headline queries on one machine: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 4) choose data and cores;
BENCH_QUERIES, a comma-separated list or "all", other queries; BENCH_RUNS the runs per query (median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from packetloom.plans.catalog import queries

HEADLINE = (
    "q1_new_tcp,q2_ssh_brute,q3_superspreader,q4_port_scan,q5_heavy_flows,q6_syn_flood,q7_completed_flow,"
    "q8_slowloris,q1_cms,q5_fcm,q4_bloom,q3_bloom_cms,q8_bloom_cms"
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "4"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", HEADLINE)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("packetloom-bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        # the stages are small: keep all cores busy instead of merging them into one task
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        # no Python call-site recording for each expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    everything = queries()
    names = list(everything) if chosen == "all" else chosen.split(",")

    def run(name: str) -> float:
        start = time.perf_counter()
        everything[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for _ in range(2):  # warm-up: class loading, code generation, compilation
        for name in names:
            run(name)
    seconds = {}
    for name in names:
        seconds[name] = round(statistics.median(run(name) for _ in range(runs)), 4)
    frames = spark.read.parquet(f"{folder}/events.parquet").count()
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "telemetry_queries_wall_seconds",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "frames": frames,
            }
        )
    )


if __name__ == "__main__":
    main()
