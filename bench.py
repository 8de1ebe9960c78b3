"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "auroc_by_category_with_mean", "benchmark_metrics", "object_score_stats", "normalize_clouds", "voxel_first_row",
    "voxel_centroid", "knn_join", "leave_one_object_out_nearest", "radius_join", "farthest_point_sampling", "coreset_bank",
    "normal_reference", "matching_channels", "rule_comparison", "bootstrap_interval", "config_scores",
    "cloud_descriptors", "anomaly_benchmark",
)


def main() -> None:
    from cloudsieve.catalog import QUERIES
    from cloudsieve.session import get_spark

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_spark("bench", cores)
    spark.sparkContext.setLogLevel("OFF")
    # start the JVM's file reader and the Python workers before the clock runs
    spark.read.parquet(f"{sf_dir}/region.parquet").repartition(int(cores)).mapInPandas(
        lambda it: it, "r_regionkey int, r_name string").count()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
