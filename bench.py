"""Times the registered queries, each computed in full, and prints one JSON line.

``BENCH_SF_DIR``  folder of tables (default /root/testdata/sf0.1)
``BENCH_CPUS``    local cores (default 8)
``BENCH_QUERIES`` comma-separated names (default all)
``BENCH_CSV_MB``  instead: time the CSV jobs on a file of about this many MB,
                  made from the line items
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from millrace.functions.fields import split_names
from millrace.operators.binning import bin_columns
from millrace.operators.subsets import stored_bytes
from millrace.plans import preparation
from millrace.registry import QUERIES
from millrace.registry.common import scratch_folder
from millrace.session import local_session
from millrace.sinks.execution import materialise

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = split_names(os.environ.get("BENCH_QUERIES", "")) or list(QUERIES)
CSV_MB = int(os.environ.get("BENCH_CSV_MB", "0"))
REPEATS = 2


def timed(run) -> float:
    begin = time.monotonic()
    run()
    return time.monotonic() - begin


def bench_queries(spark) -> dict[str, float]:
    """Best of two timed runs after one that warms up."""
    seconds = {}
    for name in NAMES:
        def run(query=QUERIES[name]):
            materialise(query(spark, FOLDER))

        run()
        seconds[name] = round(min(timed(run) for _ in range(REPEATS)), 3)
        spark.catalog.clearCache()
        print(f"{name} {seconds[name]}", file=sys.stderr)
    return seconds


def bench_csv(spark, megabytes: int) -> dict[str, float]:
    """The scaling and encoding jobs on CSV text, first run, reading included."""
    folder = scratch_folder(spark, FOLDER, "bench-csv")
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    rename = {
        "l_linenumber": "passenger_count",
        "l_quantity": "trip_distance",
        "l_extendedprice": "fare_amount",
    }
    trips = lines.withColumnsRenamed(rename)
    plain, binned = f"{folder}/trips", f"{folder}/binned"
    bytes_per_copy = lines.count() * 72  # a line item is about 72 bytes of CSV
    copies = max(1, round(megabytes * 1e6 / bytes_per_copy))
    many = trips.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).repartition(16)
    many.write.mode("overwrite").option("header", True).csv(plain)
    features = list(rename.values())
    ready = bin_columns(trips, features)
    ready = ready.select(*[F.col(n + "_bin").alias(n) for n in features],
                         *[n for n in trips.columns if n not in features])
    ready.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).repartition(16).write.mode(
        "overwrite"
    ).option("header", True).csv(binned)

    seconds = {}
    for mode, flags in (("std", (False, True)), ("mean_std", (True, True))):
        run = preparation.scaling_run(spark, plain, with_mean=flags[0], with_std=flags[1])
        seconds[f"scaler_{mode}"] = round(run.result["timing"]["job_seconds"], 3)
    run, _ = preparation.zscore_run(spark, plain)
    seconds["zscore"] = round(run.result["timing"]["job_seconds"], 3)
    run = preparation.encoding_run(spark, binned)
    seconds["onehot_fitted"] = round(run.result["timing"]["job_seconds"], 3)
    run = preparation.fixed_encoding_run(spark, binned)
    seconds["onehot_fixed"] = round(run.result["timing"]["job_seconds"], 3)
    size = stored_bytes(spark, plain)
    print(f"rows {run.result['rows']} bytes {size}", file=sys.stderr)
    return seconds


def main() -> None:
    spark = local_session("bench", CPUS, memory="16g", shuffle_partitions=int(CPUS))
    seconds = bench_csv(spark, CSV_MB) if CSV_MB else bench_queries(spark)
    print(
        json.dumps(
            {
                "metric": f"csv_jobs_{CSV_MB}mb" if CSV_MB else "all_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": FOLDER.rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
