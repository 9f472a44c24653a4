"""Time the headline queries on one folder of tables and print one JSON line.

BENCH_SF_DIR names the folder, BENCH_CPUS the local threads, BENCH_WORK_DIR the folder to write to. Every query runs in full into Spark's noop
sink: once to warm up, then BENCH_RUNS times, of which the median counts.
"""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from shelfmark.plans import QUERIES
from shelfmark.settings import session_settings

HEADLINE = [
    "menu_listing", "category_menu", "item_position", "admin_listing", "admin_order", "text_search", "items_per_category",
    "orphan_items", "update_patch", "upsert", "seed_load", "constraint_check", "authorize_changes", "state_as_of",
    "change_apply", "refresh_affected", "snapshot_latest_valid", "secret_scan", "strip_tags", "slugify",
]


def run(spark, name, folder):
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench") \
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    if os.environ.get("BENCH_WORK_DIR"):
        builder = builder.config("spark.checkpoint.dir", os.environ["BENCH_WORK_DIR"])
    for key, value in session_settings(cpus).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        run(spark, name, folder)
        seconds[name] = round(statistics.median(run(spark, name, folder) for _ in range(runs)), 3)
    print(json.dumps({"metric": "headline queries, median seconds summed", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
