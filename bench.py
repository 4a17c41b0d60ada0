"""Times the headline queries (one warm-up run, then one timed run each, into the noop sink) and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tessera.plans.catalogue import QUERIES

HEADLINE = ("flagship_segment_stats", "group_sum_avg_min_max_median", "join_left", "join_right_uniq_last", "group_fold_unfold", "top_n_by", "stat_profile", "add_sum_share", "enumerate_orders", "norm_text", "ser_smooth", "ser_linear_interp", "window_tumbling")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf.rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
