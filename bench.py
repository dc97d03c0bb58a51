"""Runs headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tessella import catalogue

HEADLINE = (
    "filter_range", "filter_in", "order_limit", "keyset_after", "count_filtered", "exists_filtered", "agg_group", "agg_having", "agg_where_group",
    "join_inner", "join_left", "rel_some", "rel_every", "in_subquery", "set_union", "cte", "json_compare", "array_contains",
    "include_list", "include_one", "include_take", "include_nested", "include_through", "upsert_update", "delete_cascade", "prepared_rebind",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(3):
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(sorted(times)[1], 4)
    print(json.dumps({"metric": "headline queries, median of 3, sum", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
