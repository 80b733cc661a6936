"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR  folder of the parquet tables (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidegrid.catalogue import QUERIES  # noqa: E402

HEADLINE = (
    "a1_dedupe_mean", "a2_calendar_mean", "j2_calendar_fill", "j5_station_pivot", "j7_origin_training_rows",
    "w1_zero_lag", "w5_moving_average_fill", "p5_final_feature_list", "e7_seasonal_naive", "g1_autocorrelation",
    "f1_rolling_ols", "f9_two_layer_sum", "f10_simple_smoothing", "f12_smoothing_with_trend",
    "backtest_rolling_window", "f14_additive_model", "f3_boosted_trees",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["e7_seasonal_naive"](spark, folder).write.format("noop").mode("overwrite").save()
    QUERIES["f9_two_layer_sum"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
