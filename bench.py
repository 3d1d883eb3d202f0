"""Times the headline queries and prints one JSON line.

Reads ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.  Every query runs once to warm up and then
twice; its time is the mean of the two, from building the query to its last row.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from tablewright_queries import REGISTRY

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 2
HEADLINE = (
    "chart_sum",
    "chart_sum_filtered",
    "chart_series",
    "chart_histogram",
    "chart_capped",
    "chart_top_n",
    "chart_series_many",
    "chart_line_points",
    "dashboard_filtered",
    "clean_pipeline",
    "clean_dedupe",
    "clean_distinct",
    "clean_cast",
    "profile_columns",
    "profile_outliers",
    "profile_duplicates",
    "profile_samples",
    "profile_sampled",
    "profile_columns_wide",
    "profile_infer_types",
    "row_count",
    "page_sorted",
    "page_ordinal",
    "src_import",
    "src_csv",
    "src_csv_reordered",
    "src_json",
    "src_json_array",
    "export_csv",
    "revision_lineage",
)


def seconds(spark: SparkSession, name: str) -> float:
    start = time.perf_counter()
    REGISTRY[name].run(spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        seconds(spark, name)
        times[name] = round(statistics.mean(seconds(spark, name) for _ in range(RUNS)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, mean of 2 warm runs",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": FOLDER.rstrip("/").rsplit("/sf", 1)[-1],
                "cpus": CPUS,
            }
        )
    )


if __name__ == "__main__":
    main()
