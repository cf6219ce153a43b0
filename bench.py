"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the cores.
Each query is built and run to a sink that discards rows, so the whole result is computed but none
of it travels to the driver.
"""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

HEADLINE = (
    "a01_jevons",
    "a05_tornqvist_monthly",
    "a06_geks_tornqvist",
    "a07_time_product_dummy",
    "a09_hedonic_time_dummy",
    "a12_route_index",
    "a16_series_hierarchy",
    "a18_coverage",
    "a19_quality_gates",
    "a23_lead_time_curve",
    "a24_route_fare_series",
    "a26_backtest_scores",
    "a29_movement_decomposition",
    "a30_bridge_nowcast",
    "j11_asof_decision",
    "p02_decompose_fares",
    "p08_cleaning_run",
    "p16_content_hash",
    "s07_nested_json",
    "s09_html_cards",
    "s10_drifted_payloads",
    "w01_latest_vintage",
    "w03_surges",
    "w05_outlier_flags",
    "w10_flight_key",
    "w15_published_values",
)


def session(cpus: str):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quotemill-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str]) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = argv or HEADLINE
    with contextlib.redirect_stdout(sys.stderr):
        from quotemill.catalog import load_all

        spark = session(os.environ.get("BENCH_CPUS", "8"))
        queries = load_all().QUERIES
        # the engine's own start-up (class loading, first Python worker) is not a query
        spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count().write.format("noop").mode("overwrite").save()
        times: dict[str, float] = {}
        for name in names:
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        spark.stop()
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main(sys.argv[1:])
