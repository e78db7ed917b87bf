"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR: folder of tables, BENCH_CPUS: cores, BENCH_RUNS: warm runs per query.
"""

import contextlib
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from fleetmeter.session import build_session  # noqa: E402

HEADLINE = [
    "trend_asset_day",
    "trend_asset_month",
    "trend_category_week",
    "cost_vs_hours",
    "kpi_assets",
    "category_distribution",
    "options_product",
    "consumption_agg",
    "join_consume_assignment",
    "service_events_matched",
    "service_interval",
    "status_report",
    "top10_needed_service",
    "tfidf_terms",
    "default_selection",
    "product_subcategory",
]


def timed(spark, folder, name):
    begin = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    with contextlib.redirect_stdout(sys.stderr):
        spark = build_session(
            "bench", f"local[{cpus}]", cpus,
            {
                "spark.ui.enabled": "false",
                "spark.ui.showConsoleProgress": "false",
                "spark.driver.memory": "8g",
                "spark.driver.extraJavaOptions": "-XX:+UseParallelGC -XX:+AlwaysPreTouch -Xms8g",
            },
        )
        spark.sparkContext.setLogLevel("ERROR")
        times = {}
        for name in HEADLINE:
            timed(spark, folder, name)
            times[name] = round(
                statistics.median(timed(spark, folder, name) for _ in range(runs)), 3
            )
            print(name, times[name], file=sys.stderr, flush=True)
        spark.stop()
    print(json.dumps({
        "metric": "median warm seconds, summed over the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
