"""Time the named queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 1) and
BENCH_QUERIES (comma-separated names, or "all") set it up; by default the further results of jobs
that are timed anyway are left out. Each figure is the median of the runs; a first unrecorded
query warms the session.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallybook.plans import registry  # noqa: E402
from tallybook.plans.layouts import MONTHLY  # noqa: E402
from tallybook.session import get_spark  # noqa: E402

FURTHER_RESULTS = {
    "append_rows",
    "insert_rows_rejected",
    "insert_recipe_ingredients",
    "insert_recipes_rejected",
    "revise_recipe_ingredients",
    "revise_recipes_rejected",
    "intake_new_customers",
    "intake_shortages",
    "order_intake_tables",
    "stream_recipe_counts_replayed",
    "intake_new_customers_kept",
    "revise_orders_items",
    "revise_orders_ledger",
    "revise_orders_rejected",
}


def run_once(name, spark, sf_dir):
    start = time.perf_counter()
    registry.run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = os.environ.get("BENCH_QUERIES")
    # A report of a table laid out anew each time is timed by the layout; one of them tells that.
    laid_out = {f"{name}_monthly" for name in MONTHLY[1:]}
    names = [n for n in registry.QUERIES if n not in FURTHER_RESULTS | laid_out]
    if wanted:
        names = list(registry.QUERIES) if wanted == "all" else wanted.split(",")
    spark = get_spark(
        "tallybook-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "20g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    run_once("top_products", spark, sf_dir)
    seconds = {
        name: round(statistics.median(run_once(name, spark, sf_dir) for _ in range(runs)), 3)
        for name in names
    }
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
