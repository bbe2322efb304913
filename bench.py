"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR   tables to read (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default: all)
BENCH_QUERIES  names separated by commas, or `all` for every registered query
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.queries import registered
from tradewind.session import build_session

HEADLINE = [
    "fact_transactions", "enrich_transactions", "clean_users", "clean_inventory", "agg_funnel_monthly",
    "profile_tables", "session_time_checks", "foreign_key_checks", "scope_reconciliation", "bot_candidates",
    "rfm", "cohort_retention", "status_leakage", "annual_revenue", "category_performance", "funnel",
    "journey_by_source", "basket_affinity", "price_band_performance", "inventory_abc_aging", "fulfillment",
    "root_cause_proxy", "transaction_kpis", "customer_table", "customer_value_segments", "product_categories",
    "sessions", "session_funnel", "inventory_by_center", "returns_by_delivery_time", "revenue_forecast",
    "seasonal_naive_forecast", "rule_clusters", "forecast_top_categories",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    chosen = os.environ.get("BENCH_QUERIES", "")
    queries = registered()
    names = list(queries) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__python__sql__dataFrameDebugging__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("annual_revenue")  # starts the JVM's caches and compilers
    seconds = {name: round(run(name), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
