"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR: tables (default /root/testdata/sf0.1); BENCH_CPUS: local cores (default 8).
"""

from __future__ import annotations

import json
import os
import re
import time

from tillvault.plans.catalog import catalog
from tillvault.plans.session import local_session

HEADLINES = (
    "stage_articles",
    "hub_touch_articles",
    "sat_history_articles",
    "sat_bulk_supplier_articles",
    "journal_positions",
    "journal_anti_load",
    "receipts",
    "leading_position",
    "calendar",
    "months",
    "asof_sale",
    "inventory_articles",
    "card_mix",
    "month_totals",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(cpus=int(os.environ.get("BENCH_CPUS", "8")))
    queries = catalog()
    seconds = {}
    # One untimed run: JVM start and class loading belong to no query.
    queries["months"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINES:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )


if __name__ == "__main__":
    main()
