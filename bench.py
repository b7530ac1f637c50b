"""Benchmark the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]``: one warm-up, then the median of ``$BENCH_REPS``
(default 3) timed runs. The action is ``write.format("noop")``, which
executes the whole plan without collecting rows to the driver.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vendorlytics import registry  # noqa: E402
from vendorlytics.session import get_session  # noqa: E402

HEADLINE = [
    "vendor_dashboard", "sales_summary", "top_products", "recent_sales", "daily_revenue_7d",
    "sales_history_page", "catalog_search", "catalog_not_in_inventory", "vendor_inventory", "storefront",
    "client_statement", "overdue_push_targets", "dedup_inventory", "constraint_violations",
    "stock_ledger", "sale_register", "instalment_ledger", "inventory_admission", "inventory_patch",
    "catalog_create", "client_admission", "subscription_state", "pending_payment_match",
    "rate_limit_violations", "payment_error_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(os.environ.get("BENCH_PARTITIONS", cpus)))
    qs = registry.queries()
    times, failed = {}, {}
    for name in names:
        def run():
            t0 = time.perf_counter()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0
        try:
            run()
            times[name] = round(statistics.median(run() for _ in range(reps)), 3)
            print(f"# {name}: {times[name]}s", file=sys.stderr)
        except Exception as e:  # noqa: BLE001 - report and keep measuring the rest
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
            print(f"# {name}: FAILED {failed[name]}", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3),
           "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else None}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
