"""Time the headline queries; print one JSON line.

Environment: BENCH_SF_DIR (tables, default /root/testdata/sf0.1), BENCH_CPUS (local cores, default 8),
BENCH_QUERIES (comma-separated names, default the headline list).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "clean_transactions", "daily_product_sales", "daily_product_panel", "stock_features", "demand_panel",
    "demand_features", "sales_features", "fva_by_horizon", "direct_horizon_backtest", "loyalty_segments",
    "svd_topk", "pair_counts", "item_similarity", "association_rules", "content_neighbors_topk",
    "tag_compatibility", "branch_trending", "branch_popularity", "personalized_topk",
    "hybrid_recommend_product", "hybrid_recommend_customer", "replenishment_plan", "calibrated_curve",
    "price_choice", "demand_gates", "rec_quality_checks", "sales_summary", "model_bakeoff",
    "recursive_revenue_forecast", "stream_daily_sales",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE

    from shelfline.plans import QUERIES, load_all
    from shelfline.session import build_session

    load_all()
    spark = build_session("bench", f"local[{cpus}]", shuffle_partitions=2 * cpus, driver_memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    # start-up of the JVM, the code generator and the Python workers is not part of any query
    QUERIES["top_sold_products"](spark, folder).write.format("noop").mode("overwrite").save()

    seconds: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in names:
        start = time.perf_counter()
        try:
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        except Exception as error:  # noqa: BLE001 - one failing query must not hide the others
            failed[name] = f"{type(error).__name__}: {str(error)[:200]}"
        print(f"{name}: {seconds.get(name, 'failed')}", file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    result = {
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus,
    }
    if failed:
        result["failed"] = failed
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
