"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores, BENCH_QUERIES
an optional comma-separated choice ("all" for every registered query).
"""

from __future__ import annotations

import json
import os
import time

from martlens.session import build_session
from martlens.testbed.catalog import QUERIES

HEADLINE = (
    "enrich_star", "monthly_trend", "month_year_pivot", "yoy_growth", "quarter_season",
    "region_sales", "division_share", "top5_products", "target_achievement", "kpi_headline",
    "kpi_dashboard", "kpi_filtered", "filter_dashboard", "null_audit", "duplicate_keys",
    "orphan_facts", "late_shipments", "rule_tolerance", "consolidate_lines", "exact_dedup",
    "numeric_summary", "describe_numeric", "correlation_matrix", "iqr_outliers", "histogram",
    "standardize", "ols_metrics", "kfold_r2", "kfold_r2_multi", "forest_metrics",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000).selectExpr("sum(id)").collect()  # start the executor threads
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf_dir.rstrip("/").rsplit("sf", 1)[-1]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
