"""The data audit: every check of the cleaned sales table as one set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.operators import cleaning, integrity, profiling
from martlens.plans.star import Star
from martlens.sources.schemas import SALES_BUSINESS_COLUMNS, SALES_MEASURES


def clean_sales(sales: DataFrame) -> DataFrame:
    """Drop exact copies, then merge the lines of one order and product."""
    business = [c for c in SALES_BUSINESS_COLUMNS if c in sales.columns]
    return cleaning.consolidate_lines(cleaning.drop_exact_copies(sales, "row_id", business))


def audit(star: Star) -> dict[str, DataFrame]:
    """Named findings over the fact and its lookups.

    Lazy but for the quantiles behind the numeric summaries and the search for copies,
    which run jobs when called.
    """
    sales = star.fact
    tables = {"sales": sales, **{x.name: x.table for x in star.lookups}}
    lookups = {x.name: x.table for x in star.lookups}
    categorical = [
        c for c in ("region", "city", "division", "country", "ship_mode") if c in sales.columns
    ]
    found = {
        "shapes": profiling.table_shape(tables),
        "duplicate_orders": profiling.duplicate_keys(sales, "order_id"),
        "distinct_orders": profiling.distinct_count(sales, "order_id"),
        "copied_rows": profiling.duplicate_row_count(sales.drop("row_id")),
        "copied_products": profiling.duplicate_row_count(lookups["products"]),
        "missing_values": profiling.null_counts(sales),
        "missing_in_products": profiling.null_counts(lookups["products"]),
        "schema": profiling.schema_profile(sales),
        **{f"schema_{n}": profiling.schema_profile(df) for n, df in lookups.items()},
        "orphan_products": integrity.orphan_keys(sales, lookups["products"], "product_id"),
        "orphan_factories": integrity.orphan_keys(
            lookups["products"], lookups["factories"], "factory"
        ),
        "negative_sales": integrity.negative_rows(sales, "sales"),
        "negative_sales_or_cost": integrity.negative_rows(sales, "sales", "cost"),
        "nonpositive_units": integrity.nonpositive_rows(sales, "units"),
        "date_ranges": profiling.date_range(sales, ["order_date", "ship_date"]),
        "late_shipments": integrity.late_shipments(sales).orderBy(
            F.desc("years_to_ship"), "order_id"
        ),
        "broken_totals": integrity.rule_violations(sales).orderBy(F.desc("expected")),
        "value_frequency": profiling.value_frequency(sales, categorical),
        "name_variants": profiling.name_variants(sales, "product_id", "product_name").orderBy(
            "product_name", "product_id"
        ),
        "products_with_several_names": profiling.keys_with_several_names(
            sales, "product_id", "product_name"
        ),
        "numeric_summary": profiling.numeric_summary(sales, SALES_MEASURES),
        "describe": profiling.describe_numeric(sales, SALES_MEASURES),
    }
    if "row_id" in sales.columns:
        business = [c for c in SALES_BUSINESS_COLUMNS if c in sales.columns]
        found["exact_copies"] = cleaning.exact_copies(sales, "row_id", business)
    return found
