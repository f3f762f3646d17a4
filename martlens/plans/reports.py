"""Business reports.

Each report takes fact rows (merged or filtered) or a roll-up of them: sums
of sums are sums, and a roll-up's ``n_rows`` and ``n_<measure>`` columns stand
in for counting rows.  Rows with a missing group key are left out of a report,
and a group without any value sums to 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlens.functions.columns import (
    col,
    dollars,
    month_short_name,
    month_start,
    percent_or_zero,
    percent_text,
    present,
    ratio,
    round_half_even,
    row_count,
    thousands,
)
from martlens.operators.quantiles import exact_quantiles


def _total(df: DataFrame, measure: str) -> Column:
    return F.coalesce(F.sum(present(df, measure)), F.lit(0))


def _values(df: DataFrame, measure: str) -> Column:
    """How many rows carry the measure."""
    weight = f"n_{measure}"
    return F.sum(weight) if weight in df.columns else F.count(present(df, measure))


def totals_by(df: DataFrame, keys: Sequence[str], measure: str = "sales") -> DataFrame:
    """Sum of a measure per key combination, missing keys left out."""
    return (
        df.dropna(subset=list(keys))
        .groupBy(*[col(k) for k in keys])
        .agg(_total(df, measure).alias(measure))
    )


def share_of_total(totals: DataFrame, measure: str, name: str = "share") -> DataFrame:
    """Each group's part of the grand total, taken from a one-row subquery."""
    grand = totals.agg(F.sum(col(measure)).alias("grand")).scalar()
    return totals.withColumn(name, ratio(col(measure), grand))


# -- headline figures ---------------------------------------------------------


def kpi_headline(
    df: DataFrame,
    sales: DataFrame | None = None,
    approximate: bool = False,
    median: float | None = None,
) -> DataFrame:
    """Total, mean and median sale, transactions and the order date range.

    A median cannot be taken from a roll-up: ``sales`` are then the fact rows.  A
    ``median`` that is known already is not searched again.
    """
    if median is None:
        values = (df if sales is None else sales).select("sales")
        median = exact_quantiles(values, ["sales"], [0.5], approximate)["sales"][0]
    return df.agg(
        _total(df, "sales").alias("total_sales"),
        _values(df, "sales").alias("__n"),
        row_count(df).alias("n_transactions"),
        F.to_date(F.min("order_date")).alias("first_order"),
        F.to_date(F.max("order_date")).alias("last_order"),
    ).select(
        "total_sales",
        ratio("total_sales", "__n").alias("average_sale"),
        F.lit(median).cast("double").alias("median_sale"),
        "n_transactions",
        "first_order",
        "last_order",
    )


def kpi_dashboard(df: DataFrame) -> DataFrame:
    """Revenue, profit, units, mean sale per row and margin %, with their texts."""
    figures = df.agg(
        _total(df, "sales").alias("revenue"),
        _total(df, "gross_profit").alias("profit"),
        _total(df, "units").alias("units"),
        _values(df, "sales").alias("__n"),
    )
    figures = figures.select(
        "revenue",
        "profit",
        "units",
        ratio("revenue", "__n").alias("average_sale"),
        percent_or_zero("profit", "revenue").alias("margin_pct"),
    )
    return figures.withColumns(
        {
            "revenue_text": dollars("revenue"),
            "profit_text": dollars("profit"),
            "units_text": thousands("units"),
            "average_sale_text": dollars("average_sale"),
            "margin_text": percent_text("margin_pct"),
        }
    )


# -- time ---------------------------------------------------------------------


def monthly_trend(df: DataFrame) -> DataFrame:
    """Sales per month with the first day and the short name of the month."""
    return totals_by(df, ["order_year", "order_month"]).select(
        "order_year",
        "order_month",
        month_start("order_year", "order_month").alias("period"),
        month_short_name("order_month").alias("month_name"),
        "sales",
    )


def years_in(df: DataFrame) -> list[int]:
    """The calendar years present, a list as short as the data's history."""
    rows = df.select("order_year").dropna().distinct().orderBy("order_year").collect()
    return [r["order_year"] for r in rows]


def month_year_pivot(df: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """Months down, years across; a month without sales in a year is null."""
    years = list(years) if years is not None else years_in(df)
    sums = (
        df.dropna(subset=["order_month"])
        .groupBy("order_month")
        .pivot("order_year", years)
        .agg(F.sum(present(df, "sales")))
    )
    return sums.withColumnsRenamed({str(y): f"sales_{y}" for y in years})


def annual_sales(df: DataFrame) -> DataFrame:
    return totals_by(df, ["order_year"])


def yoy_growth(df: DataFrame) -> DataFrame:
    """Sales growth over the preceding calendar year; null without one.

    The window has no partition, over one row per calendar year.
    """
    by_year = Window.orderBy("order_year")
    previous = F.when(
        F.lag("order_year").over(by_year) == F.col("order_year") - 1,
        F.lag("sales").over(by_year),
    )
    return annual_sales(df).select(
        "order_year",
        "sales",
        previous.alias("previous_sales"),
        ratio(F.col("sales") - previous, previous).alias("growth"),
    )


def quarter_season(df: DataFrame) -> DataFrame:
    """Quarter sales ranked within their year, 1 being the strongest."""
    in_year = Window.partitionBy("order_year").orderBy(F.desc("sales"))
    return totals_by(df, ["order_year", "quarter"]).withColumn(
        "season_rank", F.rank().over(in_year)
    )


# -- groups -------------------------------------------------------------------


def region_sales(df: DataFrame) -> DataFrame:
    return totals_by(df, ["region"]).orderBy(F.desc("sales"), "region")


def region_leaders(df: DataFrame) -> DataFrame:
    """The leading and the smallest region in one row, ties by name."""
    totals = totals_by(df, ["region"])
    first = F.min(F.struct((-F.col("sales")).alias("key"), "region", "sales"))
    last = F.min(F.struct("sales", "region"))
    return totals.agg(first.alias("top"), last.alias("low")).select(
        F.col("top.region").alias("leading_region"),
        F.col("top.sales").alias("leading_sales"),
        F.col("low.region").alias("smallest_region"),
        F.col("low.sales").alias("smallest_sales"),
    )


def sales_share(df: DataFrame, key: str) -> DataFrame:
    """Sales and share of all sales per division, ship mode or other key."""
    return share_of_total(totals_by(df, [key]), "sales")


def transaction_share(df: DataFrame, key: str = "division") -> DataFrame:
    """Rows and share of all rows per key."""
    counted = (
        df.dropna(subset=[key]).groupBy(col(key)).agg(row_count(df).alias("n_transactions"))
    )
    return share_of_total(counted, "n_transactions")


def top_products(
    df: DataFrame, n: int, keys: Sequence[str] = ("product_name",)
) -> DataFrame:
    """The n best selling products, ties by key; a top-n per task, no full sort."""
    return totals_by(df, keys).orderBy(F.desc("sales"), *[col(k) for k in keys]).limit(n)


def product_profit(df: DataFrame) -> DataFrame:
    return totals_by(df, ["product_name"], "gross_profit").orderBy(
        F.desc("gross_profit"), "product_name"
    )


def target_achievement(df: DataFrame) -> DataFrame:
    """Sales against target per division; the target repeats on every row."""
    return (
        df.dropna(subset=["division"])
        .groupBy("division")
        .agg(_total(df, "sales").alias("total_sales"), F.max("target").alias("target"))
        .withColumn(
            "achievement_pct", round_half_even(ratio("total_sales", "target") * 100, 1)
        )
    )
