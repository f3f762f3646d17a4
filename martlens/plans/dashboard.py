"""The analysis page as a batch: one roll-up, many small reports.

All additive reports of the page depend on the fact only through sums per
(year, month, quarter, region, division, ship mode, product name).  Building
that roll-up once and writing it out makes every later filter choice a query
over a table that does not grow with the number of sales lines.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from martlens.operators.filters import ALL, dashboard_filter, has_rows
from martlens.operators.statistics import correlation_matrix
from martlens.plans import reports
from martlens.plans.star import Star
from martlens.sources.tables import materialize

DIMENSIONS = (
    "order_year", "order_month", "quarter", "region", "division", "target", "ship_mode",
    "product_name",
)
MEASURES = ("sales", "gross_profit", "units")
CORRELATED = (
    "sales", "units", "gross_profit", "cost", "unit_price", "unit_cost", "shipping_days",
)

REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "kpis": reports.kpi_dashboard,
    "monthly_trend": reports.monthly_trend,
    "month_year_pivot": reports.month_year_pivot,
    "annual_sales": reports.annual_sales,
    "region_sales": reports.region_sales,
    "division_share": lambda df: reports.sales_share(df, "division"),
    "top_products": lambda df: reports.top_products(df, 10),
    "target_achievement": reports.target_achievement,
    "ship_mode_share": lambda df: reports.sales_share(df, "ship_mode"),
    "product_profit": reports.product_profit,
    "yoy_growth": reports.yoy_growth,
    "quarter_season": reports.quarter_season,
    "region_leaders": reports.region_leaders,
    "transaction_share": reports.transaction_share,
}


def build_rollup(star: Star) -> DataFrame:
    """The sums all additive reports need, at their common granularity."""
    return star.rollup(DIMENSIONS, MEASURES)


def dashboard(
    rollup: DataFrame,
    years: Sequence[int] | None = None,
    region: str = ALL,
    division: str = ALL,
) -> dict[str, DataFrame]:
    """Every additive report for one filter choice; empty when nothing matches."""
    chosen = dashboard_filter(rollup, years, region, division)
    if not has_rows(chosen):
        return {}
    return {name: report(chosen) for name, report in REPORTS.items()}


def correlations(
    star: Star, years: Sequence[int] | None = None, region: str = ALL, division: str = ALL
) -> DataFrame:
    """The correlation matrix is not additive: it reads the filtered fact rows.

    It reads them twice, so the joins behind them run once into a written copy.
    """
    filters = {"order_year": years is not None, "region": region != ALL,
               "division": division != ALL}
    # the order date prunes the scan where a year taken from it cannot
    dated = "order_date" if years is not None and "order_date" in star.fact.columns else None
    extra = [c for c, used in filters.items() if used] + ([dated] if dated else [])
    df = star.select(*CORRELATED, *extra)
    chosen = dashboard_filter(df, years, region, division, dated).select(*CORRELATED)
    return correlation_matrix(materialize(chosen, "correlated"), CORRELATED)
