"""Enrichment, filters, reports and statistics over the test tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.functions.columns import is_year_end, month_short_name, month_start
from martlens.operators import statistics
from martlens.operators.filters import dashboard_filter, filter_options, has_rows
from martlens.plans import dashboard, reports
from martlens.plans.star import retail_star
from martlens.session import scratch_path
from martlens.sources.tables import materialize, save_table
from martlens.testbed.bindings import (
    LINE_KEYS,
    input_tables,
    sales_lines,
    star,
    table,
    with_profit,
)
from martlens.testbed.registry import finish, register

# -- enrichment ---------------------------------------------------------------


@register(
    "enrich_star",
    """
    SELECT order_id, product_id, line_no, factory_id, strftime(ship_date, '%Y-%m-%d') AS ship_date,
           round(sales, 2) AS sales, round(units, 2) AS units,
           round(gross_profit, 4) AS gross_profit, round(cost, 4) AS cost, customer_id,
           strftime(order_date, '%Y-%m-%d') AS order_date, ship_mode, order_year, order_month,
           order_day, order_weekday, quarter, country_id, country, region_id, region, division,
           product_name, round(unit_price, 4) AS unit_price, round(unit_cost, 4) AS unit_cost,
           factory, target, shipping_days
    FROM star
    """,
    star=True,
)
def enrich_star(spark, sf_dir):
    """Every fact row with every lookup column and feature.

    The joins shuffle the lean star: profit, cost and calendar follow from what it has.
    """
    merged = with_profit(star(spark, sf_dir, lean=True).merged())
    return finish(merged.select(*star(spark, sf_dir).merged().columns), sales=2, units=2)


@register(
    "merge_tables",
    """
    , f AS (SELECT p_brand, avg(p_size) AS latitude, avg(p_retailprice) AS longitude
            FROM part GROUP BY p_brand)
    SELECT s.order_id, s.product_id, s.line_no, s.division, s.product_name, s.region,
           round(s.sales, 2) AS sales, p.p_brand AS factory,
           round(p.p_retailprice, 4) AS unit_price,
           round(p.p_retailprice - p.p_size, 4) AS unit_cost, round(f.latitude, 4) AS latitude,
           round(f.longitude, 4) AS longitude, s.target, s.order_year, s.order_month,
           s.order_day, s.order_weekday, s.quarter, s.shipping_days
    FROM star s
    LEFT JOIN part p ON s.product_id = p.p_partkey AND s.product_name = p.p_name
                    AND s.division = p.p_type
    LEFT JOIN f ON p.p_brand = f.p_brand
    """,
    star=True,
)
def merge_tables(spark, sf_dir):
    """The four input tables merged: products by three keys, then factory, then target."""
    tables = input_tables(spark, sf_dir)
    merged = retail_star(**tables).merged()
    unused = ("order_date", "ship_date", "ship_mode", "units", "gross_profit", "cost")
    return finish(merged.drop(*unused), sales=2)


@register(
    "month_period",
    """
    SELECT DISTINCT order_year, order_month,
           strftime(make_date(order_year, order_month, 1), '%Y-%m-%d') AS period,
           strftime(make_date(order_year, order_month, 1), '%b') AS month_name,
           CASE WHEN order_month = 12 THEN 1 ELSE 0 END::BIGINT AS is_year_end
    FROM (SELECT year(o_orderdate) AS order_year, month(o_orderdate) AS order_month FROM orders)
    """,
)
def month_period(spark, sf_dir):
    months = (
        table(spark, sf_dir, "orders")
        .select(F.year("o_orderdate").alias("order_year"),
                F.month("o_orderdate").alias("order_month"))
        .distinct()
    )
    return finish(
        months.withColumns(
            {
                "period": month_start("order_year", "order_month"),
                "month_name": month_short_name("order_month"),
                "is_year_end": is_year_end("order_month"),
            }
        )
    )


# -- filters ------------------------------------------------------------------

_FILTERED = (
    "order_id", "product_id", "line_no", "order_date", "order_year", "region", "division", "sales",
)


@register(
    "filter_dashboard",
    """
    SELECT order_id, product_id, line_no, strftime(order_date, '%Y-%m-%d') AS order_date,
           order_year, region, division, round(sales, 2) AS sales
    FROM star WHERE order_year IN (1996, 1997) AND region = 'ASIA' AND division = 'PROMO'
    """,
    star=True,
)
def filter_dashboard(spark, sf_dir):
    lines = star(spark, sf_dir).select(*_FILTERED)
    return finish(dashboard_filter(lines, [1996, 1997], "ASIA", "PROMO", "order_date"), sales=2)


@register(
    "filter_empty",
    """
    SELECT count(*) AS n_rows, CAST(count(*) > 0 AS VARCHAR) AS has_rows
    FROM star WHERE order_year = 1900 AND region = 'ASIA'
    """,
    star=True,
)
def filter_empty(spark, sf_dir):
    """A choice that nothing matches, and the guard that says so."""
    chosen = dashboard_filter(star(spark, sf_dir).select(*_FILTERED), [1900], "ASIA")
    return chosen.agg(
        F.count("*").alias("n_rows"), F.lit(str(has_rows(chosen)).lower()).alias("has_rows")
    )


@register(
    "filter_saved",
    """
    SELECT order_id, product_id, line_no, strftime(order_date, '%Y-%m-%d') AS order_date,
           order_year, region, division, round(sales, 2) AS sales
    FROM star WHERE order_year IN (1996, 1997) AND region = 'ASIA'
    """,
    star=True,
)
def filter_saved(spark, sf_dir):
    """The merged lines saved by order year: a choice of years reads their folders only."""
    name = f"merged_{uuid.uuid4().hex}"
    lines = star(spark, sf_dir).select(*_FILTERED)
    saved = save_table(lines, name, scratch_path(spark, "merged"), ["order_year"])
    return finish(dashboard_filter(saved, [1996, 1997], "ASIA"), sales=2)


@register(
    "filter_options",
    """
    SELECT DISTINCT 'order_year' AS column_name, CAST(order_year AS VARCHAR) AS value FROM star
    UNION ALL SELECT DISTINCT 'region', region FROM star WHERE region IS NOT NULL
    UNION ALL SELECT DISTINCT 'division', division FROM star WHERE division IS NOT NULL
    """,
    star=True,
)
def options(spark, sf_dir):
    columns = ["order_year", "region", "division"]
    return filter_options(star(spark, sf_dir).rollup(columns, []), columns)


# -- headline figures ---------------------------------------------------------


@register(
    "kpi_headline",
    """
    SELECT round(sum(sales), 2) AS total_sales, round(avg(sales), 4) AS average_sale,
           round(median(sales), 4) AS median_sale, count(*) AS n_transactions,
           strftime(min(order_date), '%Y-%m-%d') AS first_order,
           strftime(max(order_date), '%Y-%m-%d') AS last_order
    FROM star
    """,
    star=True,
)
def kpi_headline(spark, sf_dir):
    rolled = star(spark, sf_dir).rollup(["order_date"], ["sales"])
    return finish(reports.kpi_headline(rolled, sales_lines(spark, sf_dir)), total_sales=2)


_KPI_SQL = """
    SELECT round(sum(sales), 2) AS revenue, round(sum(gross_profit), 4) AS profit,
           round(sum(units), 2) AS units, round(avg(sales), 4) AS average_sale,
           round(sum(gross_profit) / sum(sales) * 100, 4) AS margin_pct,
           format('${:,.2f}', sum(sales)) AS revenue_text,
           format('${:,.2f}', sum(gross_profit)) AS profit_text,
           format('{:,}', CAST(sum(units) AS BIGINT)) AS units_text,
           format('${:,.2f}', avg(sales)) AS average_sale_text,
           format('{:.1f}', sum(gross_profit) / sum(sales) * 100) || '%' AS margin_text
    FROM star
    """


@register("kpi_dashboard", _KPI_SQL, star=True)
def kpi_dashboard(spark, sf_dir):
    return finish(reports.kpi_dashboard(sales_lines(spark, sf_dir)), revenue=2, units=2)


_CHOICE = "order_year IN (1996, 1997) AND region = 'ASIA' AND division = 'PROMO'"


@register("kpi_filtered", _KPI_SQL + f"WHERE {_CHOICE}", star=True)
def kpi_filtered(spark, sf_dir):
    """The dashboard figures of one filter choice, straight from the fact."""
    lines = star(spark, sf_dir).select(*_FILTERED, "gross_profit", "units")
    chosen = dashboard_filter(lines, [1996, 1997], "ASIA", "PROMO", "order_date")
    return finish(reports.kpi_dashboard(chosen), revenue=2, units=2)


# report -> (key columns as one text in SQL, measure)
_PAGE = {
    "monthly_trend": ("order_year || '-' || order_month", "sales"),
    "region_sales": ("region", "sales"),
    "division_share": ("division", "sales"),
    "ship_mode_share": ("ship_mode", "sales"),
    "product_profit": ("product_name", "gross_profit"),
    "quarter_season": ("order_year || '-' || quarter", "sales"),
}
_PAGE_KEYS = {
    "monthly_trend": ("order_year", "order_month"),
    "region_sales": ("region",),
    "division_share": ("division",),
    "ship_mode_share": ("ship_mode",),
    "product_profit": ("product_name",),
    "quarter_season": ("order_year", "quarter"),
}


@register(
    "dashboard_page",
    " UNION ALL ".join(
        f"SELECT '{name}' AS report, CAST({label} AS VARCHAR) AS label, "
        f"round(sum({measure}), 4) AS amount FROM star "
        "WHERE order_year IN (1996, 1997, 1998) AND region = 'ASIA' GROUP BY label"
        for name, (label, measure) in _PAGE.items()
    ),
    star=True,
)
def dashboard_page(spark, sf_dir):
    """The page's reports for one filter choice, from a roll-up written once."""
    rollup = materialize(dashboard.build_rollup(star(spark, sf_dir)), "rollup")
    page = dashboard.dashboard(rollup, [1996, 1997, 1998], "ASIA")
    parts = [
        page[name].select(
            F.lit(name).alias("report"),
            F.concat_ws("-", *keys).alias("label"),
            F.round(_PAGE[name][1], 4).alias("amount"),
        )
        for name, keys in _PAGE_KEYS.items()
    ]
    return reduce(DataFrame.unionByName, parts)


# -- reports ------------------------------------------------------------------


def _rolled(spark, sf_dir, *by, sums=("sales",)):
    return star(spark, sf_dir).rollup(by, sums)


@register(
    "monthly_trend",
    """
    SELECT order_year, order_month,
           strftime(make_date(order_year, order_month, 1), '%Y-%m-%d') AS period,
           strftime(make_date(order_year, order_month, 1), '%b') AS month_name,
           round(sum(sales), 2) AS sales
    FROM star GROUP BY order_year, order_month
    """,
    star=True,
)
def monthly_trend(spark, sf_dir):
    rolled = _rolled(spark, sf_dir, "order_year", "order_month")
    return finish(reports.monthly_trend(rolled), sales=2)


@register(
    "month_year_pivot",
    "SELECT order_month, "
    + ", ".join(
        f"round(sum(sales) FILTER (WHERE order_year = {y}), 2) AS sales_{y}"
        for y in range(1995, 2002)
    )
    + " FROM star GROUP BY order_month",
    star=True,
)
def month_year_pivot(spark, sf_dir):
    rolled = _rolled(spark, sf_dir, "order_year", "order_month")
    years = reports.years_in(
        table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("order_year"))
    )
    return finish(reports.month_year_pivot(rolled, years), **{f"sales_{y}": 2 for y in years})


@register(
    "annual_sales",
    "SELECT order_year, round(sum(sales), 2) AS sales FROM star GROUP BY order_year",
    star=True,
)
def annual_sales(spark, sf_dir):
    return finish(reports.annual_sales(_rolled(spark, sf_dir, "order_year")), sales=2)


@register(
    "yoy_growth",
    """
    , annual AS (SELECT order_year, sum(sales) AS sales FROM star GROUP BY order_year)
    SELECT order_year, round(sales, 2) AS sales,
           round(lag(sales) OVER (ORDER BY order_year), 2) AS previous_sales,
           round((sales - lag(sales) OVER (ORDER BY order_year))
                 / lag(sales) OVER (ORDER BY order_year), 6) + 0.0 AS growth
    FROM annual
    """,
    star=True,
)
def yoy_growth(spark, sf_dir):
    grown = reports.yoy_growth(_rolled(spark, sf_dir, "order_year"))
    return finish(grown, sales=2, previous_sales=2, growth=6)


@register(
    "quarter_season",
    """
    , q AS (SELECT order_year, quarter, sum(sales) AS sales FROM star GROUP BY order_year, quarter)
    SELECT order_year, quarter, round(sales, 2) AS sales,
           rank() OVER (PARTITION BY order_year ORDER BY sales DESC) AS season_rank
    FROM q
    """,
    star=True,
)
def quarter_season(spark, sf_dir):
    rolled = _rolled(spark, sf_dir, "order_year", "quarter")
    return finish(reports.quarter_season(rolled), sales=2)


@register(
    "region_sales",
    "SELECT region, round(sum(sales), 2) AS sales FROM star WHERE region IS NOT NULL "
    "GROUP BY region",
    star=True,
)
def region_sales(spark, sf_dir):
    return finish(reports.region_sales(_rolled(spark, sf_dir, "region")), sales=2)


@register(
    "region_leaders",
    """
    , g AS (SELECT region, sum(sales) AS sales FROM star WHERE region IS NOT NULL GROUP BY region)
    SELECT (SELECT region FROM g ORDER BY sales DESC, region LIMIT 1) AS leading_region,
           (SELECT round(max(sales), 2) FROM g) AS leading_sales,
           (SELECT region FROM g ORDER BY sales, region LIMIT 1) AS smallest_region,
           (SELECT round(min(sales), 2) FROM g) AS smallest_sales
    """,
    star=True,
)
def region_leaders(spark, sf_dir):
    leaders = reports.region_leaders(_rolled(spark, sf_dir, "region"))
    return finish(leaders, leading_sales=2, smallest_sales=2)


def _share_sql(key: str, amount: str, name: str) -> str:
    return f"""
    SELECT {key}, round({amount}, 2) AS {name},
           round({amount} / sum({amount}) OVER (), 6) AS share
    FROM star WHERE {key} IS NOT NULL GROUP BY {key}
    """


@register("division_share", _share_sql("division", "sum(sales)", "sales"), star=True)
def division_share(spark, sf_dir):
    shares = reports.sales_share(_rolled(spark, sf_dir, "division"), "division")
    return finish(shares, sales=2, share=6)


@register("shipmode_share", _share_sql("ship_mode", "sum(sales)", "sales"), star=True)
def shipmode_share(spark, sf_dir):
    shares = reports.sales_share(_rolled(spark, sf_dir, "ship_mode"), "ship_mode")
    return finish(shares, sales=2, share=6)


@register(
    "transaction_share",
    """
    SELECT division, count(*) AS n_transactions,
           round(count(*) / sum(count(*)) OVER (), 6) AS share
    FROM star WHERE division IS NOT NULL GROUP BY division
    """,
    star=True,
)
def transaction_share(spark, sf_dir):
    shares = reports.transaction_share(_rolled(spark, sf_dir, "division"))
    return finish(shares, share=6)


@register(
    "top5_products",
    """
    SELECT product_id, product_name, round(sum(sales), 2) AS sales FROM star
    GROUP BY product_id, product_name
    ORDER BY sum(sales) DESC, product_id, product_name LIMIT 5
    """,
    star=True,
)
def top5_products(spark, sf_dir):
    rolled = _rolled(spark, sf_dir, "product_id", "product_name")
    return finish(reports.top_products(rolled, 5, ["product_id", "product_name"]), sales=2)


@register(
    "top10_products",
    """
    SELECT product_name, round(sum(sales), 2) AS sales FROM star
    GROUP BY product_name ORDER BY sum(sales) DESC, product_name LIMIT 10
    """,
    star=True,
)
def top10_products(spark, sf_dir):
    rolled = _rolled(spark, sf_dir, "product_name")
    return finish(reports.top_products(rolled, 10), sales=2)


@register(
    "product_profit",
    "SELECT product_name, round(sum(gross_profit), 4) AS gross_profit FROM star "
    "GROUP BY product_name",
    star=True,
)
def product_profit(spark, sf_dir):
    rolled = _rolled(spark, sf_dir, "product_name", sums=("gross_profit",))
    return finish(reports.product_profit(rolled))


@register(
    "target_achievement",
    """
    SELECT division, round(sum(sales), 2) AS total_sales, max(target) AS target,
           round_even(sum(sales) / max(target) * 100, 1) AS achievement_pct
    FROM star WHERE division IS NOT NULL GROUP BY division
    """,
    star=True,
)
def target_achievement(spark, sf_dir):
    rolled = _rolled(spark, sf_dir, "division", "target")
    return finish(reports.target_achievement(rolled), total_sales=2)


# -- statistics ---------------------------------------------------------------

_CORRELATED = dashboard.CORRELATED


@register(
    "correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM star"
        for a in _CORRELATED
        for b in _CORRELATED
    ),
    star=True,
)
def correlation_matrix(spark, sf_dir):
    return finish(dashboard.correlations(star(spark, sf_dir)), r=6)


@register(
    "correlation_filtered",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 2) + 0.0 AS r FROM star "
        "WHERE order_year IN (1996, 1997) AND region = 'ASIA'"
        for a in _CORRELATED
        for b in _CORRELATED
    ),
    star=True,
)
def correlation_filtered(spark, sf_dir):
    """The heat map of one filter choice, to two places."""
    matrix = dashboard.correlations(star(spark, sf_dir), [1996, 1997], "ASIA")
    return finish(matrix, r=2)


_QUARTILE_CTE = """, q AS (
      SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2,
             quantile_cont({c}, 0.75) AS q3 FROM {t}),
    f AS (SELECT q1, q2, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
"""
_EVENT_FENCES = "WITH " + _QUARTILE_CTE.format(c="value", t="events").lstrip(", ")


@register(
    "quartiles",
    """
    SELECT round(quantile_cont(sales, 0.25), 4) AS q1, round(quantile_cont(sales, 0.5), 4) AS q2,
           round(quantile_cont(sales, 0.75), 4) AS q3, count(sales) AS n FROM star
    """,
    star=True,
)
def quartiles(spark, sf_dir):
    lines = sales_lines(spark, sf_dir).select("sales")
    q1, q2, q3 = statistics.quartiles(lines, "sales")
    return finish(
        lines.agg(F.count("sales").alias("n")).select(
            *[F.lit(q).alias(name) for q, name in ((q1, "q1"), (q2, "q2"), (q3, "q3"))], "n"
        )
    )


@register(
    "iqr_outliers",
    _EVENT_FENCES
    + """SELECT event_id, user_id, event_type, round(value, 2) AS value FROM events
    WHERE value < (SELECT lo FROM f) OR value > (SELECT hi FROM f)""",
)
def iqr_outliers(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return finish(statistics.iqr_outliers(events, "value"), value=2)


@register(
    "box_stats",
    _EVENT_FENCES
    + """SELECT round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3,
           round(lo, 6) AS lower, round(hi, 6) AS upper,
           (SELECT round(min(value), 6) FROM events WHERE value >= lo AND value <= hi)
             AS whisker_low,
           (SELECT round(max(value), 6) FROM events WHERE value >= lo AND value <= hi)
             AS whisker_high,
           (SELECT count(*) FROM events WHERE value < lo OR value > hi) AS n_outliers,
           (SELECT count(value) FROM events) AS n_rows
    FROM f""",
)
def box_stats(spark, sf_dir):
    box = statistics.box_stats(table(spark, sf_dir, "events"), "value")
    return finish(box, **dict.fromkeys(box.columns, 6))


@register(
    "histogram",
    """
    WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
    b AS (SELECT least(CAST(floor((l_extendedprice - lo) / ((hi - lo) / 30)) AS BIGINT) + 1, 30)
            AS bin, lo, hi FROM lineitem, e)
    SELECT bin, round(any_value(lo) + (bin - 1) * ((any_value(hi) - any_value(lo)) / 30), 4)
             AS bin_low,
           round(any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / 30), 4) AS bin_high,
           count(*) AS n
    FROM b GROUP BY bin
    """,
)
def histogram(spark, sf_dir):
    return finish(statistics.histogram(sales_lines(spark, sf_dir), "sales", 30))


@register(
    "scatter_bins",
    """
    WITH e AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1,
                      min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem)
    SELECT least(CAST(floor((l_quantity - x0) * 20 / (x1 - x0)) AS BIGINT) + 1, 20) AS x_bin,
           least(CAST(floor((l_extendedprice - y0) * 20 / (y1 - y0)) AS BIGINT) + 1, 20) AS y_bin,
           count(*) AS n
    FROM lineitem, e GROUP BY x_bin, y_bin
    """,
)
def scatter_bins(spark, sf_dir):
    return statistics.scatter_bins(sales_lines(spark, sf_dir), "units", "sales", 20)


@register(
    "scatter_pairs",
    "SELECT round(l_quantity, 2) AS x, round(l_extendedprice, 2) AS y FROM lineitem",
)
def scatter_pairs(spark, sf_dir):
    pairs = statistics.scatter_pairs(sales_lines(spark, sf_dir), "units", "sales")
    return finish(pairs, x=2, y=2)


@register(
    "sample_pairs",
    """
    SELECT order_id, product_id, line_no, round(units, 2) AS units, round(sales, 2) AS sales
    FROM star ORDER BY md5('42|' || order_id || '|' || product_id || '|' || line_no),
                       order_id, product_id, line_no LIMIT 300
    """,
    star=True,
)
def sample_pairs(spark, sf_dir):
    lines = sales_lines(spark, sf_dir).select(*LINE_KEYS, "units", "sales")
    return finish(statistics.sample_rows(lines, LINE_KEYS, 300), units=2, sales=2)


@register(
    "identity_line",
    "SELECT round(min(sales), 2) AS line_low, round(max(sales), 2) AS line_high FROM star",
    star=True,
)
def identity_line(spark, sf_dir):
    return finish(
        statistics.identity_line(sales_lines(spark, sf_dir), "sales"), line_low=2, line_high=2
    )
