"""Stored roll-ups, built from batches of the sales lines, and what they answer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.functions.columns import col
from martlens.plans.rollups import RollupStore
from martlens.plans.star import Star
from martlens.session import scratch_path
from martlens.testbed.bindings import star
from martlens.testbed.registry import finish, register

# The ship dates where a new batch of lines begins.
_CUTS = ("1994-01-01", "1996-01-01")

# Filter choices of a page: years, region, division.
CHOICES = {
    "everything": (None, "All", "All"),
    "two years of one region": ([1996, 1997], "ASIA", "All"),
    "one division": (None, "All", "PROMO"),
    "one year, region and division": ([1995], "EUROPE", "SMALL"),
    "nothing": ([1900], "All", "All"),
}


def _condition(years, region: str, division: str) -> str:
    wanted = [f"order_year IN ({', '.join(map(str, years))})"] if years else []
    wanted += [f"{c} = '{x}'" for c, x in (("region", region), ("division", division)) if x != "All"]
    return " AND ".join(wanted) or "true"


def _for_choices(select: str) -> str:
    return " UNION ALL ".join(
        select.format(name=name, where=_condition(*choice)) for name, choice in CHOICES.items()
    )


def batches(spark, sf_dir) -> list[Star]:
    """The star of each batch: lines by ship date, those without one in the last."""
    whole = star(spark, sf_dir)
    ends = [F.lit(c).cast("timestamp_ntz") for c in _CUTS]
    shipped = col("ship_date")
    parts = [shipped < ends[0], (shipped >= ends[0]) & (shipped < ends[1]),
             shipped.isNull() | (shipped >= ends[1])]
    return [Star(whole.fact.filter(p), whole.lookups) for p in parts]


def filled(spark, sf_dir) -> RollupStore:
    """A store that got the lines in three batches, one of them twice."""
    store = RollupStore(spark, scratch_path(spark, "rollup-store"))
    first, second, third = batches(spark, sf_dir)
    store.append(first, "first")
    store.append(second, "second")
    store.append(second, "second")
    store.compact()
    store.append(third, "third")
    return store


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


@register(
    "rollup_appended",
    """
    SELECT order_year, quarter, region, division, ship_mode, count(*) AS n_rows,
           round(sum(sales), 2) AS sales, round(sum(units), 2) AS units,
           round(sum(gross_profit), 4) AS gross_profit
    FROM star GROUP BY ALL
    """,
    star=True,
)
def rollup_appended(spark, sf_dir):
    """Batch by batch equals one pass over everything."""
    by = ("order_year", "quarter", "region", "division", "ship_mode")
    sums = filled(spark, sf_dir).sums()
    found = sums.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("n_rows", "sales", "units", "gross_profit")]
    )
    return finish(found, sales=2, units=2)


_MEASURED = ("sales", "units", "gross_profit", "shipping_days")


@register(
    "correlation_stored",
    " UNION ALL ".join(
        _for_choices(
            f"SELECT '{{name}}' AS choice, '{a}' AS a, '{b}' AS b, "
            f"round(corr({a}, {b}), 4) + 0.0 AS r FROM star WHERE {{where}}"
        )
        for a in _MEASURED
        for b in _MEASURED
    ),
    star=True,
)
def correlation_stored(spark, sf_dir):
    """The heat maps of several filter choices, from stored moments."""
    store = filled(spark, sf_dir)
    found = [
        store.correlations(*choice).select(F.lit(name).alias("choice"), "a", "b", "r")
        for name, choice in CHOICES.items()
    ]
    wanted = F.col("a").isin(*_MEASURED) & F.col("b").isin(*_MEASURED)
    return finish(_union(found).filter(wanted), r=4)


@register(
    "quantiles_stored",
    _for_choices(
        "SELECT '{name}' AS choice, round(quantile_cont(sales, 0.25), 4) AS q1, "
        "round(quantile_cont(sales, 0.5), 4) AS median, "
        "round(quantile_cont(sales, 0.75), 4) AS q3 FROM star WHERE {where}"
    ),
    star=True,
)
def quantiles_stored(spark, sf_dir):
    """Quartiles of several filter choices: the bin from the store, its rows from the lines."""
    store, lines = filled(spark, sf_dir), star(spark, sf_dir)
    rows = [
        (name, *store.quantiles(lines, "sales", [0.25, 0.5, 0.75], *choice))
        for name, choice in CHOICES.items()
    ]
    return finish(spark.createDataFrame(rows, "choice string, q1 double, median double, q3 double"))


@register(
    "headline_stored",
    _for_choices(
        "SELECT '{name}' AS choice, round(coalesce(sum(sales), 0), 2) AS total_sales, "
        "round(avg(sales), 4) AS average_sale, round(median(sales), 4) AS median_sale, "
        "count(*) AS n_transactions, strftime(min(order_date), '%Y-%m-%d') AS first_order, "
        "strftime(max(order_date), '%Y-%m-%d') AS last_order FROM star WHERE {where}"
    ),
    star=True,
)
def headline_stored(spark, sf_dir):
    """The headline figures of several filter choices."""
    store, lines = filled(spark, sf_dir), star(spark, sf_dir)
    found = [
        store.headline(lines, *choice).select(F.lit(name).alias("choice"), "*")
        for name, choice in CHOICES.items()
    ]
    return finish(_union(found), total_sales=2)


@register(
    "distinct_orders_stored",
    """
    SELECT order_year, region, count(DISTINCT order_id) AS n_orders
    FROM star WHERE division = 'PROMO' GROUP BY order_year, region
    UNION ALL
    SELECT NULL, NULL, count(DISTINCT order_id) FROM star
    """,
    star=True,
)
def distinct_orders_stored(spark, sf_dir):
    """Different orders per year and region of one division, and of everything."""
    store = filled(spark, sf_dir)
    each = store.distinct_orders(("order_year", "region"), division="PROMO")
    whole = store.distinct_orders().select(
        F.lit(None).cast("int").alias("order_year"), F.lit(None).cast("string").alias("region"),
        "n_orders",
    )
    return finish(each.unionByName(whole))
