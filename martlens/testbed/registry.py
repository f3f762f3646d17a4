"""Named queries, each a Spark callable with the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlens.functions.columns import col
from martlens.testbed.bindings import TARGETS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_TARGET_ROWS = ", ".join(f"('{d}', {t!r}::DOUBLE)" for d, t in TARGETS.items())

# The merged star of ``bindings.star`` in SQL.
STAR_SQL = f"""WITH star AS (
  SELECT l.l_orderkey AS order_id, l.l_partkey AS product_id,
         CAST(l.l_linenumber AS BIGINT) AS line_no,
         l.l_suppkey AS factory_id, l.l_shipdate AS ship_date,
         l.l_extendedprice AS sales, l.l_quantity AS units,
         l.l_extendedprice * l.l_discount AS gross_profit,
         l.l_extendedprice * (1 - l.l_discount) AS cost,
         o.o_custkey AS customer_id, o.o_orderdate AS order_date,
         o.o_orderpriority AS ship_mode,
         year(o.o_orderdate) AS order_year, month(o.o_orderdate) AS order_month,
         day(o.o_orderdate) AS order_day, strftime(o.o_orderdate, '%A') AS order_weekday,
         quarter(o.o_orderdate) AS quarter,
         CAST(c.c_nationkey AS BIGINT) AS country_id, n.n_name AS country,
         CAST(n.n_regionkey AS BIGINT) AS region_id,
         r.r_name AS region, p.p_type AS division, p.p_name AS product_name,
         p.p_retailprice AS unit_price, p.p_retailprice - p.p_size AS unit_cost,
         s.s_name AS factory, t.target,
         CAST(floor((epoch_us(l.l_shipdate) - epoch_us(o.o_orderdate)) / 86400000000.0)
              AS BIGINT) AS shipping_days
  FROM lineitem l
  LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
  LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
  LEFT JOIN (VALUES {_TARGET_ROWS}) AS t(division, target) ON p.p_type = t.division
)
"""


def register(name: str, sql: str | None = None, star: bool = False):
    """Add a query; ``star`` puts the merged star in front of its SQL as a CTE."""

    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = STAR_SQL + sql.strip() if star else sql.strip()
        return query

    return add


def finish(df: DataFrame, **places: int) -> DataFrame:
    """Plain comparable columns: 64-bit integers, ISO dates, rounded doubles."""
    out = []
    for f in df.schema.fields:
        c, kind = col(f.name), f.dataType
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), places.get(f.name, 4)) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)
