"""The test tables as a retail star schema.

A sales line is a ``lineitem`` row.  Its product is a ``part``, its factory a
``supplier``, its order date and ship mode come from ``orders``, and the region
hangs four hops away: order -> customer -> nation -> region.  Calendar features
are computed on ``orders``, the smaller side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.functions.columns import date_parts
from martlens.plans.star import Lookup, Star

# The columns of the test tables.  Stated, they need not be read
# from a file footer for every table of every query.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
TABLES = tuple(SCHEMAS)

# Sales target per division.  SMALL has none on purpose, so the
# left join leaves missing targets.
TARGETS = {
    "STANDARD": 500_000_000.0,
    "ECONOMY": 450_000_000.0,
    "MEDIUM": 520_000_000.0,
    "PROMO": 480_000_000.0,
    "LARGE": 510_000_000.0,
}

# Columns that tell the lines of the fact apart (there is no row id).
LINE_KEYS = ("order_id", "product_id", "line_no")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def priced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales lines with their discount, profit and cost not yet computed."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_suppkey").alias("factory_id"),
        F.col("l_shipdate").alias("ship_date"),
        F.col("l_extendedprice").alias("sales"),
        F.col("l_quantity").alias("units"),
        F.col("l_discount").alias("discount"),
    )


def with_profit(lines: DataFrame) -> DataFrame:
    price, discount = F.col("sales"), F.col("discount")
    profit = {"gross_profit": price * discount, "cost": price * (1 - discount)}
    return lines.withColumns(profit).drop("discount")


def sales_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_profit(priced_lines(spark, sf_dir))


def targets(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{d}', {t!r}D)" for d, t in TARGETS.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(division, target)")


def star(spark: SparkSession, sf_dir: str, lean: bool = False) -> Star:
    """The star; a ``lean`` one leaves out what can be computed after the joins."""

    def dim(name: str, **columns) -> DataFrame:
        return table(spark, sf_dir, name).select(*[c.alias(n) for n, c in columns.items()])

    c = F.col
    orders = dim(
        "orders",
        order_id=c("o_orderkey"),
        customer_id=c("o_custkey"),
        order_date=c("o_orderdate"),
        ship_mode=c("o_orderpriority"),
        **({} if lean else date_parts("o_orderdate")),
    )
    products = dim(
        "part",
        product_id=c("p_partkey"),
        division=c("p_type"),
        product_name=c("p_name"),
        unit_price=c("p_retailprice"),
        unit_cost=c("p_retailprice") - c("p_size"),
    )
    return Star(
        (priced_lines if lean else sales_lines)(spark, sf_dir),
        (
            Lookup("orders", orders, ("order_id",)),
            Lookup(
                "customers",
                dim("customer", customer_id=c("c_custkey"), country_id=c("c_nationkey")),
                ("customer_id",),
            ),
            Lookup(
                "countries",
                dim(
                    "nation",
                    country_id=c("n_nationkey"),
                    country=c("n_name"),
                    region_id=c("n_regionkey"),
                ),
                ("country_id",),
            ),
            Lookup(
                "regions", dim("region", region_id=c("r_regionkey"), region=c("r_name")),
                ("region_id",),
            ),
            Lookup("products", products, ("product_id",)),
            Lookup(
                "factories",
                dim("supplier", factory_id=c("s_suppkey"), factory=c("s_name")),
                ("factory_id",),
            ),
            Lookup("targets", targets(spark), ("division",)),
        ),
    )


def input_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four input tables in their own shape: names on the sales lines too.

    A product is made by its brand's factory; a factory's location is the mean
    size and price of what it makes.
    """
    c = F.col
    part = table(spark, sf_dir, "part")
    products = part.select(
        c("p_type").alias("division"),
        c("p_name").alias("product_name"),
        c("p_brand").alias("factory"),
        c("p_partkey").alias("product_id"),
        c("p_retailprice").alias("unit_price"),
        (c("p_retailprice") - c("p_size")).alias("unit_cost"),
    )
    factories = part.groupBy(c("p_brand").alias("factory")).agg(
        F.avg("p_size").alias("latitude"), F.avg("p_retailprice").alias("longitude")
    )
    sales = star(spark, sf_dir).select(
        *LINE_KEYS, "order_date", "ship_date", "ship_mode", "region", "division", "product_name",
        "sales", "units", "gross_profit", "cost",
    )
    return {
        "sales": sales, "products": products, "factories": factories, "targets": targets(spark),
    }
