"""Sources, profiling, integrity and cleaning over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from martlens.operators import cleaning, integrity, profiling
from martlens.plans.star import merge_growth
from martlens.session import scratch_path
from martlens.sources.readers import read_csv, read_table
from martlens.sources.schemas import TableSpec
from martlens.sources.tables import materialize, replace_table, save_table
from martlens.testbed.bindings import TABLES, TARGETS, sales_lines, star, table
from martlens.testbed.registry import finish, register

# -- sources ------------------------------------------------------------------

ORDERS_CSV = TableSpec(
    "orders",
    {
        "Order ID": ("order_id", "bigint"),
        "Customer ID": ("customer_id", "string"),
        "Order Date": ("order_date", "timestamp"),
        "Ship Mode": ("ship_mode", "string"),
        "Order Total": ("order_total", "double"),
    },
    ("order_id", "customer_id", "order_date", "ship_mode", "order_total"),
)


_ORDERS_SQL = """
    SELECT o_orderkey AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
           strftime(o_orderdate, '%Y-%m-%d') AS order_date, o_orderpriority AS ship_mode,
           round(o_totalprice, 2) AS order_total
    FROM orders
    """


@register("table_scan", _ORDERS_SQL)
def table_scan(spark, sf_dir):
    """Orders as a catalog table with columns of other types, read back typed."""
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("double").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
        F.col("o_orderpriority").alias("ship_mode"),
        F.col("o_totalprice").cast("string").alias("order_total"),
    )
    name = f"orders_{uuid.uuid4().hex}"
    save_table(raw, name, scratch_path(spark, "orders-table"))
    return finish(read_table(spark, name, ORDERS_CSV), order_total=2)


@register("csv_roundtrip", _ORDERS_SQL)
def csv_roundtrip(spark, sf_dir):
    """Orders written as CSV under their headings and read back typed."""
    path = scratch_path(spark, "orders-csv")
    table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("Order ID"),
        F.col("o_custkey").alias("Customer ID"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Order Date"),
        F.col("o_orderpriority").alias("Ship Mode"),
        F.col("o_totalprice").alias("Order Total"),
    ).write.csv(path, header=True, escape='"')
    return finish(read_csv(spark, path, ORDERS_CSV), order_total=2)


CONSOLIDATED_SQL = """
    SELECT l_orderkey AS order_id, l_partkey AS product_id,
           CAST(min(l_linenumber) AS BIGINT) AS line_no, min(l_suppkey) AS factory_id,
           strftime(min(l_shipdate), '%Y-%m-%d') AS ship_date,
           round(sum(l_extendedprice), 2) AS sales, round(sum(l_quantity), 2) AS units,
           round(sum(l_extendedprice * l_discount), 4) AS gross_profit,
           round(sum(l_extendedprice * (1 - l_discount)), 4) AS cost
    FROM lineitem GROUP BY l_orderkey, l_partkey
    """


@register("table_swap", CONSOLIDATED_SQL)
def table_swap(spark, sf_dir):
    """Live table consolidated, written anew and swapped in by renaming."""
    name = f"sales_{uuid.uuid4().hex}"
    live = save_table(sales_lines(spark, sf_dir), name, scratch_path(spark, "sales"))
    swapped = replace_table(cleaning.consolidate_lines(live), name)
    return finish(swapped, sales=2, units=2)


# -- profiling ----------------------------------------------------------------

@register(
    "table_shape",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_rows, "
        f"(SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}') AS n_columns"
        for t in TABLES
    ),
)
def table_shape(spark, sf_dir):
    return profiling.table_shape({t: table(spark, sf_dir, t) for t in TABLES})


_MERGE_STEPS = ("fact", "orders", "customers", "countries", "regions", "products", "factories",
                "targets")
_MERGE_WIDTHS = (9, 17, 18, 20, 21, 25, 26, 27)
_MERGE_JOINS = (
    "LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey",
    "LEFT JOIN customer c ON o.o_custkey = c.c_custkey",
    "LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey",
    "LEFT JOIN region r ON n.n_regionkey = r.r_regionkey",
    "LEFT JOIN part p ON l.l_partkey = p.p_partkey",
    "LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey",
    "LEFT JOIN (VALUES " + ", ".join(f"('{d}')" for d in TARGETS) + ") t(d) ON p.p_type = t.d",
)


@register(
    "merge_growth",
    " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS step, '{name}' AS joined, count(*) AS n_rows, "
        f"{width}::BIGINT AS n_columns FROM lineitem l {' '.join(_MERGE_JOINS[:i])}"
        for i, (name, width) in enumerate(zip(_MERGE_STEPS, _MERGE_WIDTHS, strict=True))
    ),
)
def merge_rows(spark, sf_dir):
    """Row and column counts along the join chain; unique keys add no rows."""
    return merge_growth(star(spark, sf_dir))


@register(
    "preview",
    """
    SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice,
           strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority
    FROM orders ORDER BY o_orderkey LIMIT 50
    """,
)
def preview(spark, sf_dir):
    return finish(profiling.preview(table(spark, sf_dir, "orders"), ["o_orderkey"], 50))


# Type names of the two engines.
_TYPE_SQL = """CASE {t} WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
    WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string'
    WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END"""

_PROFILED = {
    "lineitem": (
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ),
    "orders": (
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        "o_orderpriority",
    ),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
}


def _profile_sql(source: str, columns, label: str | None = None) -> str:
    name = f"'{label}' AS table_name, " if label else ""
    return " UNION ALL ".join(
        f"SELECT {name}{i}::BIGINT AS position, '{c}' AS column_name, "
        f"{_TYPE_SQL.format(t=f'(SELECT typeof({c}) FROM {source} LIMIT 1)')} AS data_type, "
        f"count({c}) AS non_null, count(*) - count({c}) AS nulls FROM {source}"
        for i, c in enumerate(columns, 1)
    )


@register("column_types", " UNION ALL ".join(_profile_sql(t, c, t) for t, c in _PROFILED.items()))
def column_types(spark, sf_dir):
    """Columns, types and fill of the four source tables."""
    parts = [
        profiling.schema_profile(table(spark, sf_dir, t)).select(F.lit(t).alias("table_name"), "*")
        for t in _PROFILED
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_ENRICHED = (
    "order_id", "product_id", "sales", "units", "gross_profit", "cost", "ship_date",
    "order_date", "ship_mode", "region", "country", "division", "product_name", "unit_price",
    "unit_cost", "factory", "target",
)


@register("schema_profile", _profile_sql("star", _ENRICHED), star=True)
def schema_profile(spark, sf_dir):
    return profiling.schema_profile(star(spark, sf_dir).select(*_ENRICHED))


@register(
    "null_audit",
    "SELECT "
    + ", ".join(f"count(*) - count({c}) AS null_{c}" for c in _ENRICHED)
    + " FROM star",
    star=True,
)
def null_audit(spark, sf_dir):
    return profiling.null_counts(star(spark, sf_dir).select(*_ENRICHED))


@register(
    "duplicate_keys",
    """
    SELECT l_orderkey, l_partkey, count(*) AS n_rows FROM lineitem
    GROUP BY l_orderkey, l_partkey HAVING count(*) > 1
    """,
)
def duplicate_keys(spark, sf_dir):
    return profiling.duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@register(
    "distinct_keys",
    """
    SELECT count(DISTINCT l_orderkey) AS n_l_orderkey, count(DISTINCT l_partkey) AS n_l_partkey
    FROM lineitem
    """,
)
def distinct_keys(spark, sf_dir):
    return profiling.distinct_count(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@register(
    "duplicate_row_count",
    """
    SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicates FROM (
      SELECT count(*) AS n FROM documents GROUP BY text, lang, source, n_chars)
    """,
)
def duplicate_row_count(spark, sf_dir):
    return profiling.duplicate_row_count(
        table(spark, sf_dir, "documents").drop("doc_id"), wide=True
    )


@register("distinct_values", "SELECT DISTINCT o_orderpriority AS ship_mode FROM orders")
def distinct_values(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "ship_mode")
    return profiling.distinct_values(orders, "ship_mode")


_CATEGORICAL = ("region", "division", "country", "ship_mode")


@register(
    "value_frequency",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n_rows FROM star GROUP BY {c}"
        for c in _CATEGORICAL
    ),
    star=True,
)
def value_frequency(spark, sf_dir):
    return profiling.value_frequency(star(spark, sf_dir).rollup(_CATEGORICAL, []), _CATEGORICAL)


@register(
    "name_variants",
    """
    SELECT product_id, product_name, count(*) AS n_rows FROM star
    GROUP BY product_id, product_name
    """,
    star=True,
)
def name_variants(spark, sf_dir):
    rolled = star(spark, sf_dir).rollup(["product_id", "product_name"], [])
    return profiling.name_variants(rolled, "product_id", "product_name")


@register(
    "several_names",
    """
    SELECT p_brand, count(DISTINCT p_name) AS n_names, count(*) AS n_rows FROM part
    GROUP BY p_brand HAVING count(DISTINCT p_name) > 1
    """,
)
def several_names(spark, sf_dir):
    return profiling.keys_with_several_names(table(spark, sf_dir, "part"), "p_brand", "p_name")


@register(
    "date_range",
    """
    SELECT strftime(min(order_date), '%Y-%m-%d') AS min_order_date,
           strftime(max(order_date), '%Y-%m-%d') AS max_order_date,
           strftime(min(ship_date), '%Y-%m-%d') AS min_ship_date,
           strftime(max(ship_date), '%Y-%m-%d') AS max_ship_date
    FROM star
    """,
    star=True,
)
def date_range(spark, sf_dir):
    lines = star(spark, sf_dir)
    ordered = profiling.date_range(lines.rollup(["order_date"], []), ["order_date"])
    shipped = profiling.date_range(lines.fact, ["ship_date"])
    return finish(
        ordered.select("*", *[shipped.select(c).scalar().alias(c) for c in shipped.columns])
    )


_MEASURES = ("sales", "units", "gross_profit", "cost")


@register(
    "numeric_summary",
    "SELECT "
    + ", ".join(
        f"round(min({c}), 2) AS min_{c}, round(max({c}), 2) AS max_{c}, "
        f"round(avg({c}), 2) AS avg_{c}, round(median({c}), 2) AS median_{c}, "
        f"round(stddev_samp({c}), 2) AS stddev_{c}"
        for c in _MEASURES
    )
    + " FROM star",
    star=True,
)
def numeric_summary(spark, sf_dir):
    return finish(profiling.numeric_summary(sales_lines(spark, sf_dir), _MEASURES))


_DESCRIBED = (
    "sales", "units", "gross_profit", "cost", "unit_price", "unit_cost", "target",
    "order_year", "order_month", "order_day", "quarter", "shipping_days",
)


@register(
    "describe_numeric",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, "
        f"round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min, "
        f"round(CAST(quantile_cont({c}, 0.25) AS DOUBLE), 6) AS p25, "
        f"round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), 6) AS p50, "
        f"round(CAST(quantile_cont({c}, 0.75) AS DOUBLE), 6) AS p75, "
        f"round(CAST(max({c}) AS DOUBLE), 6) AS max FROM star"
        for c in _DESCRIBED
    ),
    star=True,
)
def describe_numeric(spark, sf_dir):
    # the summary scans its input several times: join once, then scan the result
    lines = materialize(star(spark, sf_dir).select(*_DESCRIBED), "described")
    stats = ("mean", "std", "min", "p25", "p50", "p75", "max")
    return finish(profiling.describe_numeric(lines), **dict.fromkeys(stats, 6))


# -- integrity ----------------------------------------------------------------


@register(
    "orphan_facts",
    """
    SELECT o.o_orderkey, count(*) AS n_rows FROM orders o
    LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON o.o_orderkey = l.l_orderkey
    WHERE l.l_orderkey IS NULL GROUP BY o.o_orderkey
    """,
)
def orphan_facts(spark, sf_dir):
    return integrity.orphan_keys(
        table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), "o_orderkey",
        "l_orderkey",
    )


@register(
    "orphan_dims",
    """
    SELECT d.doc_id, count(*) AS n_rows FROM documents d
    LEFT JOIN labels b ON d.doc_id = b.doc_id WHERE b.doc_id IS NULL GROUP BY d.doc_id
    """,
)
def orphan_dims(spark, sf_dir):
    return integrity.orphan_keys(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id"
    )


@register(
    "negative_values",
    """
    SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal, c_mktsegment
    FROM customer WHERE c_acctbal < 0
    """,
)
def negative_values(spark, sf_dir):
    rows = integrity.negative_rows(table(spark, sf_dir, "customer"), "c_acctbal")
    return finish(rows.drop("c_nationkey"), c_acctbal=2)


@register(
    "negative_any",
    """
    SELECT order_id, product_id, line_no, round(sales, 2) AS sales, round(cost, 4) AS cost,
           shipping_days
    FROM star WHERE sales < 0 OR cost < 0 OR shipping_days < 0
    """,
    star=True,
)
def negative_any(spark, sf_dir):
    lines = star(spark, sf_dir).select(
        "order_id", "product_id", "line_no", "sales", "cost", "shipping_days"
    )
    return finish(integrity.negative_rows(lines, "sales", "cost", "shipping_days"), sales=2)


@register(
    "nonpositive_units",
    """
    SELECT l_orderkey, l_partkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_discount
    FROM lineitem WHERE l_discount <= 0
    """,
)
def nonpositive_units(spark, sf_dir):
    rows = integrity.nonpositive_rows(table(spark, sf_dir, "lineitem"), "l_discount")
    return finish(rows.select("l_orderkey", "l_partkey", "l_linenumber", "l_discount"))


@register(
    "late_shipments",
    """
    SELECT order_id, product_id, line_no, strftime(order_date, '%Y-%m-%d') AS order_date,
           strftime(ship_date, '%Y-%m-%d') AS ship_date,
           year(ship_date) - order_year AS years_to_ship
    FROM star WHERE year(ship_date) - order_year > 1
    """,
    star=True,
)
def late_shipments(spark, sf_dir):
    lines = star(spark, sf_dir).select(
        "order_id", "product_id", "line_no", "order_date", "ship_date"
    )
    return finish(integrity.late_shipments(lines))


_RULE_SQL = """
    SELECT order_id, product_id, line_no, round(sales, 4) AS sales,
           round(gross_profit + cost, 4) AS expected
    FROM star WHERE {broken}
    """


def _rule(spark, sf_dir, **how):
    rows = integrity.rule_violations(sales_lines(spark, sf_dir), **how)
    return finish(rows.select("order_id", "product_id", "line_no", "sales", "expected"))


@register("rule_exact", _RULE_SQL.format(broken="sales <> gross_profit + cost"), star=True)
def rule_exact(spark, sf_dir):
    """The rule on binary doubles, rounding noise included."""
    return _rule(spark, sf_dir, tolerance=None)


@register(
    "rule_tolerance",
    _RULE_SQL.format(broken="abs(sales - (gross_profit + cost)) > 0.005"),
    star=True,
)
def rule_tolerance(spark, sf_dir):
    return _rule(spark, sf_dir)


@register(
    "rule_decimal",
    """
    , e AS (SELECT order_id, product_id, line_no, sales,
                   CAST(CAST(sales AS DECIMAL(28,6)) AS DECIMAL(28,2)) AS whole,
                   CAST(CAST(gross_profit AS DECIMAL(28,6)) AS DECIMAL(28,2))
                   + CAST(CAST(cost AS DECIMAL(28,6)) AS DECIMAL(28,2)) AS expected FROM star)
    SELECT order_id, product_id, line_no, round(sales, 4) AS sales,
           round(CAST(expected AS DOUBLE), 4) AS expected
    FROM e WHERE whole <> expected
    """,
    star=True,
)
def rule_decimal(spark, sf_dir):
    """The rule on cents: parts rounded one by one can miss the whole."""
    return _rule(spark, sf_dir, decimals=2)


# -- cleaning -----------------------------------------------------------------

_DOC_BUSINESS = ("text", "lang", "source", "n_chars")
_DOC_COLUMNS = "doc_id, md5(text) AS text_md5, lang, source, n_chars"


def _documents(rows):
    return rows.select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


@register(
    "exact_duplicates",
    f"""
    SELECT {_DOC_COLUMNS} FROM documents WHERE doc_id NOT IN (
      SELECT min(doc_id) FROM documents GROUP BY text, lang, source, n_chars)
    """,
)
def exact_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return _documents(cleaning.exact_copies(docs, "doc_id", _DOC_BUSINESS, wide=True))


@register(
    "exact_dedup",
    f"""
    SELECT {_DOC_COLUMNS} FROM documents WHERE doc_id IN (
      SELECT min(doc_id) FROM documents GROUP BY text, lang, source, n_chars)
    """,
)
def exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return _documents(cleaning.drop_exact_copies(docs, "doc_id", _DOC_BUSINESS, wide=True))


@register(
    "delete_copies",
    f"""
    SELECT {_DOC_COLUMNS} FROM documents WHERE doc_id IN (
      SELECT min(doc_id) FROM documents GROUP BY text, lang, source, n_chars)
    """,
)
def delete_copies(spark, sf_dir):
    """Copies removed from a catalog table, which is then read by its old name."""
    name = f"documents_{uuid.uuid4().hex}"
    live = save_table(table(spark, sf_dir, "documents"), name, scratch_path(spark, "documents"))
    kept = cleaning.drop_exact_copies(live, "doc_id", _DOC_BUSINESS, wide=True)
    return _documents(replace_table(kept, name))


@register("consolidate_lines", CONSOLIDATED_SQL)
def consolidate_lines(spark, sf_dir):
    lines = cleaning.consolidate_lines(sales_lines(spark, sf_dir), sparse=True)
    return finish(lines, sales=2, units=2)


@register(
    "drop_incomplete",
    """
    SELECT order_id, product_id, line_no, round(sales, 2) AS sales, division, target
    FROM star WHERE sales IS NOT NULL AND division IS NOT NULL AND target IS NOT NULL
    """,
    star=True,
)
def drop_incomplete(spark, sf_dir):
    lines = star(spark, sf_dir).select(
        "order_id", "product_id", "line_no", "sales", "division", "target"
    )
    return finish(cleaning.drop_incomplete(lines, ["sales", "division", "target"]), sales=2)
