"""Stored tables changed in place, published as versions, dealt into buckets, and bad rows."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from martlens.operators import cleaning
from martlens.session import scratch_path
from martlens.sources.partitions import delete_copies
from martlens.sources.readers import read_csv_checked
from martlens.sources.tables import save_table
from martlens.sources.versions import VersionedTable
from martlens.testbed.bindings import sales_lines, star, table
from martlens.testbed.quality_queries import CONSOLIDATED_SQL, ORDERS_CSV
from martlens.testbed.registry import finish, register

_DOCUMENTS = ("doc_id", "lang", "source", "n_chars")


@register(
    "delete_copies_partitions",
    """
    SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN (
      SELECT min(doc_id) FROM documents GROUP BY text, lang, source, n_chars)
    """,
)
def delete_copies_partitions(spark, sf_dir):
    """Copies removed from a partitioned table, which is then read by its name."""
    name, path = f"documents_{uuid.uuid4().hex}", scratch_path(spark, "documents")
    by = ("lang", "source")
    save_table(table(spark, sf_dir, "documents"), name, path, by)
    delete_copies(spark, path, by, "doc_id", ("text", "lang", "source", "n_chars"), wide=True)
    spark.catalog.refreshTable(name)
    return finish(spark.table(name).select(*_DOCUMENTS))


@register("table_published", CONSOLIDATED_SQL)
def table_published(spark, sf_dir):
    """Live lines consolidated and published as the next version of the same name."""
    name = f"lines_{uuid.uuid4().hex}"
    live = VersionedTable(spark, scratch_path(spark, "lines"), name)
    live.publish(sales_lines(spark, sf_dir))
    live.publish(cleaning.consolidate_lines(live.read(), sparse=True))
    return finish(spark.table(name), sales=2, units=2)


@register(
    "enrich_bucketed",
    """
    SELECT order_id, product_id, line_no, round(sales, 2) AS sales, ship_mode, order_year, region,
           division
    FROM star
    """,
    star=True,
)
def enrich_bucketed(spark, sf_dir):
    """Lines joined to their orders' chain by buckets, and to products by a shuffle."""
    stored = star(spark, sf_dir).bucketed(f"sales_{uuid.uuid4().hex}", "order_id", 8)
    columns = ("order_id", "product_id", "line_no", "sales", "ship_mode", "order_year", "region",
               "division")
    return finish(stored.select(*columns), sales=2)


# Every so many orders a line of the file is spoilt: by its price, its date, or cut short.
_SPOILT = "CASE WHEN o_orderkey % 13 = 0 THEN 'cut' WHEN o_orderkey % 7 = 0 THEN 'total' " \
          "WHEN o_orderkey % 11 = 0 THEN 'date' ELSE 'good' END"  # fmt: skip


def _spoilt_orders(spark, sf_dir):
    """The two results of reading orders as CSV where some lines are spoilt."""
    orders = table(spark, sf_dir, "orders").withColumn("state", F.expr(_SPOILT))
    state = F.col("state")
    fields = F.concat_ws(
        ",", "o_orderkey", "o_custkey",
        F.when(state == "date", "some day").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")),
        "o_orderpriority",
        F.when(state == "total", F.concat(F.lit("about "), F.col("o_totalprice").cast("string")))
        .otherwise(F.col("o_totalprice").cast("string")),
    )
    line = F.when(state == "cut", F.concat_ws(",", "o_orderkey", "o_custkey")).otherwise(fields)
    head = ",".join(ORDERS_CSV.columns)
    path = scratch_path(spark, "orders-csv")

    def with_head(batches):
        """Each file begins with the headings."""
        first = True
        for batch in batches:
            if first:
                yield pa.RecordBatch.from_pydict({"line": [head]}, batch.schema)
                first = False
            yield batch

    orders.select(line.alias("line")).mapInArrow(with_head, "line string").write.text(path)
    return read_csv_checked(spark, path, ORDERS_CSV)


@register(
    "csv_quarantine",
    f"""
    SELECT o_orderkey AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
           strftime(o_orderdate, '%Y-%m-%d') AS order_date, o_orderpriority AS ship_mode,
           round(o_totalprice, 2) AS order_total
    FROM orders WHERE {_SPOILT} = 'good'
    """,
)
def csv_quarantine(spark, sf_dir):
    """The lines of a partly spoilt file that fit."""
    return finish(_spoilt_orders(spark, sf_dir)[0], order_total=2)


@register(
    "csv_rejects",
    f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS first_field,
           CASE {_SPOILT} WHEN 'cut' THEN 'not 5 fields'
                WHEN 'date' THEN 'Order Date: not a timestamp: some day'
                ELSE 'Order Total: not a double' END AS reason
    FROM orders WHERE {_SPOILT} <> 'good'
    """,
)
def csv_rejects(spark, sf_dir):
    """The lines that do not fit, with the reason."""
    rejects = _spoilt_orders(spark, sf_dir)[1]
    return rejects.select(
        F.split("line", ",")[0].alias("first_field"),
        F.regexp_replace(F.concat_ws("; ", "reasons"), ": about .*", "").alias("reason"),
    )
