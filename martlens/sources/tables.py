"""Create, replace and swap catalog tables.

Parquet tables have no in-place delete and the session catalog no atomic
``CREATE OR REPLACE TABLE ... AS``.  Both become: write a new table, then
repoint names.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.session import delete_path, scratch_path


def save_table(
    df: DataFrame, name: str, path: str, partition_by: Sequence[str] = ()
) -> DataFrame:
    """Write ``df`` below ``path`` and register it; returns the written table."""
    writer = df.write.mode("overwrite").option("path", path).format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def save_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Write ``df`` as a table dealt and sorted by ``keys``; returns the written table.

    Tables dealt by their join keys into the same number of buckets join without being
    shuffled again.  Rows are dealt before they are written, so a bucket is one file.
    """
    dealt = df.repartition(buckets, *[F.col(k) for k in keys])
    dealt.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)


def recover_table(spark: SparkSession, name: str) -> None:
    """Put the backup back when a swap broke off between its two renames."""
    backup = f"{name}_backup"
    if not spark.catalog.tableExists(name) and spark.catalog.tableExists(backup):
        spark.sql(f"ALTER TABLE {backup} RENAME TO {name}")


def swap_tables(spark: SparkSession, live: str, fresh: str, backup: str) -> DataFrame:
    """``live`` becomes ``backup`` and ``fresh`` becomes ``live``; no data moves.

    If the second rename fails, the first is undone; :func:`recover_table` does so after
    the loss of the driver.
    """
    spark.sql(f"ALTER TABLE {live} RENAME TO {backup}")
    try:
        spark.sql(f"ALTER TABLE {fresh} RENAME TO {live}")
    except Exception:
        spark.sql(f"ALTER TABLE {backup} RENAME TO {live}")
        raise
    return spark.table(live)


def _location(spark: SparkSession, name: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Location'")
    return rows.first()["data_type"]


def _version_path(spark: SparkSession, name: str) -> str:
    """A new folder beside the table's data, or in the warehouse for a new table."""
    if spark.catalog.tableExists(name):
        parent = _location(spark, name).rstrip("/").rpartition("/")[0]
    else:
        parent = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return f"{parent}/{name.rpartition('.')[2]}-{uuid.uuid4().hex}"


def _drop_with_files(spark: SparkSession, name: str) -> None:
    if spark.catalog.tableExists(name):
        path = _location(spark, name)
        spark.sql(f"DROP TABLE {name}")
        delete_path(spark, path)


def replace_table(df: DataFrame, name: str) -> DataFrame:
    """Replace the contents of ``name`` by ``df``, which may read ``name``.

    The new data lie beside the old.  The old contents stay as ``<name>_backup``; an
    earlier backup goes, files included.
    """
    spark = df.sparkSession
    recover_table(spark, name)
    fresh, backup = f"{name}_fresh", f"{name}_backup"
    _drop_with_files(spark, fresh)  # left by a job that broke off
    save_table(df, fresh, _version_path(spark, name))
    _drop_with_files(spark, backup)
    if spark.catalog.tableExists(name):
        return swap_tables(spark, name, fresh, backup)
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {name}")
    return spark.table(name)


def materialize(
    df: DataFrame, label: str = "stage", partitions: int | None = None
) -> DataFrame:
    """Cut the lineage by a written parquet copy in the shared folder.

    ``partitions`` spreads the rows first: for inputs of fewer files than the
    cluster has cores.
    """
    path = scratch_path(df.sparkSession, label)
    (df.repartition(partitions) if partitions else df).write.parquet(path)
    return df.sparkSession.read.parquet(path)
