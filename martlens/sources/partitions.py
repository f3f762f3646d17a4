"""Changing a partitioned folder of files where it has to change, and nowhere else."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlens.functions.columns import col
from martlens.operators.cleaning import copy_ids
from martlens.session import delete_path
from martlens.sources.tables import materialize

_FOLDER = "__folder"


def _folders(df: DataFrame) -> DataFrame:
    """Rows with the folder of the file that holds them."""
    return df.withColumn(_FOLDER, F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", ""))


def _as_written(spark: SparkSession, path: str, partition_by: Sequence[str]) -> T.StructType:
    """The folder's columns, the partition columns as the text that names the folders.

    Read as numbers, ``month=01`` would be written back as ``month=1``.
    """
    schema = spark.read.parquet(path).schema
    lacking = [c for c in partition_by if c not in schema.names]
    if lacking:
        raise ValueError(f"{path} has no columns {lacking}")
    return T.StructType([
        T.StructField(f.name, T.StringType() if f.name in partition_by else f.dataType, True)
        for f in schema.fields
    ])


def delete_rows(
    spark: SparkSession, path: str, partition_by: Sequence[str], doomed: DataFrame,
    keys: Sequence[str],
) -> list[str]:
    """Remove the rows whose ``keys`` occur in ``doomed``; returns the folders rewritten.

    ``partition_by`` are all partition columns of the folder, outermost first.  Rows are
    matched by their keys alone first.  Only partitions that hold such a row are read whole,
    written to the scratch folder without it, and put in place of the old ones by a dynamic
    partition overwrite; a partition that loses every row goes.  All other files stay as
    they are, names included.  Null keys match nothing.  What reaches the driver is the
    names of the partitions concerned.

    A reader at that moment may see some partitions old and some new; a job that broke off
    can be repeated.  :class:`martlens.sources.versions.VersionedTable` replaces all at once.
    """
    schema = _as_written(spark, path, partition_by)
    live = _folders(spark.read.schema(schema).parquet(path))
    listed = materialize(doomed.select(*[col(k) for k in keys]).distinct(), "doomed")
    hit = live.join(listed, list(keys), "left_semi").select(_FOLDER).distinct()
    folders = sorted(r[_FOLDER] for r in hit.collect())
    if not folders:
        return []
    affected = spark.read.schema(schema).option("basePath", path).parquet(*folders)
    kept = materialize(_folders(affected).join(listed, list(keys), "left_anti"), "kept")
    filled = {r[_FOLDER] for r in kept.select(_FOLDER).distinct().collect()}
    writer = kept.select(*[col(f.name) for f in schema.fields]).write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)
    for folder in set(folders) - filled if partition_by else ():
        delete_path(spark, folder)
    return folders


def delete_copies(
    spark: SparkSession, path: str, partition_by: Sequence[str], row_id: str,
    business: Sequence[str], wide: bool = False,
) -> list[str]:
    """Keep, of rows equal in all business columns, the one with the least id, in place.

    Copies may lie in different partitions.  Returns the folders that were rewritten.
    """
    live = spark.read.parquet(path)
    return delete_rows(
        spark, path, partition_by, copy_ids(live, row_id, business, wide), [row_id]
    )
