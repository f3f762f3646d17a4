"""Exact-copy removal, line consolidation, incomplete rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.functions.columns import col, missing
from martlens.sources.tables import materialize


def repeated_hashes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """64-bit row hashes that occur more than once, written out.

    Rows of any other hash have no copy.  Two different rows may share a hash,
    so the hash only narrows down who has to be compared in full.  Written
    first, the list has a known size, and a join with it is a broadcast only
    when that size is small.
    """
    hashed = df.select(F.xxhash64(*[col(c) for c in columns]).alias("__hash"))
    counted = hashed.groupBy("__hash").agg(F.count(F.lit(1)).alias("n"))
    return materialize(counted.filter("n > 1").select("__hash"), "hashes")


def split_by_hash(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that may have copies, rows that cannot have any)."""
    hashed = df.withColumn("__hash", F.xxhash64(*[col(c) for c in columns]))
    repeated = repeated_hashes(df, columns)
    may, cannot = (hashed.join(repeated, "__hash", how) for how in ("left_semi", "left_anti"))
    return may.drop("__hash"), cannot.drop("__hash")


def _collapse(df: DataFrame, row_id: str, business: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c != row_id and c not in business]
    grouped = df.groupBy(*[col(c) for c in business])
    if not rest:
        kept = grouped.agg(F.min(col(row_id)).alias(row_id))
    else:
        carried = F.struct(*[col(c) for c in rest])
        kept = grouped.agg(
            F.min(col(row_id)).alias(row_id), F.min_by(carried, col(row_id)).alias("__rest")
        ).select(row_id, *[col(c) for c in business], "__rest.*")
    return kept.select(*[col(c) for c in df.columns])


def drop_exact_copies(
    df: DataFrame, row_id: str, business: Sequence[str], wide: bool = False
) -> DataFrame:
    """Keep, of rows equal in all business columns, the one with the least id.

    An aggregate, not a window: copies collapse before the shuffle, so a group
    holding a third of the table still costs one row per map task.  ``wide``
    is for long rows such as texts: rows whose hash is unique are passed on
    without a shuffle and only the others are grouped.
    """
    if not wide:
        return _collapse(df, row_id, business)
    may, cannot = split_by_hash(df, business)
    return cannot.unionByName(_collapse(may, row_id, business))


def copy_ids(
    df: DataFrame, row_id: str, business: Sequence[str], wide: bool = False
) -> DataFrame:
    """The ids of the rows that ``drop_exact_copies`` removes, written out."""
    compared = split_by_hash(df, business)[0] if wide else df
    kept = compared.groupBy(*[col(c) for c in business]).agg(F.min(col(row_id)).alias(row_id))
    extra = compared.select(col(row_id)).join(kept.select(row_id), row_id, "left_anti")
    return materialize(extra, "copies")


def exact_copies(
    df: DataFrame, row_id: str, business: Sequence[str], wide: bool = False
) -> DataFrame:
    """The rows ``drop_exact_copies`` removes.

    Ids are compared alone first.  The ids found are written out, and whole
    rows are read again for them: by broadcast when the written list is small.
    """
    return df.join(copy_ids(df, row_id, business, wide), row_id, "left_semi")


def consolidate_lines(
    df: DataFrame,
    keys: Sequence[str] = ("order_id", "product_id"),
    summed: Sequence[str] = ("sales", "units", "gross_profit", "cost"),
    sparse: bool = False,
) -> DataFrame:
    """One row per key: measures summed, every other column its own minimum.

    Minima are taken column by column, so a row may mix attributes of several
    source rows.  ``sparse`` is for keys that rarely repeat: minima of text make
    Spark sort what it groups, so rows whose key hash is unique are passed on
    as they are and only the others are grouped.
    """
    aggregates = [
        (F.sum if c in summed else F.min)(col(c)).alias(c) for c in df.columns if c not in keys
    ]

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*[col(k) for k in keys]).agg(*aggregates).select(*map(col, df.columns))

    if not sparse:
        return grouped(df)
    may, cannot = split_by_hash(df, keys)
    merged = grouped(may)
    # a sum has a wider type than what it adds up
    single = cannot.select(*[col(c).cast(kind).alias(c) for c, kind in merged.dtypes])
    return single.unionByName(merged)


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows with a null or NaN in any of the columns."""
    for c in columns:
        df = df.filter(~missing(df, c))
    return df
