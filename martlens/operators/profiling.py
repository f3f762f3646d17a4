"""Shapes, previews, duplicates, missing values, frequencies, summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.functions.columns import col, missing, numeric_columns, present, row_count
from martlens.operators.cleaning import split_by_hash
from martlens.operators.quantiles import exact_quantiles


def table_shape(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row and column count of each table, one row per table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"),
            "n_rows",
            F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def preview(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """The first n rows in a stated order (a per-task top-n, no full sort)."""
    return df.orderBy(*[col(c).asc_nulls_last() for c in order_by]).limit(n)


def distinct_count(df: DataFrame, *columns: str, approximate: bool = False) -> DataFrame:
    if approximate:
        return df.agg(*[F.approx_count_distinct(col(c)).alias(f"n_{c}") for c in columns])
    # one aggregate per column: several exact distinct counts together would
    # multiply every input row
    singles = [df.agg(F.countDistinct(col(c)).alias("n")) for c in columns]
    first = df.agg(F.countDistinct(col(columns[0])).alias(f"n_{columns[0]}"))
    return first.select(
        "*",
        *[s.scalar().alias(f"n_{c}") for c, s in zip(columns[1:], singles[1:], strict=True)],
    )


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Key combinations that occur more than once, with their count."""
    return df.groupBy(*[col(k) for k in keys]).count().filter("count > 1").withColumnRenamed(
        "count", "n_rows"
    )


def duplicate_row_count(df: DataFrame, wide: bool = False) -> DataFrame:
    """Rows that repeat an earlier identical row (null equals null).

    ``wide`` groups only the rows whose hash occurs more than once.
    """
    if wide:
        df, _ = split_by_hash(df, df.columns)
    copies = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n_duplicates")
    )


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row, one ``null_<column>`` per column; NaN counts as missing."""
    return df.agg(
        *[F.count_if(missing(df, c)).alias(f"null_{c}") for c in columns or df.columns]
    )


def schema_profile(df: DataFrame) -> DataFrame:
    """Column, type, non-null and null count, one row per column, one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(missing(df, c)).alias(f"nulls_{i}") for i, c in enumerate(df.columns)],
    )
    entries = [
        F.struct(
            F.lit(i + 1).cast("bigint").alias("position"),
            F.lit(name).alias("column_name"),
            F.lit(kind).alias("data_type"),
            (F.col("total") - F.col(f"nulls_{i}")).alias("non_null"),
            F.col(f"nulls_{i}").alias("nulls"),
        )
        for i, (name, kind) in enumerate(df.dtypes)
    ]
    return counts.select(F.inline(F.array(*entries)))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(col(column).alias(column)).distinct()


def value_frequency(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, count) of several categorical columns in one pass.

    Rows are counted per combination first; a roll-up brings its ``n_rows``.
    """
    combined = df.groupBy(*[col(c) for c in columns]).agg(row_count(df).alias("n_rows"))
    entries = [
        F.struct(F.lit(c).alias("column_name"), col(c).cast("string").alias("value"), "n_rows")
        for c in columns
    ]
    return (
        combined.select(F.inline(F.array(*entries)))
        .groupBy("column_name", "value")
        .agg(F.sum("n_rows").alias("n_rows"))
    )


def name_variants(df: DataFrame, key: str, name: str) -> DataFrame:
    """Every (key, name) spelling with its row count."""
    return df.groupBy(col(key), col(name)).agg(row_count(df).alias("n_rows"))


def keys_with_several_names(df: DataFrame, key: str, name: str) -> DataFrame:
    """The verdict on ``name_variants``: keys spelled in more than one way."""
    return (
        name_variants(df, key, name)
        .filter(col(name).isNotNull())
        .groupBy(col(key))
        .agg(F.count(F.lit(1)).alias("n_names"), F.sum("n_rows").alias("n_rows"))
        .filter("n_names > 1")
    )


def date_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(
        *[f(col(c)).alias(f"{p}_{c}") for c in columns for p, f in (("min", F.min), ("max", F.max))]
    )


def _moments(df: DataFrame, columns: Sequence[str]) -> list:
    out = []
    for c in columns:
        v = present(df, c)
        out += [
            F.count(v).alias(f"count_{c}"),
            F.avg(v).alias(f"avg_{c}"),
            F.stddev_samp(v.cast("double")).alias(f"stddev_{c}"),
            F.min(v).cast("double").alias(f"min_{c}"),
            F.max(v).cast("double").alias(f"max_{c}"),
        ]
    return out


def numeric_summary(
    df: DataFrame, columns: Sequence[str], places: int = 2, approximate: bool = False
) -> DataFrame:
    """min, max, mean, median and deviation of each measure, one wide row."""
    df = df.select(*[col(c) for c in columns])
    medians = exact_quantiles(df, columns, [0.5], approximate=approximate)
    wide = df.agg(*_moments(df, columns))
    out = []
    for c in columns:
        for stat in ("min", "max", "avg"):
            out.append(F.round(col(f"{stat}_{c}"), places).alias(f"{stat}_{c}"))
        out.append(F.round(F.lit(medians[c][0]).cast("double"), places).alias(f"median_{c}"))
        out.append(F.round(col(f"stddev_{c}"), places).alias(f"stddev_{c}"))
    return wide.select(*out)


def describe_numeric(
    df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False
) -> DataFrame:
    """count, mean, std, min, quartiles and max, one row per numeric column."""
    columns = list(columns or numeric_columns(df))
    df = df.select(*[col(c) for c in columns])
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75], approximate=approximate)
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            col(f"count_{c}").alias("n"),
            col(f"avg_{c}").alias("mean"),
            col(f"stddev_{c}").alias("std"),
            col(f"min_{c}").alias("min"),
            *[
                F.lit(q).cast("double").alias(name)
                for q, name in zip(quartiles[c], ("p25", "p50", "p75"), strict=True)
            ],
            col(f"max_{c}").alias("max"),
        )
        for c in columns
    ]
    return df.agg(*_moments(df, columns)).select(F.inline(F.array(*entries)))
