"""Optional-parameter filters and the option lists behind them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.functions.columns import col

ALL = "All"


def dashboard_filter(
    df: DataFrame,
    years: Sequence[int] | None = None,
    region: str = ALL,
    division: str = ALL,
    date_column: str | None = None,
) -> DataFrame:
    """Rows of the chosen years, region and division; ``All`` does not filter.

    With ``date_column`` the years also become a date range, which reaches the
    file scan and skips row groups that a filter on a year expression cannot.
    """
    if years is not None:
        df = df.filter(F.col("order_year").isin(*years) if years else F.lit(False))
        if date_column and years:
            first = F.make_timestamp_ntz(F.lit(min(years)), *map(F.lit, (1, 1, 0, 0, 0)))
            after = F.make_timestamp_ntz(F.lit(max(years) + 1), *map(F.lit, (1, 1, 0, 0, 0)))
            kind = df.schema[date_column].dataType.simpleString()
            df = df.filter(
                (col(date_column) >= first.cast(kind)) & (col(date_column) < after.cast(kind))
            )
    if region != ALL:
        df = df.filter(F.col("region") == region)
    if division != ALL:
        df = df.filter(F.col("division") == division)
    return df


def filter_options(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-null values of each column, as (column, value), one pass."""
    entries = [
        F.struct(F.lit(c).alias("column_name"), col(c).cast("string").alias("value"))
        for c in columns
    ]
    return (
        df.select(F.inline(F.array(*entries)))
        .filter(F.col("value").isNotNull())
        .distinct()
        .orderBy("column_name", "value")
    )


def has_rows(df: DataFrame) -> bool:
    return not df.isEmpty()
