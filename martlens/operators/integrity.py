"""Orphan keys, value rules, ranges and late shipments."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.functions.columns import col, year_gap


def orphan_keys(
    child: DataFrame, parent: DataFrame, child_key: str, parent_key: str | None = None
) -> DataFrame:
    """Keys of ``child`` that ``parent`` lacks, with their row count, most first.

    Both sides are reduced to one row per key before they meet, so a hot key
    costs one row and only keys travel.  A null key has no parent either.
    """
    per_key = child.groupBy(col(child_key)).agg(F.count(F.lit(1)).alias("n_rows"))
    known = parent.select(col(parent_key or child_key).alias("__parent_key")).distinct()
    return per_key.join(
        known, col(child_key) == F.col("__parent_key"), "left_anti"
    ).orderBy(F.desc("n_rows"), col(child_key).asc_nulls_last())


def negative_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a negative value in any of the columns."""
    return df.filter(reduce(or_, [col(c) < 0 for c in columns]))


def nonpositive_rows(df: DataFrame, column: str) -> DataFrame:
    return df.filter(col(column) <= 0)


def late_shipments(
    df: DataFrame, order_date: str = "order_date", ship_date: str = "ship_date", over: int = 1
) -> DataFrame:
    """Rows shipped more than ``over`` calendar-year boundaries after the order."""
    return df.withColumn("years_to_ship", year_gap(order_date, ship_date)).filter(
        F.col("years_to_ship") > over
    )


def rule_violations(
    df: DataFrame,
    whole: str = "sales",
    parts: Sequence[str] = ("gross_profit", "cost"),
    tolerance: float | None = 0.005,
    decimals: int | None = None,
) -> DataFrame:
    """Rows where ``whole`` is not the sum of ``parts``.

    ``tolerance=None`` compares binary doubles for equality, as the plain rule
    does, which flags rounding noise.  ``decimals`` compares exact decimals.
    """
    if decimals is not None:
        def exact(c: str) -> Column:
            # via a finer decimal: 5.025 held as 5.0249999 is still a tie
            return col(c).cast(f"decimal(28,{decimals + 4})").cast(f"decimal(28,{decimals})")

        expected = sum((exact(p) for p in parts[1:]), exact(parts[0]))
        broken = exact(whole) != expected
    else:
        expected = sum((col(p) for p in parts[1:]), col(parts[0]))
        if tolerance is None:
            broken = col(whole) != expected
        else:
            broken = F.abs(col(whole) - expected) > tolerance
    return df.withColumn("expected", expected).filter(broken)
