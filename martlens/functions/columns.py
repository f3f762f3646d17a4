"""Column expressions: dates, ratios, rounding, presentation text.

Everything here is a built-in Spark expression, so it stays inside
whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS_PER_DAY = 86_400_000_000


def col(c: str | Column) -> Column:
    """A column from its name; names with a slash, dot or space are quoted."""
    return F.col(f"`{c}`") if isinstance(c, str) else c


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def missing(df: DataFrame, name: str) -> Column:
    """True where a value is null, or NaN in a floating column."""
    c = col(name)
    if is_floating(df.schema[name].dataType):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def present(df: DataFrame, name: str) -> Column:
    """The value with NaN turned into null, so aggregates skip it."""
    if is_floating(df.schema[name].dataType):
        return F.nanvl(col(name), F.lit(None).cast(df.schema[name].dataType))
    return col(name)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def row_count(df: DataFrame) -> Column:
    """Rows in a group: counted, or summed from a roll-up's ``n_rows``."""
    return F.sum("n_rows") if "n_rows" in df.columns else F.count(F.lit(1))


# -- dates ------------------------------------------------------------------


def parse_timestamp(c: str | Column, formats: Sequence[str]) -> Column:
    """Text to timestamp; text that fits none of the formats raises."""
    text = col(c)
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])
    complaint = F.raise_error(F.concat(F.lit("not a date: "), text)).cast("timestamp")
    return F.when(parsed.isNull() & text.isNotNull(), complaint).otherwise(parsed)


def year_gap(start: str | Column, end: str | Column) -> Column:
    """Calendar-year boundaries crossed, as a warehouse year difference counts."""
    return F.year(col(end)) - F.year(col(start))


def elapsed_days(start: str | Column, end: str | Column) -> Column:
    """Whole days between two dates or timestamps, floored.

    23:00 to 01:00 of the next day is 0 days, and the reverse is -1.
    """
    micros = F.timestamp_diff("MICROSECOND", col(start), col(end))
    return F.floor(micros / F.lit(MICROS_PER_DAY)).cast("int")


def date_parts(order_date: str | Column) -> dict[str, Column]:
    """The calendar features of an order date."""
    d = col(order_date)
    return {
        "order_year": F.year(d),
        "order_month": F.month(d),
        "order_day": F.dayofmonth(d),
        "order_weekday": F.date_format(d, "EEEE"),
        "quarter": F.quarter(d),
    }


def month_start(year: str | Column, month: str | Column) -> Column:
    return F.make_date(col(year), col(month), F.lit(1))


def month_short_name(month: str | Column) -> Column:
    """1 -> Jan ... 12 -> Dec."""
    return F.date_format(F.make_date(F.lit(2000), col(month), F.lit(1)), "MMM")


def is_year_end(month: str | Column) -> Column:
    return (col(month) == 12).cast("int")


# -- numbers ----------------------------------------------------------------


def ratio(part: str | Column, whole: str | Column) -> Column:
    """part / whole, null where the whole is zero."""
    return F.try_divide(col(part).cast("double"), col(whole).cast("double"))


def percent_or_zero(part: str | Column, whole: str | Column) -> Column:
    """part as a percentage of whole, 0 where the whole is zero or missing."""
    return F.coalesce(ratio(part, whole) * 100, F.lit(0.0))


def round_half_even(c: str | Column, places: int) -> Column:
    """The tie rule of array libraries: 0.25 -> 0.2."""
    return F.bround(col(c), places)


def round_half_up(c: str | Column, places: int) -> Column:
    """The tie rule of SQL: 0.25 -> 0.3."""
    return F.round(col(c), places)


# -- presentation -----------------------------------------------------------


def dollars(c: str | Column) -> Column:
    return F.format_string("$%,.2f", col(c).cast("double"))


def thousands(c: str | Column) -> Column:
    return F.format_string("%,d", F.round(col(c)).cast("bigint"))


def percent_text(c: str | Column) -> Column:
    return F.format_string("%.1f%%", col(c).cast("double"))
