import datetime as dt

import pytest
from pyspark.sql import functions as F

from martlens.functions import columns as c


def one(spark, expr, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(expr.alias("v")).first()["v"]


def test_year_gap_counts_boundaries(spark):
    row = (dt.date(2021, 12, 31), dt.date(2022, 1, 1))
    assert one(spark, c.year_gap("a", "b"), "a date, b date", row) == 1


@pytest.mark.parametrize(
    ("start", "end", "days"),
    [
        ("2024-01-01 23:00:00", "2024-01-02 01:00:00", 0),
        ("2024-01-02 01:00:00", "2024-01-01 23:00:00", -1),
        ("2024-01-01 00:00:00", "2024-01-04 00:00:00", 3),
        ("2024-01-01 00:00:00", "2024-01-01 00:00:00", 0),
    ],
)
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_elapsed_days_floor(spark, start, end, days, kind):
    df = spark.createDataFrame([(start, end)], "a string, b string").select(
        F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b")
    )
    assert df.select(c.elapsed_days("a", "b")).first()[0] == days


def test_elapsed_days_of_dates(spark):
    row = (dt.date(2024, 2, 28), dt.date(2024, 3, 1))
    assert one(spark, c.elapsed_days("a", "b"), "a date, b date", row) == 2


def test_date_parts(spark):
    df = spark.createDataFrame([(dt.date(2024, 11, 5),)], "d date")
    got = df.select(*[e.alias(n) for n, e in c.date_parts("d").items()]).first()
    assert tuple(got) == (2024, 11, 5, "Tuesday", 4)


def test_month_names_and_starts(spark):
    names = [
        r["m"]
        for r in spark.range(1, 13).select(c.month_short_name(F.col("id").cast("int")).alias("m"))
        .collect()
    ]
    assert names == "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
    assert one(spark, c.month_start("y", "m"), "y int, m int", (2023, 4)) == dt.date(2023, 4, 1)
    assert one(spark, c.is_year_end("x"), row=(12,)) == 1


def test_rounding_ties(spark):
    assert one(spark, c.round_half_even("x", 1), "x double", (0.25,)) == 0.2
    assert one(spark, c.round_half_up("x", 1), "x double", (0.25,)) == 0.3
    assert one(spark, c.round_half_even("x", 0), "x double", (2.5,)) == 2.0


def test_ratios(spark):
    assert one(spark, c.ratio("a", "b"), "a double, b double", (1.0, 0.0)) is None
    assert one(spark, c.percent_or_zero("a", "b"), "a double, b double", (1.0, 0.0)) == 0.0
    assert one(spark, c.percent_or_zero("a", "b"), "a double, b double", (1.0, 4.0)) == 25.0


def test_texts(spark):
    assert one(spark, c.dollars("x"), "x double", (1234567.891,)) == "$1,234,567.89"
    assert one(spark, c.thousands("x"), "x bigint", (1234567,)) == "1,234,567"
    assert one(spark, c.percent_text("x"), "x double", (12.34,)) == "12.3%"


def test_parse_timestamp(spark):
    df = spark.createDataFrame([("2024-01-31",), ("1/31/2024",), (None,)], "t string")
    got = df.select(c.parse_timestamp("t", ("yyyy-MM-dd", "M/d/yyyy")).alias("v")).collect()
    assert [r["v"] for r in got] == [dt.datetime(2024, 1, 31)] * 2 + [None]


def test_parse_timestamp_refuses_garbage(spark):
    df = spark.createDataFrame([("soon",)], "t string")
    with pytest.raises(Exception, match="not a date: soon"):
        df.select(c.parse_timestamp("t", ("yyyy-MM-dd",))).collect()


def test_missing_counts_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert df.filter(c.missing(df, "x")).count() == 2
    assert df.select(F.count(c.present(df, "x"))).first()[0] == 1
