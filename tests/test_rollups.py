import math
import random
import re

import pytest
from pyspark.sql import functions as F

from martlens.operators.filters import dashboard_filter
from martlens.operators.statistics import correlation_matrix
from martlens.plans import dashboard, reports
from martlens.plans.dashboard import CORRELATED, DIMENSIONS, MEASURES
from martlens.operators.quantiles import bin_of, bin_range
from martlens.plans.rollups import RollupStore
from martlens.plans.star import Star, retail_star
from martlens.session import scratch_path

SALES = (
    "row_id long, order_id long, order_date timestamp_ntz, ship_date timestamp_ntz, "
    "ship_mode string, region string, division string, product_id string, product_name string, "
    "sales double, units long, gross_profit double, cost double"
)


@pytest.fixture(scope="module")
def days(spark):
    """Four days of lines with gaps, zeros, negatives, a NaN and a constant corner."""
    rng = random.Random(8)
    rows = []
    for i in range(900):
        day = rng.randrange(4)
        region = rng.choice(["East", "West", None, "North"])
        sales = rng.choice([0.0, -3.5, rng.lognormvariate(4, 2), float("nan"), None, 12.25])
        if region == "North":
            sales = 7.1
        rows.append((
            day, i, rng.randrange(150), f"202{2 + day % 2}-0{1 + day}-03 10:00:00", rng.choice("AB"),
            region, rng.choice(["Toys", "Sugar"]), rng.choice("pqr"), sales, rng.randrange(1, 9),
            rng.choice([None, rng.gauss(5, 2)]), rng.random() * 1e6,
        ))
    df = spark.createDataFrame(
        rows, "day int, row_id long, order_id long, order_date string, ship_mode string, "
              "region string, division string, product_id string, sales double, units long, "
              "gross_profit double, cost double")  # fmt: skip
    df = df.withColumns({
        "order_date": F.col("order_date").cast("timestamp_ntz"),
        "ship_date": F.expr("CAST(order_date AS timestamp_ntz) + make_dt_interval(row_id % 7)"),
        "product_name": F.concat(F.lit("name "), "product_id"),
    })
    path = scratch_path(spark, "days")
    df.write.partitionBy("day").parquet(path)
    return path


@pytest.fixture(scope="module")
def stars(spark, days):
    products = spark.createDataFrame(
        [(d, f"name {p}", p, "F", 2.0, 1.0) for p in "pqr" for d in ("Toys", "Sugar")],
        "division string, product_name string, product_id string, factory string, "
        "unit_price double, unit_cost double",
    )
    factories = spark.createDataFrame([("F", 1.0, 2.0)], "factory string, latitude double, longitude double")
    targets = spark.createDataFrame([("Toys", 9.0)], "division string, target double")

    def star(day=None):
        path = days if day is None else f"{days}/day={day}"
        fact = spark.read.schema(SALES).parquet(path).drop("day")
        return retail_star(fact, products, factories, targets)

    return star


@pytest.fixture(scope="module")
def store(spark, stars):
    store = RollupStore(spark, scratch_path(spark, "store"))
    for day in range(4):
        store.append(stars(day), f"day {day}")
    return store


def near(a, b):
    if a is None or b is None:
        return a is b
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def same(got, want, rows):
    a, b = rows(got.select(sorted(got.columns))), rows(want.select(sorted(want.columns)))
    key = lambda r: tuple(repr(round(x, 4)) if isinstance(x, float) else repr(x) for x in r)
    a, b = sorted(a, key=key), sorted(b, key=key)
    assert len(a) == len(b)
    assert all(all(map(near, x, y)) for x, y in zip(a, b, strict=True)), (a[:3], b[:3])


CHOICES = [
    (None, "All", "All"), ([2022], "East", "All"), ([2022, 2023], "All", "Sugar"),
    ([2023], "West", "Toys"), (None, "North", "All"), ([1999], "All", "All"), ([], "All", "All"),
]


def test_days_appended_equal_a_rebuild(stars, store, rows):
    same(store.sums(), stars().rollup(DIMENSIONS, MEASURES), rows)
    page = dashboard.dashboard(store.sums(), [2022], "East")
    same(page["kpis"], reports.kpi_dashboard(
        dashboard_filter(stars().merged(), [2022], "East")), rows)


@pytest.mark.parametrize("years, region, division", CHOICES)
def test_correlations_of_any_choice(stars, store, rows, years, region, division):
    lines = dashboard_filter(stars().merged(), years, region, division)
    want = correlation_matrix(lines, CORRELATED)
    same(store.correlations(years, region, division), want, rows)


@pytest.mark.parametrize("years, region, division", CHOICES)
def test_quantiles_and_headline_of_any_choice(stars, store, rows, years, region, division):
    lines = dashboard_filter(stars().merged(), years, region, division)
    probabilities = [0.0, 0.25, 0.5, 0.9, 1.0]
    for measure in ("sales", "units"):
        values = lines.filter(f"NOT isnan({measure})").select(F.col(measure).cast("double"))
        want = values.agg(F.percentile(measure, probabilities)).first()[0] or [None] * 5
        got = store.quantiles(stars(), measure, probabilities, years, region, division)
        assert all(map(near, got, want)), (got, want)
    same(store.headline(stars(), years, region, division), reports.kpi_headline(lines), rows)


@pytest.mark.parametrize("years, region, division", CHOICES)
def test_distinct_orders_of_any_choice(stars, store, rows, years, region, division):
    lines = dashboard_filter(stars().merged(), years, region, division)
    want = lines.agg(F.countDistinct("order_id").alias("n_orders"))
    same(store.distinct_orders((), years, region, division), want, rows)
    want = lines.groupBy("region", "division").agg(F.countDistinct("order_id").alias("n_orders"))
    same(store.distinct_orders(("region", "division"), years, region, division), want, rows)


def test_a_choice_reads_only_the_store(store, days):
    plans = [
        store.distinct_orders((), [2022], "East"), store.sums(), store.read("moments"),
    ]
    for df in plans:
        files = " ".join(df.inputFiles())
        assert files and days not in files


def test_an_append_reads_only_the_new_lines(spark, stars, store, days):
    read = []

    class Watched(Star):
        def select(self, *columns):
            df = super().select(*columns)
            read.extend(df.inputFiles())
            return df

    new = stars(0)
    once = RollupStore(spark, scratch_path(spark, "store"))
    once.append(stars(1), "b")
    once.append(Watched(new.fact, new.lookups), "a")
    assert read and all("/day=0/" in f for f in read if days in f)


def test_the_finish_of_a_quantile_is_pruned(stars, store):
    df = store._near_bins(stars(), "sales", [100_300], [2022], "All", "All")
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = re.findall(r"PushedFilters: \[[^\n]*", plan)  # long lists are cut short
    assert any("GreaterThanOrEqual(sales" in x for x in pushed), plan


def test_repeating_replacing_and_compacting(spark, stars, rows):
    store = RollupStore(spark, scratch_path(spark, "store"))
    with pytest.raises(LookupError):
        store.sums()
    store.append(stars(3), "a")
    store.append(stars(1), "b")
    store.append(stars(0), "a")  # the batch was wrong at first
    store.append(stars(1), "b")  # the job ran twice
    want = Star(stars(0).merged().unionByName(stars(1).merged()), ())
    same(store.sums(), want.rollup(DIMENSIONS, MEASURES), rows)
    matrix, orders = store.correlations(), store.distinct_orders(("region",))
    held = (matrix.collect(), orders.collect())
    store.compact()
    store.compact()
    assert store.batches() == ["a", "b"] and len(store.pointer.state()["data"]) == 1
    same(store.correlations(), spark.createDataFrame(held[0], matrix.schema), rows)
    same(store.distinct_orders(("region",)), spark.createDataFrame(held[1], orders.schema), rows)
    same(store.sums(), want.rollup(DIMENSIONS, MEASURES), rows)
    assert near(store.quantiles(want, "sales", [0.5])[0], want.fact.filter("NOT isnan(sales)").agg(
        F.percentile("sales", 0.5)).first()[0])
    with pytest.raises(ValueError, match="compacted"):
        store.append(stars(0), "a")
    store.append(stars(2), "c")
    assert store.batches() == ["a", "b", "c"]


def test_an_empty_day(spark, stars, rows):
    store = RollupStore(spark, scratch_path(spark, "store"))
    new = stars(0)
    store.append(Star(new.fact.limit(0), new.lookups), "empty")
    assert store.quantiles(new, "sales", [0.5]) == [None]
    assert {r.r for r in store.correlations().collect()} == {None}
    assert store.distinct_orders().first()[0] == 0
    same(store.headline(new, [1999]), reports.kpi_headline(new.fact.limit(0)), rows)
    store.append(new, "day")
    assert any(store.pointer.state()["origins"])
    same(store.sums(), new.rollup(DIMENSIONS, MEASURES), rows)
    same(store.correlations(), correlation_matrix(new.merged(), CORRELATED), rows)


def test_orders_named_by_a_text(spark, stars, rows):
    def named(star):
        return Star(star.fact.withColumn("order_id", F.concat(F.lit("US-"), "order_id")), star.lookups)

    store = RollupStore(spark, scratch_path(spark, "store"), keep=1)
    for day in (0, 1, 0, 2):  # names of a batch that is replaced stay numbered
        store.append(named(stars(day)), f"day {day}")
    lines = stars(0).merged().unionByName(stars(1).merged()).unionByName(stars(2).merged())
    lines = lines.filter("region = 'East'")
    want = lines.groupBy("division").agg(F.countDistinct("order_id").alias("n_orders"))
    for _ in range(2):
        same(store.distinct_orders(("division",), None, "East"), want, rows)
        store.compact()
    with pytest.raises(TypeError, match="another type"):
        store.append(stars(3), "day 3")
    store.append(named(stars(3)), "day 3")
    assert store.distinct_orders().first()[0] == stars().merged().select("order_id").distinct().count()


def test_bins_rise_with_the_numbers(spark):
    rng = random.Random(1)
    numbers = [0.0, 5e-324, 1e-300, 1.7e308, float("inf"), 1.0, 1.01, 1.01**2]
    numbers += [rng.lognormvariate(0, 30) for _ in range(3_000)]
    numbers = sorted({s * x for x in numbers for s in (1, -1)})
    df = spark.createDataFrame([(x,) for x in numbers], "v double")
    found = [(r.v, r.b) for r in df.select("v", bin_of(F.col("v")).alias("b")).collect()]
    found.sort()
    assert [b for _, b in found] == sorted(b for _, b in found)
    assert all(bin_range(b)[0] <= v <= bin_range(b)[1] for v, b in found)
