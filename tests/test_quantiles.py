import random

import numpy as np
import pandas as pd
import pytest

from martlens.operators import quantiles
from martlens.operators.quantiles import exact_quantiles
from martlens.operators.statistics import (
    box_stats,
    correlation_matrix,
    histogram,
    identity_line,
    iqr_outliers,
    sample_rows,
    scatter_bins,
)

PROBABILITIES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


def shapes():
    rng = random.Random(3)
    n = 4_000
    yield "normal", [rng.gauss(0, 1) for _ in range(n)]
    yield "money", [round(rng.uniform(1, 500), 2) for _ in range(n)]
    yield "heavy tail", [rng.paretovariate(0.3) for _ in range(n)]
    yield "hot third", [7.0 if i % 3 == 0 else rng.uniform(0, 20) for i in range(n)]
    yield "hot at the edge", [5.0] * (n // 2) + [5.0 + rng.random() for _ in range(n // 2)]
    yield "few values", [float(rng.randint(0, 3)) for _ in range(n)]
    yield "constant", [2.5] * n
    yield "two rows", [1.0, 2.0]
    yield "one row", [1.0]


@pytest.mark.parametrize(
    ("name", "data"), list(shapes()), ids=lambda x: x if isinstance(x, str) else ""
)
@pytest.mark.parametrize("max_rows", [3, 100, 50_000])
def test_equals_sorted_interpolation(spark, name, data, max_rows):
    df = spark.createDataFrame([(x,) for x in data], "x double")
    got = exact_quantiles(df, ["x"], PROBABILITIES, accuracy=50, max_rows=max_rows)["x"]
    assert got == pytest.approx(list(np.quantile(data, PROBABILITIES)), rel=1e-12)


@pytest.mark.parametrize("max_rows", [3, 40, 300])
def test_many_ranks_at_once(spark, max_rows):
    rng = random.Random(max_rows)
    data = [(rng.gauss(0, 1), round(rng.expovariate(1), 2)) for _ in range(3_000)]
    df = spark.createDataFrame(data, "x double, y double")
    probabilities = [i / 40 for i in range(41)] + [0.0003, 0.1234567]
    got = exact_quantiles(df, ["x", "y"], probabilities, accuracy=20, max_rows=max_rows)
    for i, c in enumerate("xy"):
        want = np.quantile([row[i] for row in data], probabilities)
        assert got[c] == pytest.approx(list(want), rel=1e-12, abs=1e-12)


def test_columns_of_different_fill(spark):
    data = [(float(i), None if i % 2 else float(-i), None) for i in range(1_001)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    got = exact_quantiles(df, ["a", "b", "c"], [0.5], accuracy=50, max_rows=10)
    assert got == {"a": [500.0], "b": [-500.0], "c": [None]}


def test_full_bins_need_no_sketch(spark, monkeypatch):
    def sketch(*_):
        raise AssertionError("a sketch of a full bin")

    monkeypatch.setattr("martlens.operators.quantiles.F.percentile_approx", sketch)
    rng = random.Random(4)
    data = [(rng.uniform(900, 905), rng.choice([5e-324, 1e-323, 1.5e-323])) for _ in range(900)]
    data += [(float("inf"), -0.0), (float("-inf"), 0.0), (-1.7e308, 1.7e308), (1.7e308, 1e-320)]
    df = spark.createDataFrame(data, "x double, y double")
    got = exact_quantiles(df, ["x", "y"], [0.25, 0.5, 0.75], max_rows=2)
    for i, c in enumerate("xy"):
        assert got[c] == list(np.quantile([row[i] for row in data], [0.25, 0.5, 0.75]))


def test_infinities_and_zeros_fill_a_bin(spark):
    for value in (float("inf"), float("-inf"), 0.0):
        df = spark.createDataFrame([(value,)] * 9 + [(1.0,)], "x double")
        counts, _ = quantiles.bin_counts(df, ["x"])
        rank = 5 if value >= 0 else 2
        rank = rank if value else 3
        place = quantiles.place_ranks(counts["x"], [rank])
        assert quantiles.values_at(df, {"x": place}, max_rows=2) == {"x": {rank: value}}


def test_approximate(spark):
    df = spark.range(10_001).selectExpr("CAST(id AS double) AS x")
    got = exact_quantiles(df, ["x"], [0.5], approximate=True)["x"][0]
    assert abs(got - 5_000) <= 10


def test_outliers_and_box(spark):
    data = [float(x) for x in range(1, 12)] + [100.0, -80.0, None]
    df = spark.createDataFrame([(x,) for x in data], "x double")
    assert sorted(r["x"] for r in iqr_outliers(df, "x").collect()) == [-80.0, 100.0]
    box = box_stats(df, "x").first()
    assert (box["median"], box["whisker_low"], box["whisker_high"]) == (6.0, 1.0, 11.0)
    assert (box["n_outliers"], box["n_rows"]) == (2, 13)


def test_outliers_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert iqr_outliers(df, "x").count() == 0
    assert box_stats(df, "x").first()["n_rows"] == 0


def test_outlier_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "x")
    spark.range(1_000).selectExpr("CAST(id AS double) AS x").write.parquet(path)
    plan = iqr_outliers(spark.read.parquet(path), "x")._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(LessThan(x," in plan


def test_histogram_counts_everything(spark):
    rng = random.Random(9)
    data = [rng.uniform(-3, 8) for _ in range(1_000)]
    df = spark.createDataFrame([(x,) for x in [*data, None]], "x double")
    bins = {r["bin"]: r for r in histogram(df, "x", 30).collect()}
    want, edges = np.histogram(data, bins=30)
    assert [bins[i + 1]["n"] if i + 1 in bins else 0 for i in range(30)] == list(want)
    assert bins[30]["bin_high"] == pytest.approx(edges[-1])


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(4.0,), (4.0,)], "x double")
    assert [(r["bin"], r["n"]) for r in histogram(df, "x").collect()] == [(1, 2)]


def test_scatter_bins_count_everything(spark):
    df = spark.range(500).selectExpr("id % 7 AS x", "id AS y")
    assert scatter_bins(df, "x", "y", 10).groupBy().sum("n").first()[0] == 500


def test_correlation_is_pairwise_complete(spark):
    rng = random.Random(2)
    data = []
    for i in range(300):
        a = rng.gauss(1e6, 1)
        b = a * 2 + rng.gauss(0, 1) if i % 3 else None
        c = rng.gauss(0, 1) if i % 5 else float("nan")
        data.append((a, b, c, 3.3))
    df = spark.createDataFrame(data, "a double, b double, c double, d double")
    got = {(r["a"], r["b"]): r["r"] for r in correlation_matrix(df, list("abcd")).collect()}
    want = df.toPandas().corr()
    assert len(got) == 16
    for x in "abc":
        for y in "abc":
            assert got[x, y] == pytest.approx(want.loc[x, y], abs=1e-9)
            assert got[x, y] == got[y, x]
    assert got["a", "d"] is None and got["d", "d"] is None


def test_correlation_of_one_row(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert {r["r"] for r in correlation_matrix(df, ["a", "b"]).collect()} == {None}


def test_sample_is_repeatable(spark, rows):
    df = spark.range(2_000).selectExpr("id", "id * 2 AS y")
    first = rows(sample_rows(df, ["id"], 300))
    assert first == rows(sample_rows(df.repartition(7), ["id"], 300))
    assert len(first) == len(set(first)) == 300
    assert first != rows(sample_rows(df, ["id"], 300, seed=1))
    assert sample_rows(df.limit(5), ["id"], 300).count() == 5


def test_identity_line(spark):
    assert tuple(identity_line(spark.range(3, 9), "id").first()) == (3, 8)


def test_correlations_of_many_columns(spark):
    rng = random.Random(2)
    names = [f"v{i}" for i in range(34)]
    data = [
        [None if rng.random() < 0.02 else rng.gauss(0, 1) + r / 20 for _ in names]
        for r in range(60)
    ]
    df = spark.createDataFrame(data, ", ".join(f"{n} double" for n in names))
    want = pd.DataFrame(data, columns=names).corr()
    got = {(r["a"], r["b"]): r["r"] for r in correlation_matrix(df, names).collect()}
    assert len(got) == 34 * 34
    assert all(r == pytest.approx(want.loc[a, b]) for (a, b), r in got.items())
    with pytest.raises(ValueError, match="63 columns"):
        correlation_matrix(df, ["v0"] * 63)
