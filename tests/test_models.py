import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from martlens.models import features, training
from martlens.models.evaluation import regression_metrics, residual_histogram
from martlens.models.scoring import derive_scenarios, score_scenarios
from martlens.models.training import (
    ModelConfig,
    _fold_refits,
    cross_validate,
    encoding_stages,
    fit_placed,
    fitting_stages,
    group_mb,
    load,
    placed,
    save,
    train,
    training_frame,
)
from martlens.session import scratch_path

SCHEMA = (
    "row_id int, division string, region string, ship_mode string, units double, cost double, "
    "unit_price double, unit_cost double, shipping_days int, order_month int, quarter int, "
    "gross_profit double, sales double"
)


def make_rows(n=600, seed=8, noise=0.0):
    rng = random.Random(seed)
    for i in range(n):
        units, price, unit_cost = rng.randint(1, 20), rng.uniform(1, 9), rng.uniform(0.2, 3)
        d, r, m = rng.choice("ABC"), rng.choice(["E", "W"]), rng.choice(["air", "sea"])
        days, month = rng.randint(1, 10), rng.randint(1, 12)
        profit, cost = units * (price - unit_cost), units * unit_cost
        sales = 3 * units + 2 * cost - price + "ABC".index(d) + 5 + rng.gauss(0, 1) * noise
        yield (i, d, r, m, float(units), cost, price, unit_cost, days, month, (month + 2) // 3,
               profit, sales)


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(list(make_rows()), SCHEMA)


@pytest.fixture(scope="module")
def noisy(spark):
    return spark.createDataFrame(list(make_rows(noise=4.0)), SCHEMA)


def test_split_ignores_partitioning(lines):
    a, b = features.hash_split(lines, ["row_id"], 0.25)
    c, d = features.hash_split(lines.repartition(9), ["row_id"], 0.25)
    ids = [sorted(r["row_id"] for r in df.collect()) for df in (a, b, c, d)]
    assert ids[0] == ids[2] and ids[1] == ids[3]
    assert sorted(ids[0] + ids[1]) == list(range(600))
    assert 100 < len(ids[1]) < 200


def test_folds_cover_everything(lines):
    counts = features.with_fold(lines, ["row_id"]).groupBy("fold").count().collect()
    assert {r["fold"] for r in counts} == set(range(5))
    assert sum(r["count"] for r in counts) == 600


def test_label_codes_are_sorted(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("b",)], "division string")
    model = features.label_indexer(["division"]).fit(df)
    book = features.label_table(model, df)
    assert [(r["label"], r["code"]) for r in book.orderBy("code").collect()] == [
        ("a", 0), ("b", 1), ("c", 2),
    ]
    other = spark.createDataFrame([("z",)], "division string")
    with pytest.raises(Exception, match="[Uu]nseen"):
        model.transform(other).collect()


def test_impute_and_standardize(spark):
    df = spark.createDataFrame(
        [(1.0, 7.0), (3.0, 7.0), (None, 7.0), (float("nan"), 7.0)], "x double, k double"
    )
    filled = features.impute_mean(df, ["x"], df)
    assert [r["x"] for r in filled.collect()] == [1.0, 3.0, 2.0, 2.0]
    scaled = features.standardize(filled, ["x", "k"], filled).collect()
    assert [r["x"] for r in scaled] == pytest.approx([-np.sqrt(2), np.sqrt(2), 0, 0])
    assert {r["k"] for r in scaled} == {0.0}


def test_linear_recovers_planted_coefficients(lines):
    fitted = train(lines, ModelConfig("linear"), ["row_id"])
    terms = {r["term"]: r["value"] for r in fitted.coefficients().collect()}
    assert terms["units"] == pytest.approx(3) and terms["cost"] == pytest.approx(2)
    assert terms["unit_price"] == pytest.approx(-1) and terms["division"] == pytest.approx(1)
    assert terms["intercept"] == pytest.approx(5) and terms["quarter"] == pytest.approx(0, abs=1e-6)
    for row in fitted.metrics().collect():
        assert row["r2"] == pytest.approx(1) and row["mae"] < 1e-6


def test_linear_equals_least_squares(noisy):
    config = ModelConfig("linear")
    fitted = train(noisy, config, ["row_id"])
    sides = {}
    for name, df in (("train", fitted.train), ("test", fitted.test)):
        pdf = df.toPandas()
        x = np.column_stack(
            [np.ones(len(pdf))]
            + [
                pdf[c].astype("category").cat.codes if c in features.CATEGORICAL else pdf[c]
                for c in config.features
            ]
        ).astype(float)
        sides[name] = (x, pdf["sales"].to_numpy())
    beta = np.linalg.lstsq(*sides["train"], rcond=None)[0]
    got = {r["side"]: r for r in fitted.metrics().collect()}
    for name, (x, y) in sides.items():
        error = y - x @ beta
        assert got[name]["r2"] == pytest.approx(1 - (error**2).sum() / ((y - y.mean()) ** 2).sum())
        assert got[name]["mae"] == pytest.approx(np.abs(error).mean())
        assert got[name]["rmse"] == pytest.approx(np.sqrt((error**2).mean()))
        assert got[name]["mape"] == pytest.approx(np.abs(error / (y + 1e-9)).mean() * 100)
        assert got[name]["n"] == len(y)


def test_one_pass_folds_equal_refits(noisy):
    config = ModelConfig("linear")
    data = training_frame(noisy, config, ["row_id"]).cache()
    fast = {r["fold"]: r["r2"] for r in cross_validate(data, config, ["row_id"]).collect()}
    marked = features.with_fold(data, ["row_id"], 5)
    stages = encoding_stages(config, marked)
    encoded = Pipeline(stages=stages).fit(marked).transform(marked)
    slow = _fold_refits(encoded, config, ["row_id"], 5)
    assert fast == pytest.approx({r["fold"]: r["r2"] for r in slow.collect()}, abs=1e-9)


def test_forest(noisy, spark):
    config = ModelConfig("forest", trees=20, depth=6)
    fitted = train(noisy, config, ["row_id"])
    r2 = {r["side"]: r["r2"] for r in fitted.metrics().collect()}
    assert r2["test"] > 0.85 and r2["train"] >= r2["test"]
    ranked = fitted.importances().collect()
    assert ranked[0]["feature"] == "cost"
    assert sum(r["importance"] for r in ranked) == pytest.approx(1)
    assert residual_histogram(fitted.predict(fitted.test)).groupBy().sum("n").first()[0] == (
        fitted.test.count()
    )
    path = scratch_path(spark, "model")
    save(fitted, path)
    again = load(path).transform(fitted.test)
    a = {r["row_id"]: r["prediction"] for r in again.collect()}
    b = {r["row_id"]: r["prediction"] for r in fitted.predict(fitted.test).collect()}
    assert a == b


def test_forest_folds(noisy):
    config = ModelConfig("forest", trees=5, depth=5)
    data = training_frame(noisy, config, ["row_id"]).cache()
    scores = cross_validate(data, config, ["row_id"], 3).collect()
    assert [r["fold"] for r in scores] == [0, 1, 2]
    assert all(r["r2"] > 0.6 for r in scores)


def test_unknown_algorithm(lines):
    with pytest.raises(ValueError, match="unknown algorithm"):
        train(lines, ModelConfig("boost"), ["row_id"])


def test_missing_values_imputed_or_dropped(spark):
    data = [
        tuple(None if (j in (1, 4) and r[0] % 10 == 0) else v for j, v in enumerate(r))
        for r in make_rows()
    ]
    data.append((*data[1][:-1], None))  # no label: nothing to learn from
    df = spark.createDataFrame(data, SCHEMA)
    kept = train(df, ModelConfig("linear"), ["row_id"])
    assert kept.rows.count() == 600
    assert kept.metrics().count() == 2
    dropped = train(df, ModelConfig("linear", missing="drop"), ["row_id"])
    assert dropped.rows.count() == 540


def test_metrics_by_hand(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0), (2.0, 2.0), (4.0, 3.0)], "sales double, prediction double"
    )
    row = regression_metrics(df).first()
    assert row["mae"] == pytest.approx(2 / 3) and row["rmse"] == pytest.approx(np.sqrt(2 / 3))
    assert row["r2"] == pytest.approx(1 - 2 / (14 / 3))
    assert row["mape"] == pytest.approx((1 + 0 + 0.25) / 3 * 100)


def test_scenarios(spark, lines):
    config = ModelConfig("linear", features.FEATURES_WITH_PROFIT, missing="drop")
    exact = lines.withColumn("sales", lines.gross_profit + lines.cost)
    fitted = train(exact, config, ["row_id"])
    columns = (
        "name string, division string, region string, ship_mode string, units int, "
        "unit_price double, unit_cost double, shipping_days int, order_month int, quarter int"
    )
    orders = spark.createDataFrame(
        [
            ("a", "A", "E", "air", 5, 3.5, 1.0, 3, 2, 1),
            ("b", "B", "W", "sea", 500, 3.0, 1.0, 3, 2, 1),
        ],
        columns,
    )
    got = {r["name"]: r for r in score_scenarios(fitted.model, orders, config.features).collect()}
    assert got["a"]["predicted_sales"] == pytest.approx(17.5)
    assert got["a"]["gross_profit"] == pytest.approx(12.5) and got["a"]["in_range"]
    assert got["b"]["predicted_sales"] == pytest.approx(1_500) and not got["b"]["in_range"]
    assert derive_scenarios(orders).filter("in_range").count() == 1
    unseen = spark.createDataFrame([("c", "Z", "E", "air", 5, 3.5, 1.0, 3, 2, 1)], columns)
    with pytest.raises(Exception, match="[Uu]nseen"):
        score_scenarios(fitted.model, unseen, config.features).collect()


def with_gaps(spark):
    rows = [
        tuple(None if (j in (1, 4) and r[0] % 7 == 0) else v for j, v in enumerate(r))
        for r in make_rows()
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_folds_follow_one_rule_on_rows_with_gaps(spark):
    config = ModelConfig("linear")
    data = training_frame(with_gaps(spark), config, ["row_id"]).cache()
    fast = {r["fold"]: r["r2"] for r in cross_validate(data, config, ["row_id"]).collect()}
    marked = features.with_fold(data, ["row_id"], 5, config.seed)
    encoded = Pipeline(stages=encoding_stages(config, marked)).fit(marked).transform(marked)
    slow = _fold_refits(encoded, config, ["row_id"], 5)
    assert fast == pytest.approx({r["fold"]: r["r2"] for r in slow.collect()}, abs=1e-9)


def test_a_category_of_one_side_stops_nothing(spark, lines):
    keys, config = ["row_id"], ModelConfig("linear", missing="drop")
    in_test = lines.filter(features.test_condition(keys)).first()["row_id"]
    odd = lines.withColumn(
        "division", F.when(F.col("row_id") == in_test, "Only here").otherwise(F.col("division"))
    )
    assert train(odd, config, keys).metrics().count() == 2
    data = training_frame(odd, config, keys)
    for algorithm in ("linear", "forest"):
        one = ModelConfig(algorithm, missing="drop", trees=2)
        assert cross_validate(data, one, keys, 3).count() == 3


def test_a_forest_does_not_depend_on_partitions(spark, noisy):
    config = ModelConfig("forest", trees=5, depth=4)
    scores = [
        [tuple(r) for r in train(noisy.repartition(n), config, ["row_id"]).metrics()
         .orderBy("side").collect()]
        for n in (2, 8)
    ]
    assert [r[2] for r in scores[0]] == pytest.approx([r[2] for r in scores[1]], abs=1e-12)


@pytest.mark.parametrize("algorithm", ["linear", "forest"])
def test_scoring_with_the_default_features_can_be_written(spark, lines, algorithm):
    config = ModelConfig(algorithm, trees=2)
    fitted = train(lines, config, ["row_id"])
    order = spark.createDataFrame(
        [("A", "E", "air", 5, 3.5, 1.0, 3, 2, 1)],
        "division string, region string, ship_mode string, units int, unit_price double, "
        "unit_cost double, shipping_days int, order_month int, quarter int",
    )
    out = score_scenarios(fitted.model, order, config.features)
    path = scratch_path(spark, "scored")
    out.write.parquet(path)
    assert len(set(out.columns)) == len(out.columns)
    assert spark.read.parquet(path).first()["gross_profit"] == pytest.approx(12.5)


def test_small_groups_of_nodes_grow_the_same_trees(spark, noisy, monkeypatch):
    config = ModelConfig("forest", trees=12, depth=5)
    used = []

    class Spied(training.RandomForestRegressor):
        def fit(self, *args, **kwargs):
            used.append(self.getMaxMemoryInMB())
            return super().fit(*args, **kwargs)

    monkeypatch.setattr(training, "RandomForestRegressor", Spied)
    data = training_frame(noisy, config, ["row_id"]).localCheckpoint()
    stages = encoding_stages(config, data)
    few = fit_placed(config, stages, data, ["row_id"])
    many = Pipeline(stages=[*stages, *fitting_stages(config, 256)]).fit(placed(data, ["row_id"]))
    assert used == [1, 256]

    def trees(model):
        return model.stages[-1].toDebugString.split("\n", 1)[1]

    assert trees(few) == trees(many)


def test_rows_on_disk_take_fewer_passes(spark):
    assert group_mb(spark, 1_000, 100) == 1
    assert group_mb(spark, 10**9, 100) == 8


def test_a_fit_places_its_rows_once(spark, noisy):
    config = ModelConfig("forest", trees=3, depth=2)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(value):
        seen.add(1)
        return value

    data = training_frame(noisy, config, ["row_id"])
    rows = data.withColumn("sales", counted("sales"))
    fit_placed(config, encoding_stages(config, data), rows, ["row_id"])
    assert seen.value == 600
