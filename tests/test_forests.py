import gc
import time

import pytest
from conftest import SF
from pyspark.ml import Pipeline, regression
from pyspark.sql import functions as F
from test_models import SCHEMA, make_rows

from martlens.models import forests, training
from martlens.models.training import (
    ModelConfig,
    encoding_stages,
    fit_placed,
    kept_placed,
    train,
    training_frame,
)
from martlens.session import release_shuffles
from martlens.testbed.catalog import QUERIES


@pytest.fixture(scope="module")
def noisy(spark):
    return spark.createDataFrame(list(make_rows(noise=4.0)), SCHEMA)


def grown(spark, noisy, config, monkeypatch, regressor=forests.RandomForestRegressor):
    """The fitted forest, and the stages its fit ran as (tasks per stage)."""
    monkeypatch.setattr(training, "RandomForestRegressor", regressor)
    data = training_frame(noisy, config, ["row_id"]).localCheckpoint()
    stages = encoding_stages(config, data)
    group = f"fit-{regressor.__module__}-{id(data)}"
    spark.sparkContext.setJobGroup(group, "a fit")
    try:
        model = fit_placed(config, stages, data, ["row_id"]).stages[-1]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(i) for i in tracker.getJobIdsForGroup(group)]
    tasks = [tracker.getStageInfo(i) for j in jobs for i in j.stageIds]
    return model, len(jobs), [s.numTasks for s in tasks if s]


def trees(model):
    return model.toDebugString.split("\n", 1)[1]


@pytest.mark.parametrize(
    "config",
    [
        ModelConfig("forest", trees=12, depth=5),
        ModelConfig("forest", ("units", "cost"), trees=30, depth=3, bins=16),
        ModelConfig("forest", trees=3, depth=8),
        ModelConfig("forest", trees=1, depth=3),  # left to Spark
    ],
)
def test_the_trees_are_sparks_own(spark, noisy, monkeypatch, config):
    own, _, _ = grown(spark, noisy, config, monkeypatch)
    sparks, _, _ = grown(spark, noisy, config, monkeypatch, regression.RandomForestRegressor)
    assert trees(own) == trees(sparks)
    assert own.featureImportances == sparks.featureImportances
    assert own.getMaxDepth() == config.depth and own.getLabelCol() == "sales"


def test_a_forest_takes_one_pass_per_level(spark, noisy, monkeypatch):
    config = ModelConfig("forest", trees=100, depth=5)
    _, jobs, _ = grown(spark, noisy, config, monkeypatch)
    _, sparks, _ = grown(spark, noisy, config, monkeypatch, regression.RandomForestRegressor)
    assert jobs <= 20 < 30 < sparks


def test_sums_leave_a_bounded_number_of_tasks(spark, noisy, monkeypatch):
    """They were shuffled once per partition of the rows."""
    monkeypatch.setattr(training, "ROWS_PER_PARTITION", 4)
    config = ModelConfig("forest", trees=8, depth=4)
    own, _, tasks = grown(spark, noisy, config, monkeypatch)
    assert max(tasks) == 150 and tasks.count(72) >= 4
    sparks, _, _ = grown(spark, noisy, config, monkeypatch, regression.RandomForestRegressor)
    assert [t.numNodes for t in own.trees] == [t.numNodes for t in sparks.trees]
    assert own.featureImportances.toArray() == pytest.approx(
        sparks.featureImportances.toArray(), abs=1e-9
    )


def test_deep_levels_are_split_over_passes(spark, noisy, monkeypatch):
    config = ModelConfig("forest", trees=4, depth=10, bins=128)
    source = forests.files("martlens.models").joinpath("ForestGrowth.java").read_text("utf-8")

    class Small:
        def joinpath(self, name):
            return self

        def read_text(self, encoding):
            return source.replace("PASS_BYTES = 64L << 20", "PASS_BYTES = 64L << 10")

    at_once, few, _ = grown(spark, noisy, config, monkeypatch)
    monkeypatch.setattr(forests, "files", lambda package: Small())
    small, _ = forests.compiled(spark)
    monkeypatch.setattr(forests, "_growth", lambda application: small)
    in_turn, many, _ = grown(spark, noisy, config, monkeypatch)
    assert many > few + 20
    assert trees(at_once) == trees(in_turn)


def test_a_constant_label_and_constant_features(spark, noisy, monkeypatch):
    config = ModelConfig("forest", trees=4, depth=3)
    same = [
        F.col(c) if c in ("row_id", "sales") else F.lit(1).cast(t).alias(c)
        for c, t in noisy.dtypes
    ]
    for flat in (noisy.withColumn("sales", F.lit(7.0)), noisy.select(*same)):
        own, _, _ = grown(spark, flat, config, monkeypatch)
        sparks, _, _ = grown(spark, flat, config, monkeypatch, regression.RandomForestRegressor)
        assert trees(own) == trees(sparks)


def test_a_fit_keeps_only_what_it_reads(spark, noisy):
    with kept_placed(noisy, ["row_id"], ["units", "sales"]) as kept:
        assert kept.columns == ["units", "sales"] and kept.count() == 600
        whole = training.placed(noisy, ["row_id"]).select("units", "sales")
        assert [tuple(r) for r in kept.collect()] == [tuple(r) for r in whole.collect()]
    rows = training_frame(noisy, ModelConfig("forest"), ["row_id"]).withColumn("fold", F.lit(1))
    config, seen = ModelConfig("forest", trees=2, depth=2), []

    class Spied(Pipeline):
        def fit(self, dataset, params=None):
            seen.append(dataset.columns)
            return super().fit(dataset, params)

    stages = encoding_stages(config, rows)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(training, "Pipeline", Spied)
        fit_placed(config, stages, rows, ["row_id"])
    assert seen == [[*config.features, "sales"]]


def test_draws_of_half_a_byte_and_of_a_byte(spark):
    growth = forests._growth(spark.sparkContext.applicationId)
    gateway = spark.sparkContext._gateway
    for block, wide, expected in (
        (bytes([9, 0x20, 0x03, 0x0F]), False, [(1, 2), (2, 3), (4, 15)]),
        (bytes([9, 0, 17, 3, 0, 200]), True, [(1, 17), (2, 3), (4, 200)]),
    ):
        drawn, weights = (gateway.new_array(gateway.jvm.int, 6) for _ in range(2))
        found = growth.draws(bytearray(block), 1, 5, wide, drawn, weights)
        assert [(drawn[i], weights[i]) for i in range(found)] == expected


def test_a_fitted_forest_scores_like_the_mean_of_its_trees(noisy):
    fitted = train(noisy, ModelConfig("forest", trees=6, depth=4), ["row_id"])
    model = fitted.model.stages[-1]
    for row in fitted.model.transform(fitted.test).limit(20).collect():
        mean = sum(t.predict(row["scaled"]) for t in model.trees) / 6
        assert row["prediction"] == pytest.approx(mean)


def test_files_of_finished_shuffles_go(spark):
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def files():
        return disk.getAllFiles().mkString(",").count("shuffle_")

    spark.range(10_000).repartition(7).agg(F.sum("id")).collect()
    gc.collect()
    before = files()
    deadline = time.time() + 30
    while files() >= before and time.time() < deadline:
        release_shuffles(spark)
        time.sleep(0.5)
    assert files() < before


def test_forest_bounds_scores_every_row_once(spark, monkeypatch):
    calls, plain = [], training.Trained.predict
    monkeypatch.setattr(
        training.Trained, "predict", lambda self, df: calls.append(1) or plain(self, df)
    )
    rows = QUERIES["forest_bounds"](spark, SF).collect()
    assert len(calls) == 1
    assert all(r["n"] == r["n_inside"] > 0 and r["good_fit"] == "true" for r in rows)


def test_metrics_of_written_scores(noisy):
    fitted = train(noisy, ModelConfig("forest", trees=3, depth=3), ["row_id"])
    scored = fitted.scored()
    assert scored.columns == ["side", "sales", "prediction"] and scored.count() == 600
    one = fitted.metrics(scored).orderBy("side").collect()
    for a, b in zip(one, fitted.metrics().orderBy("side").collect(), strict=True):
        assert tuple(a)[:2] == tuple(b)[:2] and tuple(a)[2:] == pytest.approx(tuple(b)[2:])
