"""Training, cross-validation, importances, batch scoring."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from martlens.functions.columns import col
from martlens.models.evaluation import regression_metrics
from martlens.models.features import (
    CATEGORICAL,
    FEATURES,
    LABEL,
    label_indexer,
    prepare,
    test_condition,
    with_fold,
)
from martlens.models.forests import RandomForestRegressor
from martlens.operators.cleaning import drop_incomplete
from martlens.session import release_shuffles
from martlens.sources.tables import materialize

@dataclass(frozen=True)
class ModelConfig:
    """What to fit.

    ``missing='impute'`` fills numbers with the training mean and gives a
    missing category the code after the last; ``missing='drop'`` leaves out
    incomplete rows and refuses unseen categories.
    """

    algorithm: str = "forest"  # or "linear"
    features: tuple[str, ...] = FEATURES
    label: str = LABEL
    trees: int = 100
    depth: int = 5
    bins: int = 128  # candidate thresholds per feature
    seed: int = 42
    missing: str = "impute"  # or "drop"

    @property
    def categories(self) -> list[str]:
        return [c for c in self.features if c in CATEGORICAL]

    @property
    def numbers(self) -> list[str]:
        return [c for c in self.features if c not in CATEGORICAL]

    @property
    def inputs(self) -> list[str]:
        """Vector slots in feature order."""
        return [f"{c}_code" if c in CATEGORICAL else c for c in self.features]


ROWS_PER_PARTITION = 100_000


def placed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in partitions and an order that follow from their keys alone.

    A forest draws its samples partition by partition, row by row.  How many
    partitions there are depends on the number of rows, not on files or cores, so a fit
    gives the same trees on any machine.
    """
    n = min(10_000, max(8, -(-rows.count() // ROWS_PER_PARTITION)))
    own = [k for k in keys if k in rows.columns] or rows.columns
    rest = [c for c in rows.columns if c not in own]
    return rows.repartition(n, *[col(k) for k in own]).sortWithinPartitions(
        *[col(c) for c in (*own, *rest)]
    )


@contextmanager
def kept_placed(
    rows: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None
) -> Iterator[DataFrame]:
    """:func:`placed` rows, shuffled and sorted once for all passes of a fit.

    They lie on the executors' disks: the memory is left to the forest's sums.  Of the rows
    only ``columns`` stay, once they are in place.
    """
    placed_rows = placed(rows, keys)
    if columns is not None:
        placed_rows = placed_rows.select(*[col(c) for c in columns])
    kept = placed_rows.persist(StorageLevel.DISK_ONLY)
    try:
        yield kept
    finally:
        kept.unpersist()


# A row of Spark's own forest in memory: its bins and label, and one count per tree.
ROW_BYTES, COUNT_BYTES = 140, 4
# A pass over the rows gathers so many MB of sums of each tree.  One MB stays in a core's
# cache and holds the levels of a forest of usual depth; more takes fewer passes for deeper
# ones, which cost more than cache misses when there are many rows.
GROUP_MB, GROUP_MB_ON_DISK = 1, 8


def group_mb(spark: SparkSession, rows: int, trees: int) -> int:
    """How many MB of a tree's sums to gather per pass; the trees do not depend on it."""
    jvm, sc = spark._jvm, spark.sparkContext._jsc.sc()
    sizes = jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc.getExecutorMemoryStatus())
    memory = sum(sizes[name]._1() for name in sizes)
    needed = rows * (ROW_BYTES + COUNT_BYTES * trees)
    return GROUP_MB if needed <= 1.5 * memory else GROUP_MB_ON_DISK


def encoding_stages(config: ModelConfig, rows: DataFrame) -> list:
    """Category codes from all ``rows``, so that every side knows every category; labels
    of a category say nothing about the target.  Means are left to the fit."""
    stages = []
    if config.categories:
        indexer = label_indexer(
            config.categories, "keep" if config.missing == "impute" else "error"
        )
        stages.append(indexer.fit(rows))
    if config.numbers:
        stages.append(
            Imputer(strategy="mean", inputCols=config.numbers, outputCols=config.numbers)
        )
    return stages


def fitting_stages(config: ModelConfig, memory_mb: int = GROUP_MB) -> list:
    """Scale and regress.

    The scaler drops the category marks of the codes, so a tree treats a code
    as a number.
    """
    if config.algorithm == "linear":
        regressor = LinearRegression(
            featuresCol="scaled", labelCol=config.label, regParam=0.0, solver="normal"
        )
    elif config.algorithm == "forest":
        regressor = RandomForestRegressor(
            featuresCol="scaled",
            labelCol=config.label,
            numTrees=config.trees,
            bootstrap=config.trees > 1,  # a single tree sees every row
            maxDepth=config.depth,
            featureSubsetStrategy="all",
            maxBins=config.bins,
            maxMemoryInMB=memory_mb,
            seed=config.seed,
        )
    else:
        raise ValueError(f"unknown algorithm {config.algorithm!r}")
    return [
        VectorAssembler(inputCols=config.inputs, outputCol="features"),
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
        regressor,
    ]


@dataclass(frozen=True)
class Trained:
    """A fitted pipeline and the written rows it came from, marked by side."""

    config: ModelConfig
    model: PipelineModel
    rows: DataFrame = field(repr=False)

    @property
    def train(self) -> DataFrame:
        return self.rows.filter("side = 'train'")

    @property
    def test(self) -> DataFrame:
        return self.rows.filter("side = 'test'")

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df).drop("features", "scaled")

    def scored(self) -> DataFrame:
        """Label and prediction of all rows of both sides, written once for several readers."""
        scored = self.predict(self.rows).select("side", col(self.config.label), "prediction")
        return materialize(scored, "scored")

    def metrics(self, scored: DataFrame | None = None) -> DataFrame:
        """R2, MAE, RMSE and MAPE of the train and the test side, in one pass."""
        scored = self.predict(self.rows) if scored is None else scored
        return regression_metrics(scored, self.config.label, by=["side"])

    def coefficients(self) -> DataFrame:
        """Slopes of a linear model on the original scale, and the intercept."""
        scaler, regressor = self.model.stages[-2:]
        std = scaler.std.toArray()
        slopes = np.divide(
            regressor.coefficients.toArray(), std, out=np.zeros_like(std), where=std > 0
        )
        intercept = float(regressor.intercept - slopes @ scaler.mean.toArray())
        rows = [(n, float(s)) for n, s in zip(self.config.features, slopes, strict=True)]
        return self.rows.sparkSession.createDataFrame(
            [("intercept", intercept), *rows], "term string, value double"
        )

    def importances(self) -> DataFrame:
        """Features of a forest, most important first."""
        weights = self.model.stages[-1].featureImportances.toArray()
        rows = [(n, float(w)) for n, w in zip(self.config.features, weights, strict=True)]
        return self.rows.sparkSession.createDataFrame(
            rows, "feature string, importance double"
        ).orderBy(F.desc("importance"), "feature")


def training_frame(df: DataFrame, config: ModelConfig, keys: Sequence[str]) -> DataFrame:
    """The columns a fit reads, and the keys that place a row in a split."""
    keep = [k for k in keys if k in df.columns]
    data = prepare(df, config.features, config.label, keep)
    if config.missing == "drop":
        data = drop_incomplete(data, [*config.features, config.label])
    return data


def fit_placed(
    config: ModelConfig, stages: Sequence, rows: DataFrame, keys: Sequence[str]
) -> PipelineModel:
    """``stages`` and the regressor, fitted on :func:`placed` rows."""
    release_shuffles(rows.sparkSession)  # of the joins, or of the fold before
    coded = set(rows.columns).issuperset(config.inputs)
    columns = [*(config.inputs if coded else config.features), config.label]
    with kept_placed(rows, keys, list(dict.fromkeys(columns))) as kept:
        memory = group_mb(rows.sparkSession, kept.count(), config.trees)
        return Pipeline(stages=[*stages, *fitting_stages(config, memory)]).fit(kept)


def train(
    df: DataFrame,
    config: ModelConfig,
    keys: Sequence[str],
    test_share: float = 0.2,
) -> Trained:
    """Split, fit on the train side, keep both sides for scoring.

    The narrow training columns are written once to the shared folder: a fit
    scans its input several times, and the joins behind it should not run each
    time, nor after the loss of an executor.
    """
    in_test = test_condition(keys, test_share, config.seed)
    marked = training_frame(df, config, keys).withColumn(
        "side", F.when(in_test, "test").otherwise("train")
    )
    rows = materialize(marked, "training")
    stages, fit_on = encoding_stages(config, rows), rows.filter("side = 'train'")
    if config.algorithm == "forest":
        model = fit_placed(config, stages, fit_on, keys)
    else:
        model = Pipeline(stages=[*stages, *fitting_stages(config)]).fit(fit_on)
    return Trained(config, model, rows)


def save(trained: Trained, path: str) -> None:
    trained.model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_features(model: PipelineModel) -> tuple[str, ...]:
    """The feature columns a fitted pipeline reads, in order."""
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    codes = {f"{c}_code": c for c in CATEGORICAL}
    return tuple(codes.get(c, c) for c in assembler.getInputCols())


# -- cross-validation ---------------------------------------------------------


def cross_validate(
    data: DataFrame,
    config: ModelConfig,
    keys: Sequence[str],
    folds: int = 5,
) -> DataFrame:
    """R2 of each held-out fold, as (fold, r2).

    Categories are coded and gaps filled once, over all rows given, before the folds;
    only the regressor is fitted per fold.  Both algorithms follow this rule.
    """
    marked = materialize(with_fold(data, keys, folds, config.seed), "folds")
    stages = encoding_stages(config, marked)
    if stages:
        marked = Pipeline(stages=stages).fit(marked).transform(marked)
    if config.algorithm == "linear":
        return _fold_products(marked, config)
    return _fold_refits(materialize(marked, "folds-encoded"), config, keys, folds)


def _fold_refits(
    marked: DataFrame, config: ModelConfig, keys: Sequence[str], folds: int
) -> DataFrame:
    """Fit the regressor once per fold."""
    scores = []
    for i in range(folds):
        model = fit_placed(config, [], marked.filter(F.col("fold") != i), keys)
        scored = model.transform(marked.filter(F.col("fold") == i))
        scores.append((i, regression_metrics(scored, config.label).first()["r2"]))
    return marked.sparkSession.createDataFrame(scores, "fold int, r2 double")


def _fold_products(marked: DataFrame, config: ModelConfig) -> DataFrame:
    """All folds of a least-squares fit from one pass over the encoded rows.

    A fold's model needs only cross products of the other folds' rows, and
    those are the totals minus the fold's own.  Spark sums the products per
    fold; what reaches the driver is one small square per fold.
    """
    names = [*config.inputs, config.label]
    stats = marked.agg(
        *[F.avg(col(c)) for c in names], *[F.stddev_pop(col(c)) for c in names]
    ).first()
    width = len(names)
    # centred and scaled columns keep the products well conditioned
    columns = [F.lit(1.0)] + [
        (col(c) - F.lit(stats[i])) / F.lit(stats[width + i] or 1.0) for i, c in enumerate(names)
    ]
    pairs = [(i, j) for i in range(width + 1) for j in range(i, width + 1)]
    narrow = marked.select("fold", *[c.alias(f"x{i}") for i, c in enumerate(columns)])
    per_fold = narrow.groupBy("fold").agg(
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs]
    )
    products = {}
    for row in per_fold.collect():  # one row per fold
        square = np.zeros((width + 1, width + 1))
        for i, j in pairs:
            square[i, j] = square[j, i] = row[f"p{i}_{j}"]
        products[row["fold"]] = square
    total = sum(products.values())
    scores = []
    for fold, own in sorted(products.items()):
        rest = total - own
        beta = np.linalg.lstsq(rest[:-1, :-1], rest[:-1, -1], rcond=None)[0]
        error = own[-1, -1] - 2 * beta @ own[:-1, -1] + beta @ own[:-1, :-1] @ beta
        spread = own[-1, -1] - own[0, -1] ** 2 / own[0, 0]
        scores.append((int(fold), float(1 - error / spread) if spread > 0 else None))
    return marked.sparkSession.createDataFrame(scores, "fold int, r2 double")
