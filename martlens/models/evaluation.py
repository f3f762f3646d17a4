"""Regression metrics and residuals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.functions.columns import col
from martlens.operators.statistics import histogram

MAPE_EPSILON = 1e-9  # fixed value added to the denominator


def with_residual(
    scored: DataFrame, label: str = "sales", prediction: str = "prediction"
) -> DataFrame:
    return scored.withColumn("residual", col(label) - col(prediction))


def regression_metrics(
    scored: DataFrame,
    label: str = "sales",
    prediction: str = "prediction",
    by: Sequence[str] = (),
) -> DataFrame:
    """n, R2, MAE, RMSE and MAPE in one aggregate, per group if asked."""
    y, error = col(label), col(label) - col(prediction)
    sums = scored.groupBy(*[col(c) for c in by]).agg(
        F.count(error).alias("n"),
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop(y).alias("spread"),
        (F.avg(F.abs(F.try_divide(error, y + F.lit(MAPE_EPSILON)))) * 100).alias("mape"),
    )
    return sums.select(
        *by,
        "n",
        (1 - F.try_divide(col("mse"), col("spread"))).alias("r2"),
        "mae",
        F.sqrt("mse").alias("rmse"),
        "mape",
    )


def residual_histogram(scored: DataFrame, label: str = "sales", bins: int = 50) -> DataFrame:
    return histogram(with_residual(scored, label).select("residual"), "residual", bins)
