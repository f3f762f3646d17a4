"""Batch scoring of what-if orders."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.functions.columns import col
from martlens.models.features import prepare

# The ranges a what-if order is expected to stay in.
INPUT_RANGES = {
    "units": (1, 200),
    "unit_price": (0.5, 50.0),
    "unit_cost": (0.1, 20.0),
    "shipping_days": (1, 10),
    "order_month": (1, 12),
    "quarter": (1, 4),
}


def derive_scenarios(scenarios: DataFrame) -> DataFrame:
    """Add gross profit and cost from units, price and unit cost, and a flag.

    Rows outside the expected ranges are marked, not dropped.
    """
    in_range = reduce(and_, [col(c).between(lo, hi) for c, (lo, hi) in INPUT_RANGES.items()])
    return scenarios.withColumns(
        {
            "gross_profit": col("units") * (col("unit_price") - col("unit_cost")),
            "cost": col("units") * col("unit_cost"),
            "in_range": F.coalesce(in_range, F.lit(False)),
        }
    )


def score_scenarios(
    model: PipelineModel, scenarios: DataFrame, features: tuple[str, ...]
) -> DataFrame:
    """Predicted sales beside the estimated gross profit of every scenario.

    A category the model never saw stops the job when the model was trained on
    complete rows only.
    """
    derived = derive_scenarios(scenarios)
    keep = [c for c in derived.columns if c not in features]
    return (
        model.transform(prepare(derived, features, None, keep))
        .withColumnRenamed("prediction", "predicted_sales")
        .drop("features", "scaled", *[f"{c}_code" for c in features])
    )
