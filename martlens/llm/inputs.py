"""Reading, sizing and shipping helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import martlens
from martlens.session import apply_settings

_shipped: set[str] = set()


def ready(spark: SparkSession) -> SparkSession:
    """Session settings, and this package for the Python workers of all executors."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = os.path.dirname(os.path.abspath(martlens.__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="martlens-zip-"), "martlens_package.zip")
        with zipfile.ZipFile(path, "w") as package:
            for folder, _, names in os.walk(root):
                for name in sorted(n for n in names if n.endswith(".py")):
                    full = os.path.join(folder, name)
                    package.write(full, os.path.join("martlens", os.path.relpath(full, root)))
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    # whole texts can be long: a thousand of them make a batch
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return apply_settings(spark)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the whole text, null texts empty; other columns are left behind."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))


def parts(spark: SparkSession, rows: int, rows_each: int) -> int:
    """How many partitions hold ``rows`` at ``rows_each``; at least the session's number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each), 1)


def numbered(df: DataFrame, replaced: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """The columns of ``df`` but ``replaced`` under the names c0, c1, ..., and their own names.

    No column of the caller can then clash with a working column.
    """
    kept = [i for i, c in enumerate(df.columns) if c not in replaced]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    names = [df.columns[i] for i in kept]
    return plain.select(*[F.col(f"c{i}") for i in kept]).toDF(
        *[f"c{k}" for k in range(len(kept))]
    ), names
