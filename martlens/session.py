"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import SparkSession

# Run-time settings that matter for large joins and aggregations.  AQE splits
# hot join keys, coalesces small shuffle partitions and turns a shuffle join
# into a broadcast join only when the measured size allows it.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even when the split costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # copies of one row compress well: bytes understate how many rows a hot key has
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name: str = "martlens", **extra: str) -> SparkSession:
    """Create a session; master and memory come from spark-submit."""
    builder = SparkSession.builder.appName(app_name).config("spark.ui.enabled", "false")
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> SparkSession:
    """Put the run-time settings on a session someone else created."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def release_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the files of shuffles that nothing can read any more.

    It does so when the driver's garbage is collected, which may not happen for long while
    the executors' disks fill.
    """
    spark._jvm.java.lang.System.gc()


_scopes: list[list[str]] = []


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder from whatever file system holds it."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate copies made inside are removed at the end.

    Frames that read them must have been written or collected by then.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete_path(spark, path)


@lru_cache
def _local_scratch(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"martlens-{application}-")


def shared_path(spark: SparkSession, label: str) -> str:
    """A lasting path below the cluster's shared folder, the same for every session.

    The folder is the one the session names in ``spark.checkpoint.dir``.  Only
    a local master may fall back to a temporary folder of this machine: on a
    cluster the executors would each write to a disk of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_scratch(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/{label}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the cluster's shared folder; a scope removes it at its end."""
    path = shared_path(spark, f"{label}-{uuid.uuid4().hex}")
    if _scopes:
        _scopes[-1].append(path)
    return path
