"""Reading vectors and dealing them out in tiles of candidates and queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Not null, not empty, every component finite."""
    bad = F.exists(
        vector,
        lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")),
    )
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad


def named_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id`` and ``vector`` (doubles) of the rows that take part.

    Rows without an id or with a vector that is null, empty or holds a null or a component
    that is not finite take no part.
    """
    plain = rows.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col(vector).alias("raw")
    ).filter(F.col("vec_id").isNotNull())
    return plain.filter(usable("raw")).select(
        "vec_id", F.col("raw").cast("array<double>").alias("vector")
    )


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of doubles; shorter vectors are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def dealt(column: Column, groups: int, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(groups))


def copied(rows: DataFrame, name: str, times: int) -> DataFrame:
    """Each row ``times`` times, numbered in column ``name``."""
    return rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
