"""Correlation, fences, box plots, histograms, samples."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from martlens.functions.columns import col, present
from martlens.operators.quantiles import exact_quantiles

FENCE_FACTOR = 1.5  # fixed value: fences lie this many quartile ranges out


MOST_COLUMNS = 62  # one bit each in a long, which marks the columns that a row carries


def pattern_of(columns: Sequence[str]) -> Column:
    """Which of the columns a row carries, a bit each."""
    if len(columns) > MOST_COLUMNS:
        raise ValueError(
            f"{len(columns)} columns; at most {MOST_COLUMNS} can be correlated at once"
        )
    bits = [F.shiftleft(col(c).isNotNull().cast("bigint"), i) for i, c in enumerate(columns)]
    return sum(bits[1:], bits[0])


def _pairs(size: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(size) for j in range(i, size)]


def moment_sums(columns: Sequence[str], origins: Sequence[float]) -> list[Column]:
    """Count ``n``, sums ``s<i>`` and sums of products ``p<i>_<j>`` around the origins.

    They add up over groups and batches; origins near the data keep their accuracy.
    """
    x = [col(c) - F.lit(o) for c, o in zip(columns, origins, strict=True)]
    return [
        F.count(F.lit(1)).alias("n"),
        *[F.sum(v).alias(f"s{i}") for i, v in enumerate(x)],
        *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in _pairs(len(x))],
    ]


def correlations_of(
    patterns: DataFrame, columns: Sequence[str], origins: Sequence[float], ranged: bool = False
) -> DataFrame:
    """Pearson correlations as (a, b, r) from ``carried`` and the :func:`moment_sums`.

    A pair adds up the groups that carry both its columns; Spark does so too, and what
    reaches the driver is one row per pair.  With ``ranged`` the groups hold each column's
    least and largest value as ``lo<i>`` and ``hi<i>``: a column is then constant if these
    are equal, which origins far from a small group's values would hide.
    """
    pairs = _pairs(len(columns))
    entries = [
        F.struct(
            F.lit(i).alias("i"), F.lit(j).alias("j"),
            F.lit((1 << i) | (1 << j)).cast("bigint").alias("need"), F.col("n"),
            F.col(f"s{i}").alias("si"), F.col(f"s{j}").alias("sj"), F.col(f"p{i}_{i}").alias("pi"),
            F.col(f"p{j}_{j}").alias("pj"), F.col(f"p{i}_{j}").alias("pij"),
            *[F.col(f"{end}{x}").alias(f"{end}{side}")
              for end in ("lo", "hi") for x, side in ((i, "i"), (j, "j")) if ranged],
        )
        for i, j in pairs
    ]
    sums = (
        patterns.select("carried", F.inline(F.array(*entries)))
        .filter(F.col("carried").bitwiseAND(F.col("need")) == F.col("need"))
        .groupBy("i", "j")
        .agg(
            *[F.sum(c).alias(c) for c in ("n", "si", "sj", "pi", "pj", "pij")],
            *[F.min(f"lo{x}").alias(f"lo{x}") for x in ("i", "j") if ranged],
            *[F.max(f"hi{x}").alias(f"hi{x}") for x in ("i", "j") if ranged],
        )
    )
    found = {(g["i"], g["j"]): _pearson(g, origins, ranged) for g in sums.collect()}
    rows = []
    for i, j in pairs:
        r = found.get((i, j))
        rows += [(columns[x], columns[y], r) for x, y in {(i, j), (j, i)}]
    return patterns.sparkSession.createDataFrame(rows, "a string, b string, r double")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlations as (a, b, r); null for a constant.

    Rows are grouped by which columns they carry.  Within such a group every
    pair sees the same rows, so one set of sums serves all pairs.  Columns are
    centred by a first pass, which keeps the sums of products accurate.  At most
    ``MOST_COLUMNS`` columns.
    """
    carried = pattern_of(columns).alias("carried")
    values = df.select(*[present(df, c).cast("double").alias(c) for c in columns])
    means = [m or 0.0 for m in values.agg(*[F.avg(col(c)) for c in columns]).first()]
    patterns = values.groupBy(carried).agg(*moment_sums(columns, means))
    return correlations_of(patterns, columns, means)


def _pearson(g: Row, means: Sequence[float], ranged: bool) -> float | None:
    n = g["n"]
    if n < 2:
        return None
    spread = [g["pi"] - g["si"] ** 2 / n, g["pj"] - g["sj"] ** 2 / n]
    if ranged:
        constant = any(g[f"lo{x}"] == g[f"hi{x}"] for x in ("i", "j"))
    else:
        # below this a column only varies by the rounding of its mean
        noise = [n * (1e-13 * abs(means[g[x]])) ** 2 for x in ("i", "j")]
        constant = any(v <= limit for v, limit in zip(spread, noise, strict=True))
    if constant or min(spread) <= 0:
        return None
    together = g["pij"] - g["si"] * g["sj"] / n
    return together / math.sqrt(spread[0]) / math.sqrt(spread[1])


def quartiles(df: DataFrame, column: str, approximate: bool = False) -> tuple:
    return tuple(exact_quantiles(df, [column], [0.25, 0.5, 0.75], approximate)[column])


def fences(q1: float, q3: float, factor: float = FENCE_FACTOR) -> tuple[float, float]:
    return q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)


def _outside(column: str, lo: float, hi: float) -> Column:
    return (col(column) < F.lit(lo)) | (col(column) > F.lit(hi))


def iqr_outliers(
    df: DataFrame, column: str, approximate: bool = False, known: tuple | None = None
) -> DataFrame:
    """Rows outside the quartile fences; ``known`` quartiles are not searched again.

    The fences are literals by the time the filter is built, so it is pushed
    into the file scan.
    """
    q1, _, q3 = known or quartiles(df, column, approximate)
    if q1 is None:
        return df.filter(F.lit(False))
    return df.filter(_outside(column, *fences(q1, q3)))


def box_stats(
    df: DataFrame, column: str, approximate: bool = False, known: tuple | None = None
) -> DataFrame:
    """Quartiles, fences, whisker ends and the number of outliers."""
    q1, q2, q3 = known or quartiles(df, column, approximate)
    lo, hi = fences(q1, q3) if q1 is not None else (None, None)
    v = present(df, column).cast("double")
    kept = F.when((v >= F.lit(lo)) & (v <= F.lit(hi)), v)
    return df.agg(
        F.min(kept).alias("whisker_low"),
        F.max(kept).alias("whisker_high"),
        F.count_if((v < F.lit(lo)) | (v > F.lit(hi))).alias("n_outliers"),
        F.count(v).alias("n_rows"),
    ).select(
        *[
            F.lit(x).cast("double").alias(name)
            for x, name in ((q1, "q1"), (q2, "median"), (q3, "q3"), (lo, "lower"), (hi, "upper"))
        ],
        "*",
    )


def _bin_number(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """1..bins over [lo, hi]; the upper end belongs to the last bin.

    All values equal leave no width to divide: they share the first bin.
    """
    number = F.width_bucket(value, lo, hi, F.lit(bins))
    return F.when(lo == hi, 1).otherwise(F.least(number, F.lit(bins))).cast("bigint")


def _extent(values: DataFrame, column: str) -> tuple[Column, Column]:
    """Least and greatest value as a one-row subquery, not a join."""
    ends = values.agg(
        F.struct(F.min(col(column)).alias("lo"), F.max(col(column)).alias("hi")).alias("ends")
    ).scalar()
    return ends.getField("lo"), ends.getField("hi")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Counts of equal-width bins over [min, max]: bin, bin_low, bin_high, n."""
    values = df.select(present(df, column).cast("double").alias("v")).filter("v IS NOT NULL")
    lo, hi = _extent(values, "v")
    counted = (
        values.select(_bin_number(F.col("v"), lo, hi, bins).alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (hi - lo) / bins
    return counted.select(
        "bin",
        (lo + (F.col("bin") - 1) * width).alias("bin_low"),
        (lo + F.col("bin") * width).alias("bin_high"),
        "n",
    )


def scatter_bins(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """A scatter plot that scales: row counts on a bins x bins grid."""
    values = df.select(
        present(df, x).cast("double").alias("x"), present(df, y).cast("double").alias("y")
    ).dropna()
    ends = values.agg(
        F.struct(
            F.min("x").alias("x0"), F.max("x").alias("x1"),
            F.min("y").alias("y0"), F.max("y").alias("y1"),
        )
    ).scalar()
    return (
        values.select(
            _bin_number(F.col("x"), ends.getField("x0"), ends.getField("x1"), bins).alias("x_bin"),
            _bin_number(F.col("y"), ends.getField("y0"), ends.getField("y1"), bins).alias("y_bin"),
        )
        .groupBy("x_bin", "y_bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def scatter_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """The raw pairs, for small inputs and for writing out."""
    return df.select(col(x).alias("x"), col(y).alias("y"))


def hash_text(keys: Sequence[str], seed: int) -> Column:
    """A repeatable pseudo-random text per row, the same in any SQL engine."""
    parts = [F.coalesce(col(k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def sample_rows(df: DataFrame, keys: Sequence[str], n: int = 300, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same on every run and partitioning."""
    ordered = df.withColumn("__draw", hash_text(keys, seed))
    return ordered.orderBy("__draw", *[col(k) for k in keys]).limit(n).drop("__draw")


def identity_line(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(col(column)).alias("line_low"), F.max(col(column)).alias("line_high"))
