"""Stored roll-ups that grow by batches and answer any filter choice without the fact.

A batch of sales lines becomes four small tables, each of which adds up over batches:

- ``sums``: what the additive reports need, per dimension combination;
- ``moments``: counts, sums, cross products and ranges of the correlated measures around a
  fixed origin, per key and pattern of measures that are present;
- ``bins``: how many values lie in each logarithmic bin of a measure, per key;
- ``orders``: the order numbers as bitmaps, per key.  Orders named by a text are numbered
  first; their numbers are kept beside the batches and never change.

Keys are what a page filters by.  Appending a day reads that day only.  Correlations come
from the moments, distinct orders from the bitmaps; a quantile's bin is known exactly from
the counts, and only the fact's rows in that bin are read to finish it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.functions.columns import col, present, ratio
from martlens.operators.filters import ALL, dashboard_filter
from martlens.operators.quantiles import (
    bin_of,
    bin_range,
    interpolated,
    place_ranks,
    ranks_of,
    values_at,
)
from martlens.operators.statistics import correlations_of, moment_sums, pattern_of
from martlens.plans.dashboard import CORRELATED, DIMENSIONS, MEASURES
from martlens.plans.star import Star
from martlens.sources.tables import materialize
from martlens.sources.versions import Pointer

KEYS = ("order_year", "region", "division")
TABLES = ("sums", "moments", "bins", "orders")


class RollupStore:
    """The four tables of all batches below ``path``, published together."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.pointer = spark, Pointer(spark, path, keep)

    # -- writing ------------------------------------------------------------

    def _state(self) -> dict:
        empty = {"folders": [], "batches": [], "origins": None, "names": [], "named": None}
        return self.pointer.state() or empty

    def append(self, star: Star, batch: str) -> None:
        """Add the lines of ``star`` (a star of new lines only) as the batch of this name.

        A batch of a name that is there is replaced, so a job can be repeated; after
        :meth:`compact` that is no longer possible and is refused.  The four tables become
        visible at once, or not at all if the job breaks off.
        """
        state = self._state()
        names = [b for b in state["batches"] if batch in b]
        if names and names[0] != [batch]:
            raise ValueError(f"batch {batch} is part of a compacted one")
        named = star.select("order_id").dtypes[0][1] == "string"
        if state["named"] not in (None, named):
            raise TypeError("the orders of earlier batches are of another type")
        state["named"] = named
        columns = dict.fromkeys([*KEYS, *DIMENSIONS, *MEASURES, *CORRELATED, "order_id", "order_date"])
        lines = materialize(star.select(*columns), "rollup-lines")
        if state["origins"] is None:
            # any numbers near the data do: products around them keep their digits
            means = lines.agg(*[F.avg(present(lines, c)) for c in CORRELATED]).first()
            if any(m is not None for m in means):  # not yet, from a batch without lines
                state["origins"] = [float(m or 0.0) for m in means]
        folder = self.pointer.fresh_folder()
        orders = lines.select(*KEYS, col("order_id").alias("number"))
        if named:
            # an order has many lines and few keys: fewer rows meet the list of names
            orders = self._numbered(orders.distinct(), state)
        made = {
            "sums": Star(lines, ()).rollup(DIMENSIONS, MEASURES),
            "moments": self._moments(lines, _origins(state)),
            "bins": _bins(lines, MEASURES),
            "orders": _orders(orders),
        }
        for name, table in made.items():
            table.write.parquet(f"{folder}/{name}")
        at = [i for i, b in enumerate(state["batches"]) if b != [batch]]
        state["batches"] = [*[state["batches"][i] for i in at], [batch]]
        state["data"] = [*[_data(state)[i] for i in at], folder]
        state["folders"] = [*state["data"], *state["names"]]
        self.pointer.publish(state)

    def _numbered(self, orders: DataFrame, state: dict) -> DataFrame:
        """Orders by number instead of name; new names are numbered and written.

        A number is the position of the list of names in its upper bits, then the partition
        and row that the name was written from: no pass over all names is needed.
        """
        given = orders.select(col("number").alias("name")).distinct().dropna()
        if state["names"]:
            known = self.spark.read.parquet(*state["names"])
            given = given.join(known, "name", "left_anti")
        first = F.lit(len(state["names"]) << 48).cast("bigint")
        folder = self.pointer.fresh_folder()
        fresh = given.coalesce(1 << 14).select("name", (first + F.monotonically_increasing_id()).alias("id"))
        fresh.write.parquet(folder)
        state["names"] = [*state["names"], folder]
        names = self.spark.read.parquet(*state["names"])
        found = orders.join(names, orders["number"] == names["name"])
        return found.select(*KEYS, F.col("id").alias("number"))

    def _moments(self, lines: DataFrame, origins: Sequence[float]) -> DataFrame:
        values = lines.select(
            *KEYS, "order_date", *[present(lines, c).cast("double").alias(c) for c in CORRELATED]
        )
        return values.groupBy(*KEYS, pattern_of(CORRELATED).alias("carried")).agg(
            *moment_sums(CORRELATED, origins),
            *[F.min(c).alias(f"lo{i}") for i, c in enumerate(CORRELATED)],
            *[F.max(c).alias(f"hi{i}") for i, c in enumerate(CORRELATED)],
            F.min("order_date").alias("first_order"), F.max("order_date").alias("last_order"),
        )

    def compact(self) -> None:
        """Merge all batches into one: reading stays quick however many days were added."""
        state = self._state()
        if len(_data(state)) < 2:
            return
        folder = self.pointer.fresh_folder()
        for name in TABLES:
            _merged(name, self.read(name)).write.parquet(f"{folder}/{name}")
        state["batches"] = [sorted({b for batch in state["batches"] for b in batch})]
        state["data"] = [folder]
        state["folders"] = [folder, *state["names"]]
        self.pointer.publish(state)

    # -- reading ------------------------------------------------------------

    def batches(self) -> list[str]:
        return sorted(b for batch in self._state()["batches"] for b in batch)

    def read(self, name: str) -> DataFrame:
        """One of the four tables, a row per key and batch."""
        folders = _data(self._state())
        if not folders:
            raise LookupError(f"{self.pointer.path} has no batch yet")
        return self.spark.read.parquet(*[f"{f}/{name}" for f in folders])

    def sums(self) -> DataFrame:
        """The roll-up for :func:`martlens.plans.dashboard.dashboard`."""
        return _merged("sums", self.read("sums"))

    def correlations(
        self, years: Sequence[int] | None = None, region: str = ALL, division: str = ALL
    ) -> DataFrame:
        """The correlation matrix of a choice as (a, b, r), from the moments alone."""
        chosen = dashboard_filter(self.read("moments"), years, region, division)
        return correlations_of(chosen, CORRELATED, _origins(self._state()), ranged=True)

    def distinct_orders(
        self, by: Sequence[str] = (), years: Sequence[int] | None = None, region: str = ALL,
        division: str = ALL,
    ) -> DataFrame:
        """How many different orders a choice has, per ``by`` (some of the keys).  Exact.

        A bitmap holds 32,768 order numbers in 4 KB; there is one per key and range of
        numbers that occurs, and what is read here are those of the choice.
        """
        chosen = dashboard_filter(self.read("orders"), years, region, division)
        whole = chosen.groupBy(*by, "bucket").agg(F.bitmap_or_agg("orders").alias("orders"))
        counted = whole.groupBy(*by) if by else whole
        return counted.agg(F.coalesce(F.sum(F.bitmap_count("orders")), F.lit(0)).alias("n_orders"))

    def quantiles(
        self, star: Star, column: str, probabilities: Sequence[float],
        years: Sequence[int] | None = None, region: str = ALL, division: str = ALL,
    ) -> list[float | None]:
        """Exact quantiles of a measure for a choice, interpolated linearly.

        The counts per bin say in which bin each wanted rank lies and how many values come
        before it; ``star`` (all lines) is read for the rows of those bins only.
        """
        bins = dashboard_filter(self.read("bins"), years, region, division)
        rows = bins.filter(col("measure") == column).groupBy("bin").agg(F.sum("n").alias("n"))
        counts = sorted((r["bin"], r["n"]) for r in rows.collect())  # bounded by the bins
        total = sum(n for _, n in counts)
        if not total:
            return [None] * len(probabilities)
        place = place_ranks(counts, ranks_of(total, probabilities))
        near = self._near_bins(star, column, {b for b, _, _ in place.values()}, years, region, division)
        found = values_at(near, {column: place})
        return interpolated(found[column], total, probabilities)

    def _near_bins(
        self, star: Star, column: str, numbers: Iterable[int], years, region: str, division: str
    ) -> DataFrame:
        """The values of the choice in the bins' ranges."""
        ranges = [bin_range(b) for b in sorted(numbers)]
        near = reduce(or_, [col(column).between(F.lit(lo), F.lit(hi)) for lo, hi in ranges])
        # before the joins, where it reaches the scan
        if column in star.fact.columns:
            star = Star(star.fact.filter(near), star.lookups)
        extra = [c for c, used in zip(KEYS, (years is not None, region != ALL, division != ALL),
                                      strict=True) if used]
        lines = dashboard_filter(star.select(column, *extra), years, region, division)
        return lines.filter(near).select(present(lines, column).cast("double").alias(column))

    def headline(
        self, star: Star, years: Sequence[int] | None = None, region: str = ALL,
        division: str = ALL,
    ) -> DataFrame:
        """Total, mean and median sale, transactions and order dates of a choice."""
        chosen = dashboard_filter(self.read("moments"), years, region, division)
        (median,) = self.quantiles(star, "sales", [0.5], years, region, division)
        at = CORRELATED.index("sales")
        carries = F.col("carried").bitwiseAND(F.lit(1 << at)) != 0
        origin = F.lit(_origins(self._state())[at])
        n = F.sum(F.when(carries, F.col("n")))
        total = F.sum(F.when(carries, F.col(f"s{at}") + F.col("n") * origin))
        return chosen.agg(
            F.coalesce(total, F.lit(0.0)).alias("total_sales"), n.alias("__n"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_transactions"),
            F.to_date(F.min("first_order")).alias("first_order"),
            F.to_date(F.max("last_order")).alias("last_order"),
        ).select(
            "total_sales", ratio("total_sales", "__n").alias("average_sale"),
            F.lit(median).cast("double").alias("median_sale"), "n_transactions", "first_order",
            "last_order",
        )


def _bins(lines: DataFrame, measures: Sequence[str]) -> DataFrame:
    entries = [
        F.struct(F.lit(m).alias("measure"), present(lines, m).cast("double").alias("v"))
        for m in measures
    ]
    long = lines.select(*KEYS, F.inline(F.array(*entries))).filter("v IS NOT NULL")
    return long.groupBy(*KEYS, "measure", bin_of(F.col("v")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _orders(orders: DataFrame) -> DataFrame:
    number = col("number").cast("bigint")
    return (
        orders.filter(number.isNotNull())
        .groupBy(*KEYS, F.bitmap_bucket_number(number).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("orders"))
    )


def _origins(state: dict) -> list[float]:
    return state["origins"] or [0.0] * len(CORRELATED)


def _data(state: dict) -> list[str]:
    """The folders of the batches, in their order."""
    return state.get("data", [])


def _merged(name: str, table: DataFrame) -> DataFrame:
    """The rows of all batches added up."""
    if name == "orders":
        return table.groupBy(*KEYS, "bucket").agg(F.bitmap_or_agg("orders").alias("orders"))
    by = {"sums": DIMENSIONS, "moments": (*KEYS, "carried"), "bins": (*KEYS, "measure", "bin")}[name]
    how = {"lo": F.min, "hi": F.max, "first_order": F.min, "last_order": F.max}

    def added(c: str) -> Column:
        kind = how.get(c, how.get(c.rstrip("0123456789"), F.sum))
        return kind(col(c)).alias(c)

    return table.groupBy(*[col(c) for c in by]).agg(
        *[added(c) for c in table.columns if c not in by]
    )
