"""The star schema: one fact, lookups joined on demand.

A left join cannot be dropped by the optimizer unless it knows the lookup key
is unique, so the star builds only the joins a caller's columns need.  Lookups
carry no broadcast hints: Spark broadcasts a lookup when its size on disk (or
its measured size, at run time) is below the threshold, and otherwise shuffles
and splits hot keys.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.functions.columns import col, date_parts, elapsed_days, present
from martlens.sources.tables import materialize, save_bucketed


@dataclass(frozen=True)
class Lookup:
    """A dimension joined to the fact (or to an earlier lookup) by its key."""

    name: str
    table: DataFrame
    keys: tuple[str, ...]

    @property
    def provides(self) -> set[str]:
        return set(self.table.columns) - set(self.keys)


def duplicate_lookup_keys(lookup: Lookup, nulls_match: bool = False) -> DataFrame:
    """Keys that would multiply fact rows; a null key does so only where nulls match."""
    table = lookup.table if nulls_match else lookup.table.dropna(subset=list(lookup.keys))
    return (
        table.groupBy(*[col(k) for k in lookup.keys])
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .filter("n_rows > 1")
    )


def left_join(
    df: DataFrame, table: DataFrame, keys: Sequence[str], nulls_match: bool = False
) -> DataFrame:
    """Left equi-join keeping the left key columns.

    ``nulls_match`` lets a null key meet a null key, as data-frame merges do;
    SQL equality does not.
    """
    if not nulls_match:
        return df.join(table, list(keys), "left")
    renamed = table.withColumnsRenamed({k: f"__{k}" for k in keys})
    matches = reduce(
        lambda a, b: a & b, [col(k).eqNullSafe(col(f"__{k}")) for k in keys]
    )
    return df.join(renamed, matches, "left").drop(*[f"__{k}" for k in keys])


@dataclass(frozen=True)
class Star:
    fact: DataFrame
    lookups: tuple[Lookup, ...]

    def check_keys(self, nulls_match: bool = False) -> None:
        """Raise when a lookup key repeats: the joins would multiply fact rows."""
        for lookup in self.lookups:
            example = duplicate_lookup_keys(lookup, nulls_match).first()
            if example is not None:
                raise ValueError(f"lookup {lookup.name}: key occurs more than once: {example}")

    def _needed(self, columns: Iterable[str]) -> list[Lookup]:
        """The lookups that provide the columns, and those on the way to them."""
        wanted = set(columns) - set(self.fact.columns)
        chosen = []
        for lookup in reversed(self.lookups):
            if wanted & lookup.provides:
                chosen.append(lookup)
                wanted |= set(lookup.keys) - set(self.fact.columns)
        return chosen[::-1]

    def _folded(self, lookups: Sequence[Lookup]) -> list[Lookup]:
        """Chains of lookups folded into the one the fact refers to.

        Joining order -> customer -> nation among themselves first moves order
        rows, not fact rows: the fact is shuffled once per chain, not per hop.
        """
        folded = list(lookups)
        for child in lookups[::-1]:
            if set(child.keys) <= set(self.fact.columns):
                continue
            at = next(i for i, x in enumerate(folded) if x.name == child.name)
            for i, parent in enumerate(folded[:at]):
                if set(child.keys) <= set(parent.table.columns):
                    table = left_join(parent.table, folded[at].table, child.keys)
                    folded[i] = Lookup(parent.name, table, parent.keys)
                    del folded[at]
                    break
        return folded

    def merged(self, nulls_match: bool = False) -> DataFrame:
        """Every fact row with the columns of every lookup and the features."""
        return with_features(self._join(self.fact, self.lookups, nulls_match))

    def _join(
        self, df: DataFrame, lookups: Sequence[Lookup], nulls_match: bool = False
    ) -> DataFrame:
        # a null key that finds a partner must pass every hop on its own
        for lookup in lookups if nulls_match else self._folded(lookups):
            df = left_join(df, lookup.table, lookup.keys, nulls_match)
        return df

    def select(self, *columns: str) -> DataFrame:
        """Fact rows with just these columns, through just the joins they need.

        Relies on unique lookup keys (see ``check_keys``).
        """
        inputs = set(columns)
        if "shipping_days" in inputs:
            inputs |= {"order_date", "ship_date"}
        joined = with_features(self._join(self.fact, self._needed(inputs)), columns)
        return joined.select(*[col(c) for c in columns])

    def bucketed(self, prefix: str, key: str, buckets: int) -> Star:
        """The star with its fact and the chain behind ``key`` stored in buckets of that key.

        The lookups that the key leads to are folded into one and written as
        ``<prefix>_<lookup>``, the fact as ``<prefix>_fact``; joining both moves no row.
        Choose the key of the largest lookup, and a bucket size that fits a task.  One key
        of very many rows makes one large bucket: leave such a fact unbucketed, where a
        shuffle join splits it.  Tables of these names are replaced.
        """
        chains = self._folded(self.lookups)
        first = next((x for x in chains if x.keys == (key,)), None)
        if first is None:
            raise ValueError(f"no lookup is joined by {key} alone")
        fact = save_bucketed(self.fact, f"{prefix}_fact", [key], buckets)
        table = save_bucketed(first.table, f"{prefix}_{first.name}", [key], buckets)
        stored = Lookup(first.name, table, first.keys)
        return Star(fact, tuple(stored if x is first else x for x in chains))

    def rollup(
        self, by: Sequence[str], sums: Sequence[str], nulls_match: bool = False
    ) -> DataFrame:
        """Sums, ``n_rows`` and non-null counts ``n_<measure>`` per ``by``.

        When one lookup's key in the fact covers all joins, the fact is summed
        per key before it is joined: a key that owns a third of the fact
        collapses inside the map tasks and reaches the join as one row.
        """
        lookups = self._needed(by)
        if not nulls_match:
            lookups = self._folded(lookups)
        fact_by = [c for c in by if c in self.fact.columns]
        roots = sorted({k for x in lookups for k in x.keys if k in self.fact.columns})
        if any(set(roots) <= set(x.keys) for x in lookups):
            per_key = self.fact.groupBy(*[col(c) for c in dict.fromkeys([*roots, *fact_by])]).agg(
                *[expr.alias(name) for name, expr in _measures(self.fact, sums).items()]
            )
            joined = self._join(per_key, lookups, nulls_match)
            totals = {name: F.sum(col(name)) for name in _measures(self.fact, sums)}
        else:
            joined = self._join(self.fact, lookups, nulls_match)
            totals = _measures(joined, sums)
        return joined.groupBy(*[col(c) for c in by]).agg(
            *[expr.alias(name) for name, expr in totals.items()]
        )


def _measures(df: DataFrame, sums: Sequence[str]) -> dict[str, Column]:
    """Sums and counts of values; NaN counts as missing, as in the reports."""
    out = {"n_rows": F.count(F.lit(1))}
    for m in sums:
        out[m] = F.sum(present(df, m))
        out[f"n_{m}"] = F.count(present(df, m))
    return out


def with_features(df: DataFrame, wanted: Sequence[str] | None = None) -> DataFrame:
    """Add calendar parts of the order date and the shipping days."""
    features: dict[str, Column] = {}
    if "order_date" in df.columns:
        features = date_parts("order_date")
        if "ship_date" in df.columns:
            features["shipping_days"] = elapsed_days("order_date", "ship_date")
    return df.withColumns(
        {
            name: expr
            for name, expr in features.items()
            if name not in df.columns and (wanted is None or name in wanted)
        }
    )


def retail_star(
    sales: DataFrame, products: DataFrame, factories: DataFrame, targets: DataFrame
) -> Star:
    """The star of the four input tables, already in our column names.

    Calendar features go on the fact at once, so reports can group by them
    without any join.
    """
    return Star(
        with_features(sales),
        (
            Lookup("products", products, ("product_id", "product_name", "division")),
            Lookup("factories", factories, ("factory",)),
            Lookup("targets", targets, ("division",)),
        ),
    )


def _multiplied(star: Star, chain: Sequence[tuple[int, Lookup]]) -> DataFrame:
    """Per key of the chain's first lookup, the rows it becomes after each step: ``m<step>``.

    Only keys that become more than one row are listed.
    """
    (first, root), *rest = chain
    keys, at = list(root.keys), [first]
    grown = root.table.dropna(subset=keys)
    counts = grown.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias(f"m{first}"))
    for step, lookup in rest:
        grown = left_join(grown, lookup.table, lookup.keys)
        more = grown.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias(f"m{step}"))
        counts = counts.join(more, keys)
        at.append(step)
    return counts.filter(F.greatest(*[col(f"m{i}") for i in (*at, at[0])]) > 1)


def merge_growth(star: Star) -> DataFrame:
    """Row and column count after each join of the chain, from counts of keys.

    Every lookup is first asked for a repeated key (a small job each).  Without one a
    join adds no rows and the fact is only counted.  A chain of lookups with repeated
    keys gives a written list of the keys that multiply; the fact's root keys meet that
    list once, whatever the number of steps.
    """
    chains: dict[str, list[tuple[int, Lookup]]] = {}
    provided: dict[str, set[str]] = {}
    for step, lookup in enumerate(star.lookups, start=1):
        root = lookup.name
        if not set(lookup.keys) <= set(star.fact.columns):
            root = next(n for n, have in provided.items() if set(lookup.keys) <= have)
        chains.setdefault(root, []).append((step, lookup))
        provided.setdefault(root, set()).update(lookup.table.columns)
    repeated = {
        x.name for x in star.lookups if not duplicate_lookup_keys(x).isEmpty()
    }
    counted = star.fact
    grows: dict[int, str] = {}
    roots = [c for c in chains.values() if any(x.name in repeated for _, x in c)]
    if roots:
        keys = list(dict.fromkeys(k for c in roots for k in c[0][1].keys))
        counted = counted.select(*[col(k) for k in keys])
    for chain in roots:
        listed = materialize(_multiplied(star, chain), "repeated-keys")
        counted = counted.join(listed, list(chain[0][1].keys), "left")
        grows |= {step: chain[0][1].name for step, _ in chain}
    # after a step, every chain contributes its factor of the last of its steps so far
    totals, now = [F.count(F.lit(1)).alias("rows0")], {}
    for step in range(1, len(star.lookups) + 1):
        if step in grows:
            now[grows[step]] = F.coalesce(col(f"m{step}"), F.lit(1))
        factor = reduce(lambda a, b: a * b, now.values(), F.lit(1).cast("bigint"))
        totals.append(F.coalesce(F.sum(factor), F.lit(0)).alias(f"rows{step}"))
    widths = [len(star.fact.columns)]
    for lookup in star.lookups:
        widths.append(widths[-1] + len(lookup.provides))
    steps = [
        F.struct(
            F.lit(i).cast("bigint").alias("step"), F.lit(name).alias("joined"),
            F.col(f"rows{i}").alias("n_rows"), F.lit(widths[i]).cast("bigint").alias("n_columns"),
        )
        for i, name in enumerate(["fact", *[x.name for x in star.lookups]])
    ]
    return counted.agg(*totals).select(F.inline(F.array(*steps)))
