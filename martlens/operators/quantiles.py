"""Exact quantiles of very large columns.

The built-in exact ``percentile`` keeps every distinct value of the column in one aggregation
buffer, which one task has to hold in the end.  Here every value falls into a logarithmic
bin, a count per bin tells exactly in which bin each wanted rank lies and how many values
come before it, and only the values of those bins are sorted.  A bin that still holds many
values is cut into equal pieces first, whose counts, smallest and largest values tell where to
go on; a piece of one value needs no sorting.  Each pass is one distributed aggregate with a
small result.  All columns share the passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlens.functions.columns import col, present


WIDTH = 1.01  # a bin's upper end over its lower end
_SHIFT = 100_000  # more than the number of bins between the smallest and the largest double


def bin_of(value: Column, width: float = WIDTH) -> Column:
    """The bin of a double: whole, never falling as the number grows, 0 for zero."""
    step = F.log(F.abs(value)) / F.lit(math.log(width))
    step = F.greatest(F.least(step, F.lit(_SHIFT - 1.0)), F.lit(1.0 - _SHIFT))  # infinities too
    size = F.floor(step).cast("int") + _SHIFT
    return F.when(value == 0, 0).otherwise(F.signum(value).cast("int") * size)


def bin_range(number: int, width: float = WIDTH) -> tuple[float, float]:
    """Bounds that hold every value of a bin; they are a little wider than the bin."""
    if number == 0:
        return 0.0, 0.0
    step = abs(number) - _SHIFT
    slack, top = 1e-9, math.log(1.7e308) / math.log(width)
    low = width ** min(step, top) * (1 - slack) if step > -top else 0.0
    high = width ** (step + 1) * (1 + slack) if step + 1 < top else math.inf
    return (low, high) if number > 0 else (-high, -low)


def bin_counts(
    values: DataFrame, columns: Sequence[str]
) -> tuple[dict[str, list[tuple[int, int]]], dict[tuple[str, int], float]]:
    """(bin, number of values) of each column, ascending, and the bins of a single value.

    A row per bin reaches the driver.
    """
    entries = [
        F.struct(F.lit(i).alias("i"), bin_of(col(c)).alias("bin"), col(c).alias("v"))
        for i, c in enumerate(columns)
    ]
    long = values.select(F.inline(F.array(*entries))).filter("bin IS NOT NULL")
    counts: dict[str, list[tuple[int, int]]] = {c: [] for c in columns}
    single: dict[tuple[str, int], float] = {}
    grouped = long.groupBy("i", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    for row in grouped.collect():
        c = columns[row["i"]]
        counts[c].append((row["bin"], row["n"]))
        if row["lo"] == row["hi"]:
            single[c, row["bin"]] = row["lo"]
    return {c: sorted(found) for c, found in counts.items()}, single


def place_ranks(
    counts: Iterable[tuple[int, int]], ranks: Iterable[int]
) -> dict[int, tuple[int, int, int]]:
    """For each rank its bin, its rank inside the bin, and the values of the bin."""
    place: dict[int, tuple[int, int, int]] = {}
    wanted, below, at = sorted(ranks), 0, 0
    for number, n in counts:
        while at < len(wanted) and wanted[at] < below + n:
            place[wanted[at]] = (number, wanted[at] - below, n)
            at += 1
        below += n
    return place


def values_at(
    values: DataFrame, places: dict[str, dict[int, tuple[int, int, int]]],
    max_rows: int = 50_000, known: dict[tuple[str, int], float] | None = None,
) -> dict[str, dict[int, float]]:
    """The values at ranks that :func:`place_ranks` has placed, per column of doubles.

    One pass reads the values of the bins concerned; one that holds over ``max_rows`` is cut
    down further.  Of ``known`` bins every value is the same one.
    """
    known = known or {}
    found: dict[str, dict[int, float]] = {c: {} for c in places}
    small: dict[tuple[str, int], set[int]] = {}
    wide: dict[tuple[str, int], tuple[int, set[int]]] = {}
    for c, ranks in places.items():
        for number, inside, n in ranks.values():
            if (c, number) in known:
                continue
            if n <= max_rows:
                small.setdefault((c, number), set()).add(inside)
            else:
                wide.setdefault((c, number), (n, set()))[1].add(inside)
    picked = _pick_in_bins(values, small) if small else {}
    if wide:
        picked |= _search_in_bins(values, wide, max_rows)
    for c, ranks in places.items():
        found[c] = {
            rank: known[c, number] if (c, number) in known else picked[c, number, inside]
            for rank, (number, inside, _) in ranks.items()
        }
    return found


def _pick_in_bins(
    values: DataFrame, wanted: dict[tuple[str, int], set[int]]
) -> dict[tuple[str, int, int], float]:
    """The order statistics inside bins, by sorting their values.  Each bin is computed once."""
    columns = sorted({c for c, _ in wanted})
    entries = [
        F.struct(F.lit(i).alias("i"), bin_of(col(c)).alias("bin"), col(c).alias("v"))
        for i, c in enumerate(columns)
    ]
    some = [
        (F.col("i") == i) & F.col("bin").isin(*[b for own, b in wanted if own == c])
        for i, c in enumerate(columns)
    ]
    in_order = Window.partitionBy("i", "bin").orderBy("v")
    counted = (
        values.select(F.inline(F.array(*entries)))
        .filter(reduce(or_, some))
        .groupBy("i", "bin", "v")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(in_order))
    )
    hits = [
        (F.col("i") == columns.index(c)) & (F.col("bin") == b) & (F.col("upto") > r)
        & (F.col("upto") - F.col("n") <= r)
        for (c, b), ranks in wanted.items() for r in ranks
    ]
    out: dict[tuple[str, int, int], float] = {}
    for row in counted.filter(reduce(or_, hits)).collect():  # at most one row per rank
        key = (columns[row["i"]], row["bin"])
        for r in wanted[key]:
            if row["upto"] - row["n"] <= r < row["upto"]:
                out[*key, r] = row["v"]
    return out


PIECES = 1_000  # a bracket that holds too many values is cut into so many


@dataclass(frozen=True)
class Bracket:
    """The values of a column between two bounds, both included; of one bin, if it is given."""

    column: str
    lo: float
    hi: float
    bin: int | None = None

    def condition(self) -> Column:
        v = col(self.column)
        keep = v.between(F.lit(self.lo), F.lit(self.hi))
        return keep if self.bin is None else keep & (bin_of(v) == self.bin)

    def piece(self) -> Column:
        """A number below ``PIECES`` that never falls as the value grows."""
        spread = self.hi - self.lo
        if not 0 < spread < math.inf:
            return F.lit(0)
        share = (col(self.column) - F.lit(self.lo)) / F.lit(spread)
        return F.least(F.floor(share * PIECES), F.lit(PIECES - 1)).cast("int")


def _inside(values: DataFrame, brackets: Sequence[Bracket]) -> DataFrame:
    """(bracket number, piece, v) of every value inside one of the brackets."""
    entries: dict[str, Column] = {}
    for i, b in enumerate(brackets):
        entry = F.struct(
            F.lit(i).alias("bracket"), b.piece().alias("piece"), col(b.column).alias("v")
        )
        branch = entries[b.column].when if b.column in entries else F.when
        entries[b.column] = branch(b.condition(), entry)
    long = values.select(F.explode(F.array(*entries.values())).alias("entry"))
    return long.filter("entry IS NOT NULL").select("entry.*")


def _search_in_bins(
    values: DataFrame, wanted: dict[tuple[str, int], tuple[int, set[int]]], max_rows: int
) -> dict[tuple[str, int, int], float]:
    """The order statistics inside bins of many values, given the number of values and ranks.

    Each pass cuts the brackets that still hold over ``max_rows`` values into pieces; the
    next one starts from the smallest and the largest value of a piece, so it cuts further.
    """
    answers: dict[tuple[str, int, int], float] = {}
    small: dict[tuple[str, int, int], tuple[Bracket, int]] = {}
    search = {
        (c, number, rank): (Bracket(c, *bin_range(number), number), rank)
        for (c, number), (_, ranks) in wanted.items() for rank in ranks
    }
    while search:
        brackets = list(dict.fromkeys(b for b, _ in search.values()))
        pieces: list[list] = [[] for _ in brackets]
        grouped = _inside(values, brackets).groupBy("bracket", "piece").agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
        )
        for row in grouped.collect():  # at most PIECES rows per bracket
            pieces[row["bracket"]].append((row["piece"], row["n"], row["lo"], row["hi"]))
        number = {b: i for i, b in enumerate(brackets)}
        further = {}
        for key, (bracket, rank) in search.items():
            for _, n, lo, hi in sorted(pieces[number[bracket]]):
                if rank < n:
                    break
                rank -= n
            if lo == hi:
                answers[key] = lo
            else:
                go_on = small if n <= max_rows else further
                go_on[key] = (Bracket(bracket.column, lo, hi), rank)
        search = further
    return answers | _pick(values, small)


def _pick(
    values: DataFrame, search: dict[tuple[str, int, int], tuple[Bracket, int]]
) -> dict[tuple[str, int, int], float]:
    """The order statistics inside small brackets, by sorting their values."""
    if not search:
        return {}
    brackets = list(dict.fromkeys(b for b, _ in search.values()))
    number = {b: i for i, b in enumerate(brackets)}
    in_order = Window.partitionBy("bracket").orderBy("v")
    counted = (
        _inside(values, brackets)
        .groupBy("bracket", "v")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(in_order))
    )
    wanted = [
        (F.col("bracket") == number[b]) & (F.col("upto") > rank)
        & (F.col("upto") - F.col("n") <= rank)
        for b, rank in search.values()
    ]
    rows = counted.filter(reduce(or_, wanted)).collect()  # at most one row per rank
    return {
        key: next(
            row["v"] for row in rows
            if row["bracket"] == number[b] and row["upto"] - row["n"] <= rank < row["upto"]
        )
        for key, (b, rank) in search.items()
    }


def ranks_of(total: int, probabilities: Iterable[float]) -> set[int]:
    """The positions in the sorted values that interpolated quantiles lie between."""
    positions = [p * (total - 1) for p in probabilities]
    return {f(x) for x in positions for f in (math.floor, math.ceil)}


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    approximate: bool = False,
    accuracy: int = 2_000,
    max_rows: int = 50_000,
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation; null and NaN are skipped.

    ``max_rows`` bounds the rows that are sorted in one task for one rank: a wider bracket
    is searched on, a narrower one sorted; both give the exact value.
    ``approximate`` returns the answer of a single sketch pass instead.
    """
    values = df.select(*[present(df, c).cast("double").alias(c) for c in columns])
    if approximate:
        row = values.agg(
            *[F.percentile_approx(col(c), list(probabilities), accuracy) for c in columns]
        ).first()
        return {c: row[i] or [None] * len(probabilities) for i, c in enumerate(columns)}

    counts, single = bin_counts(values, columns)
    total = {c: sum(n for _, n in counts[c]) for c in columns}
    places = {
        c: place_ranks(counts[c], ranks_of(total[c], probabilities)) for c in columns if total[c]
    }
    found = values_at(values, places, max_rows, single)
    return {c: interpolated(found.get(c, {}), total[c], probabilities) for c in columns}


def interpolated(
    values: dict[int, float], total: int, probabilities: Sequence[float]
) -> list[float | None]:
    """Quantiles from the values at the ranks around them."""
    out: list[float | None] = []
    for p in probabilities:
        if not total:
            out.append(None)
            continue
        position = p * (total - 1)
        lower, upper = values[math.floor(position)], values[math.ceil(position)]
        out.append(lower + (upper - lower) * (position - math.floor(position)))
    return out
