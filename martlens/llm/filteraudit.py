"""How filters overlap: what each one removes in every order they could be applied.

A document's failures are a bit mask, so all that counts of a part of the corpus are its
documents per mask.  A walk through the sets of filters in Gray-code order toggles one
filter at a time: each mask keeps how many active filters it fails, and the survivors change
by the masks whose count leaves or reaches zero.  The survivors of every set are stored, and
a step of an order is the difference of two of them.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.llm.inputs import whole_text
from martlens.sources.tables import materialize

MOST_FILTERS = 7  # 5,040 orders, 128 sets
PARTS_TOGETHER = 50  # parts whose results one batch holds
NO_ID = (1 << 63) - 1
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
AUDIT = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS)


def text_filters(
    least_words: int = 50, distinct_percent: int = 65, capital_percent: int = 5
) -> dict[str, Column]:
    """Failure conditions by letter, over a column ``text`` without nulls.

    A: few words; B: few distinct words; C: many capitals A-Z; D: signs of markup.  Words
    are what stands between blanks [\\x20\\x09-\\x0D], in their own case.
    """
    text = F.col("text")
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < least_words,
        "B": 100 * F.size(F.array_distinct(words)) < distinct_percent * F.size(words),
        "C": 100 * capitals > capital_percent * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, part: str, filters: Mapping[str, Column]) -> DataFrame:
    """``doc_id, part, mask, n``: rows counted by id, part and the filters that they fail.

    Bit i is the i-th of ``filters``; the bit after them stands for a text that a smaller id
    has as well.  Texts are compared by SHA-256.  Equal rows fall together before they are
    shuffled, and the first id of a text comes from an aggregate, so that no group of copies
    is gathered; a row is no copy if its text and id are those of such a first one.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        whole_text().alias("text"),
    )
    mask = F.lit(0)
    for bit, fails in enumerate(filters.values()):
        mask = mask + F.when(fails, 1 << bit).otherwise(0)
    rows = rows.select(
        "doc_id", "part", mask.cast("int").alias("mask"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
    )
    counted = rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    counted = materialize(counted, "filter-masks")
    first = counted.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    first = first.withColumn("first", F.lit(True))
    copy = F.when(F.col("first").isNull(), 1 << len(filters)).otherwise(0)
    return counted.join(first, ["digest", "doc_id"], "left").select(
        "doc_id", "part", (F.col("mask") + copy).cast("int").alias("mask"), "n"
    )


def survivors(cells: np.ndarray, filters: int) -> np.ndarray:
    """Of each set of filters what passes them all: [set, part, measure].

    ``cells`` is [part, mask, measure].  The walk visits each set once, one toggle apart.
    """
    masks = np.arange(1 << filters)
    active = np.zeros(1 << filters, np.int64)  # active filters that a mask fails
    running = cells.sum(axis=1)
    states = np.empty((1 << filters, *running.shape), np.int64)
    states[0] = running
    before = 0
    for i in range(1, 1 << filters):
        now = i ^ (i >> 1)
        toggled = now ^ before
        hit = masks & toggled != 0
        if now & toggled:
            active[hit] += 1
            running = running - cells[:, hit & (active == 1)].sum(axis=1)
        else:
            active[hit] -= 1
            running = running + cells[:, hit & (active == 0)].sum(axis=1)
        states[now] = running
        before = now
    return states


def order_steps(cells: np.ndarray, filters: int) -> dict[str, np.ndarray]:
    """The counts of every order and step, each [order * step, part]; orders ascend.

    ``cells`` has the documents, the good and the toxic ones as its three measures.
    """
    states = survivors(cells, filters)
    orders = np.array(list(itertools.permutations(range(filters))))
    after = np.cumsum(1 << orders, axis=1)
    before, after, own = (after - (1 << orders)).ravel(), after.ravel(), orders.ravel()
    lost = states[before] - states[after]
    alone = 1 << np.arange(filters)
    fails = states[0, :, 0] - states[alone, :, 0]  # [filter, part]
    shares = np.zeros((filters, cells.shape[0]), np.int64)
    np.add.at(shares, own, lost[:, :, 0])
    return {
        "kept": states[after, :, 0], "removed": lost[:, :, 0],
        "redundant": fails[own] - lost[:, :, 0],
        "unique_fails": cells[:, alone, 0].T[own],
        "good_lost": lost[:, :, 1], "toxic_lost": lost[:, :, 2], "shapley": shares[own],
    }


def audit_orders(masks: DataFrame, labels: DataFrame, names: Sequence[str]) -> DataFrame:
    """The audit of ``doc_id, part, mask, n``; ``names`` are letters in the order of the bits."""
    k = len(names)
    if not 0 < k <= MOST_FILTERS:
        raise ValueError(f"from 1 to {MOST_FILTERS} filters")
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("bigint").alias("doc_id")
    ).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"),
          F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = marks.filter("good = 1 OR toxic = 1")
    marked = masks.join(marks, "doc_id", "left")
    cells = marked.groupBy("part", "mask").agg(
        F.sum("n").alias("docs"),
        F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )
    # a part has at most one row per mask
    tables = cells.groupBy("part").agg(
        F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("cells")
    )
    orders = ["".join(x) for x in itertools.permutations(names)]
    rows_each = math.factorial(k) * k

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), PARTS_TOGETHER):
                batch = whole.slice(at, PARTS_TOGETHER)
                lists = batch.column("cells")
                held = lists.flatten()
                owner = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())
                cells = np.zeros((len(batch), 1 << k, 3), np.int64)
                mask = held.field("mask").to_numpy()
                for i, measure in enumerate(("docs", "good", "toxic")):
                    cells[owner, mask, i] = held.field(measure).to_numpy()
                counts = order_steps(cells, k)
                part = np.repeat(np.arange(len(batch)), rows_each)
                columns = {
                    "part": batch.column("part").take(pa.array(part)),
                    "filter_order": pa.array(np.repeat(orders, k).tolist() * len(batch)),
                    "step": pa.array(np.tile(np.arange(1, k + 1), len(orders) * len(batch)), pa.int32()),
                }
                columns |= {c: pa.array(counts[c].T.ravel(), pa.int64()) for c in COUNTS}
                yield pa.RecordBatch.from_pydict(columns)

    return tables.mapInArrow(walk, AUDIT)


def filter_audit(
    docs: DataFrame, labels: DataFrame, part: str = "source",
    filters: Mapping[str, Column] | None = None, copies: str = "E",
) -> DataFrame:
    """What each filter removes at each step of every order, per value of ``part``.

    ``filters`` maps letters to failure conditions over ``text`` (by default A to D of
    :func:`text_filters`); the letter ``copies`` stands for texts that a smaller id has too,
    anywhere in the table, removed or not.  A row per part, order of all letters and step
    (from 1) counts the documents of the part: ``kept`` after the step, ``removed`` by it,
    ``redundant`` (they fail its filter but went before), ``unique_fails`` (they fail its
    filter only), ``good_lost`` and ``toxic_lost`` (removed ones that ``labels`` marks
    quality 1 or toxic 1), and ``shapley``, its filter's removals summed over all orders.

    A null text is empty, a null part the empty string.  Null ids come after all others:
    such a row is a copy if a row with an id has its text.  Rows equal in id and text are
    no copies of each other, and each counts.  Of several labels of an id any mark counts.
    Other columns are left behind; an empty table gives no rows.
    """
    chosen = text_filters() if filters is None else dict(filters)
    return audit_orders(failure_masks(docs, part, chosen), labels, [*chosen, copies])
