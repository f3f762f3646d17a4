"""Sum-of-squares packing of token sequences.

Documents become pieces of at most ``size`` tokens.  Full pieces fill a sequence of
their own.  The others are dealt evenly into groups of bounded size, and each group
places its pieces one by one where the sum of squared counts of open sequences per
residual gap becomes smallest; of equal places the smallest gap is taken.  Long pieces go
first, and the shortest ones last in mixed order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.llm.bpe import slices
from martlens.llm.inputs import documents
from martlens.llm.wordtokens import word_ids
from martlens.sources.tables import materialize

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, deal bigint"
PACKED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, " \
         "sequence_id bigint, offset bigint"  # fmt: skip


def pieces(docs: DataFrame, path: str, size: int, end_id: int) -> DataFrame:
    """Pieces of every document; ``deal`` is an even number for dealing them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_ids(path)
        end = np.array([end_id], "<u4").tobytes()
        context = TaskContext.get()
        serial = (context.partitionId() if context else 0) << 40
        for batch in batches:
            for small in slices(batch, "text"):
                rows = []
                ids = small.column("doc_id").to_pylist()
                for doc, flat in zip(ids, model.run(small.column("text").to_pylist()), strict=True):
                    flat += end
                    for k, at in enumerate(range(0, len(flat), 4 * size)):
                        part = flat[at : at + 4 * size]
                        serial += 1
                        rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), serial))
                columns = list(zip(*rows, strict=True))
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "deal")
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_pydict(
                    {n: pa.array(c, t) for n, c, t in zip(names, columns, kinds, strict=True)}
                )

    return documents(docs).mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed in the given order.

    Only gaps of open bins count.  A piece that goes into gap g leaves gap g - length,
    so the sum changes by 2 (count[g - length] - count[g]) + 2, less where g closes.
    """
    count = np.zeros(size + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    used: list[int] = []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, n in enumerate(lengths.tolist()):
        # change of the sum for each gap n .. size - 1; counts of gap 0 stay 0
        after = count[: size - n]
        change = 2 * (after - count[n:size]) + 2
        if n < size:
            change[0] = 1 - 2 * count[n]
            change[count[n:size] == 0] = np.iinfo(np.int64).max
            best = int(change.argmin())
            fresh = 2 * count[size - n] + 1
            if change[best] <= fresh:
                gap = best + n
                at = open_bins[gap].pop()
                count[gap] -= 1
            else:
                gap, at = size, len(used)
                used.append(0)
        else:
            gap, at = size, len(used)
            used.append(0)
        bins[k], offsets[k] = at, used[at]
        used[at] += n
        left = gap - n
        if left:
            open_bins[left].append(at)
            count[left] += 1
    return bins, offsets


SHUFFLED = 5  # one in so many pieces, the shortest, is not placed by its length


def placing_order(lengths: np.ndarray, deal: np.ndarray) -> np.ndarray:
    """Longest first, but the shortest fifth last and in the order of a hash of ``deal``.

    Short pieces in mixed order find the gaps that the long ones leave; in order of length
    the last ones would all be of one size and open sequences of their own.
    """
    order = np.lexsort((deal, -lengths))
    tail = order[len(order) - len(order) // SHUFFLED :]
    mixed = deal[tail].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    order[len(order) - len(tail) :] = tail[np.lexsort((deal[tail], mixed * np.uint64(0xBF58476D1CE4E5B9)))]
    return order


def pack(
    docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, group_rows: int = 30_000
) -> DataFrame:
    """Pack all documents into as few sequences of at most ``size`` tokens as it can.

    A document is its ids under the tokenizer file ``path`` (which every executor has)
    followed by ``end_id``; only longer ones are cut, the last piece may be shorter.
    Returns a row per piece: where it starts in its document, its length, the CRC-32 of
    its ids, the sequence and its place there.  Sequences have no gaps.

    Pieces shorter than ``size`` are dealt evenly into groups of about ``group_rows``,
    whatever their documents are; a group is packed in one task, in :func:`placing_order`.
    On 30,000 pieces of the test documents that takes less than 0.01 percent more sequences
    than their tokens would fill; groups of 100,000 are no better.

    Null and empty texts become the single token ``end_id``.  Rows with null or repeated
    ids are packed like any others, each on its own.  Other columns are left behind; an
    empty table gives an empty result.
    """
    cut = materialize(pieces(docs, path, size, end_id), "pieces")
    short = cut.filter(F.col("length") < size)
    groups = max(1, -(-short.count() // group_rows))

    def place(table: pd.DataFrame) -> pd.DataFrame:
        lengths, deal = (table[c].to_numpy() for c in ("length", "deal"))
        table = table.iloc[placing_order(lengths, deal)]
        bins, offsets = sum_of_squares(table["length"].to_numpy(), size)
        # the group's number, then the bin: full pieces have the odd numbers
        table["sequence_id"] = 2 * (bins * groups + table["group"].to_numpy())
        table["offset"] = offsets
        return table[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    dealt = short.withColumn("group", F.pmod(F.xxhash64("deal"), F.lit(groups)))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = cut.filter(F.col("length") >= size).select(
        *columns, (2 * F.col("deal") + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    return full.unionByName(dealt.groupBy("group").applyInPandas(place, PACKED))
