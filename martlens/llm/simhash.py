"""Near duplicates by SimHash fingerprints and deletion variants.

Fingerprints that differ by at most d bits are cut into d // 2 + 1 segments: in one of
them they differ by at most one bit.  So each distinct fingerprint is indexed under its
segments as they are and with each single bit of a segment left out; two fingerprints
that share such a key are compared in full.  Equal keys meet by a shuffle.  A key's group
gives a link from each member to the smallest one that it reaches in the group, never
its pairs.

A group of more than ``hot_rows`` fingerprints is not gathered: its members are indexed
again with every set of d bits left out.  Equal keys then mean a link, and such a group
has at most 2**d members.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.llm.bpe import slices
from martlens.llm.components import components
from martlens.llm.inputs import documents
from martlens.sources.tables import materialize

SEED = 42
BITS = 64


BLOCK = 1 << 16  # hashes whose bits are counted at a time


def text_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, of all words if there are fewer."""
    words = text.encode().lower().split()  # A-Z only; blanks are \x20 and \x09-\x0D
    if not words:
        return np.empty(0, np.uint64)
    flat = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(flat, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = len(words) - shingle + 1
    del words
    hashed, out = xxhash.xxh64_intdigest, np.empty(n, np.uint64)
    for at in range(0, n, BLOCK):
        out[at : at + BLOCK] = [
            hashed(flat[a:b], SEED)
            for a, b in zip(starts[at : min(at + BLOCK, n)].tolist(),
                            ends[shingle - 1 :][at : at + BLOCK].tolist(), strict=True)
        ]
    return out


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of hashes: the bits that are set in over half of it.

    Bits are unpacked for ``BLOCK`` hashes at a time, however long a run is.
    """
    votes = np.zeros((len(sizes), BITS), np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for at in range(0, len(hashes), BLOCK):
        own = owner[at : at + BLOCK]
        raw = hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        votes[own[starts]] += np.add.reduceat(
            np.unpackbits(raw, axis=1), starts, axis=0, dtype=np.int64
        )
    set_bits = votes * 2 > sizes[:, None]
    return np.packbits(set_bits, axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id``, ``fp`` (the 64-bit fingerprint, signed) and ``text_hash`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in slices(batch, "text", 1 << 20):
                hashes = [text_hashes(t, shingle) for t in small.column("text").to_pylist()]
                sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
                flat = np.concatenate(hashes)
                yield pa.RecordBatch.from_arrays(
                    [small.column("doc_id"), pa.array(majority(flat, sizes).view(np.int64)),
                     small.column("text_hash")],
                    names=["doc_id", "fp", "text_hash"],
                )

    rows = documents(docs).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint, text_hash bigint")


def segment_masks(distance: int) -> list[int]:
    """Masks of the bits of each segment."""
    n = distance // 2 + 1
    cuts = [BITS * k // n for k in range(n + 1)]
    return [(1 << b) - (1 << a) for a, b in itertools.pairwise(cuts)]


def variant_masks(distance: int) -> list[int]:
    """What is left of a fingerprint under each key: a segment, whole or less one bit."""
    out = []
    for mask in segment_masks(distance):
        out.append(mask)
        if distance:
            out += [mask & ~(1 << b) for b in range(BITS) if mask >> b & 1]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(prints: DataFrame, masks: list[int]) -> DataFrame:
    listed = F.array(*[F.lit(_signed(m)) for m in masks])
    placed = prints.select("fp", F.posexplode(listed).alias("variant", "mask"))
    masked = F.col("fp").bitwiseAND(F.col("mask"))
    return placed.select(F.xxhash64("variant", masked).alias("key"), "fp")


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def _group_links(own: np.ndarray, distance: int, dense: int = 3000) -> tuple:
    """Each member of a group with the smallest member that it reaches."""
    label = np.arange(len(own), dtype=np.int32)
    if len(own) <= dense:
        near = np.concatenate([
            _near(own[a : a + 256, None], own[None, :], distance)
            for a in range(0, len(own), 256)
        ])
        while True:
            low = np.concatenate([
                np.where(near[a : a + 256], label[None, :], np.int32(len(own))).min(axis=1)
                for a in range(0, len(own), 256)
            ])
            low = low[low]
            if (low == label).all():
                break
            label = low
    else:
        differing = np.bitwise_or.reduce(own ^ own[0])
        places = [b for b in range(BITS) if int(differing) >> b & 1]
        sets = list(itertools.combinations(places, min(distance, len(places))))
        while True:
            before = label.copy()
            for bits in sets:
                left = own & ~np.uint64(sum(1 << b for b in bits))
                order = np.argsort(left, kind="stable")
                starts = np.flatnonzero(np.append(True, left[order][1:] != left[order][:-1]))
                if len(starts) == len(own):
                    continue
                low = np.minimum.reduceat(label[order], starts)
                label[order] = np.repeat(low, np.diff(np.append(starts, len(own))))
            label = label[label]
            if (label == before).all():
                break
    moved = np.flatnonzero(label != np.arange(len(own)))
    return own[moved], own[label[moved]]


class _Forest:
    """Drops links between fingerprints that this task has already connected."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def fresh(self, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
        out_a, out_b = [], []
        for x, y in set(zip(a.tolist(), b.tolist(), strict=True)):
            p, q = self.root(x), self.root(y)
            if p != q:
                self.up[max(p, q)] = min(p, q)
                out_a.append(x)
                out_b.append(y)
        return out_a, out_b


def _bucket_links(distance: int, hot_rows: int, few: int = 24):
    """Links among rows sorted by key and fingerprint; of a hot group, its members alone."""

    def links(key: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(starts, len(key)))
        left, right = [], []
        small = np.repeat(sizes <= few, sizes)
        for gap in range(1, min(few, int(sizes.max()))):
            at = np.flatnonzero((key[gap:] == key[:-gap]) & small[gap:])
            if not len(at):
                break
            at = at[_near(own[at], own[at + gap], distance)]
            left.append(own[at + gap])
            right.append(own[at])
        for k in np.flatnonzero(sizes > few).tolist():
            a, b = _group_links(own[starts[k] : starts[k] + sizes[k]], distance)
            left.append(a)
            right.append(b)
        none = np.empty(0, np.uint64)
        return np.concatenate([none, *left]), np.concatenate([none, *right])

    def batch_of(a: list[int], b: list[int | None]) -> pa.RecordBatch:
        signed = [[x if x is None else _signed(x) for x in side] for side in (a, b)]
        return pa.RecordBatch.from_arrays(
            [pa.array(side, pa.int64()) for side in signed], names=["a", "b"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        key, own = np.empty(0, np.int64), np.empty(0, np.uint64)
        hot = None  # the key of a group that is passed on
        for batch in batches:
            more = batch.column("key").to_numpy()
            prints = batch.column("fp").to_numpy().view(np.uint64)
            if hot is not None:
                mine = more == hot
                if mine.any():
                    yield batch_of(prints[mine].tolist(), [None] * int(mine.sum()))
                    more, prints = more[~mine], prints[~mine]
                if not len(more):
                    continue
                hot = None
            key, own = np.concatenate([key, more]), np.concatenate([own, prints])
            begin = int(np.searchsorted(key == key[-1], True))  # where the open group starts
            if begin:
                a, b = forest.fresh(*links(key[:begin], own[:begin]))
                yield batch_of(a, b)
                key, own = key[begin:], own[begin:]
            if len(key) > hot_rows:
                hot = key[0]
                yield batch_of(own.tolist(), [None] * len(own))
                key, own = key[:0], own[:0]
        if len(key):
            a, b = forest.fresh(*links(key, own))
            yield batch_of(a, b)

    return run


def print_links(prints: DataFrame, distance: int, hot_rows: int) -> DataFrame:
    """Links (a, b) that connect what is connected; ``prints`` has distinct ``fp``."""
    spark = prints.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = _keyed(prints, variant_masks(distance)).repartition(n, "key")
    keyed = keyed.sortWithinPartitions("key", "fp")
    out = materialize(
        keyed.mapInArrow(_bucket_links(distance, hot_rows), "a bigint, b bigint"), "print-links"
    )
    found = out.filter(F.col("b").isNotNull())
    hot = out.filter(F.col("b").isNull()).select(F.col("a").alias("fp")).distinct()
    if hot.isEmpty():
        return found
    masks = [
        ~sum(1 << b for b in bits) & ((1 << BITS) - 1)
        for bits in itertools.combinations(range(BITS), distance)
    ]
    groups = _keyed_exact(hot, masks).groupBy("variant", "left").agg(
        F.collect_set("fp").alias("own")
    )
    pairs = groups.filter(F.size("own") > 1).select(
        F.array_min("own").alias("b"), F.explode("own").alias("a")
    )
    return found.unionByName(pairs.filter("a != b").select("a", "b").distinct())


def _keyed_exact(prints: DataFrame, masks: list[int]) -> DataFrame:
    listed = F.array(*[F.lit(_signed(m)) for m in masks])
    placed = prints.select("fp", F.posexplode(listed).alias("variant", "mask"))
    return placed.select("variant", F.col("fp").bitwiseAND(F.col("mask")).alias("left"), "fp")


def near_duplicates(
    docs: DataFrame, shingle: int = 3, distance: int = 2, hot_rows: int = 100_000
) -> DataFrame:
    """Fingerprint and component of every row: ``doc_id``, ``fingerprint``, ``component_id``,
    ``component`` (its smallest fingerprint, signed) and ``text_hash``.

    Words are runs without blanks, A-Z lower-cased; a shingle is ``shingle`` words joined
    by spaces (all words if there are fewer).  A fingerprint bit is 1 if it is set in over
    half of the shingles' XXH64 values (seed 42).  Rows whose fingerprints differ in at
    most ``distance`` bits are linked; ``component_id`` is the smallest ``doc_id`` reached.

    A text that is null, empty or blank has the fingerprint zero and is linked like any
    other.  Repeated ids keep a row each; null ids never become a component's id unless it
    has no other.  Other columns are left behind; an empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, shingle), "fingerprints")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    roots = components(print_links(prints.select("fp"), distance, hot_rows), "print-links")
    placed = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    placed = placed.select("fp", F.coalesce("root", "fp").alias("root"), "first")
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = placed.join(named, "root").select("fp", "component_id", "root")
    return rows.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
        F.col("root").alias("component"), "text_hash",
    )
