"""Document fingerprints that add up: homomorphic hashes of the multiset of paragraphs.

A paragraph hashes to a wide vector, a document's fingerprint is the sum of the vectors of
its paragraphs, lane by lane modulo a power of two.  So it does not depend on their order,
equal multisets have equal sums, and a paragraph is added or taken away without the others.

The vector has two parts.  Eight 64-bit lanes (modulo 2^64) are a BLAKE2b digest of the
paragraph and tell different multisets apart.  256 32-bit lanes (modulo 2^32) get +1 or -1
for each run of 16 bytes of the paragraph: the products of two such sums estimate how many
runs two documents share, whatever paragraphs they stand in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlens.llm.bpe import slices
from martlens.llm.inputs import documents, numbered, parts, whole_text

EXACT, LANES, RUN = 8, 256, 16
WIDTH = EXACT * 8 + LANES * 4  # bytes of a fingerprint
# Odd multipliers that spread the bits of a run.
_SPREAD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


class Sums(NamedTuple):
    """Fingerprints of several documents, a row each."""

    exact: np.ndarray  # [n, EXACT] unsigned 64-bit
    lanes: np.ndarray  # [n, LANES] unsigned 32-bit

    def __add__(self, other: Sums) -> Sums:  # type: ignore[override]
        return Sums(self.exact + other.exact, self.lanes + other.lanes)

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.exact - other.exact, self.lanes - other.lanes)

    def at(self, chosen) -> Sums:
        return Sums(self.exact[chosen], self.lanes[chosen])

    def hex(self) -> list[str]:
        wide = np.concatenate(
            [self.exact.astype("<u8").view(np.uint8), self.lanes.astype("<u4").view(np.uint8)], 1
        )
        return [row.tobytes().hex() for row in wide]


def from_hex(fingerprints: Sequence[str]) -> Sums:
    wide = np.frombuffer(bytes.fromhex("".join(fingerprints)), np.uint8).reshape(-1, WIDTH)
    exact = np.ascontiguousarray(wide[:, : EXACT * 8]).view("<u8")
    return Sums(exact, np.ascontiguousarray(wide[:, EXACT * 8 :]).view("<u4"))


def paragraphs(text: str) -> list[bytes]:
    """The lines of a text, empty ones too."""
    return text.encode().split(b"\n")


def sums(documents: Sequence[Sequence[bytes]]) -> Sums:
    """The fingerprint of each list of paragraphs; of an empty list, zero."""
    n = len(documents)
    held = np.fromiter(map(len, documents), np.int64, n)
    flat = [p for d in documents for p in d]
    exact, lanes = np.zeros((n, EXACT), np.uint64), np.zeros((n, LANES), np.uint32)
    if not flat:
        return Sums(exact, lanes)
    digests = b"".join([hashlib.blake2b(p, digest_size=EXACT * 8).digest() for p in flat])
    running = np.zeros((len(flat) + 1, EXACT), np.uint64)
    np.cumsum(np.frombuffer(digests, "<u8").reshape(-1, EXACT), axis=0, out=running[1:])
    ends = np.cumsum(held)
    exact = running[ends] - running[ends - held]

    # runs of 16 bytes as two words; a shorter paragraph is one run, filled with zeros
    sizes = np.fromiter(map(len, flat), np.int64, len(flat))
    room = np.where(sizes > 0, np.maximum(sizes, RUN), 0)
    owner = np.repeat(np.arange(n), held)
    raw = b"".join([p if len(p) >= RUN or not p else p.ljust(RUN, b"\0") for p in flat])
    total = len(raw) - RUN + 1
    if total <= 0:
        return Sums(exact, lanes)
    left, right = (
        np.ndarray(total, "<u8", raw, offset, (1,)) for offset in (0, RUN // 2)
    )
    mixed = left * _SPREAD[0]
    mixed ^= mixed >> np.uint64(29)
    mixed += right
    mixed *= _SPREAD[1]
    mixed ^= mixed >> np.uint64(32)
    mixed *= _SPREAD[2]
    mixed >>= np.uint64(64 - 9)  # eight bits of lane and one of sign
    spot = mixed.astype(np.int64)
    # no run crosses from one paragraph into the next
    inside = np.ones(len(raw), bool)
    for back in range(1, RUN):
        inside[np.cumsum(room)[room > 0] - back] = False
    inside = inside[:total]
    runs = np.maximum(room - RUN + 1, 0)
    spot = spot[inside] + np.repeat(owner * (2 * LANES), runs)
    counts = np.bincount(spot, minlength=n * 2 * LANES).reshape(n, LANES, 2)
    return Sums(exact, (counts[:, :, 0] - counts[:, :, 1]).astype(np.uint32))


def likeness(a: Sums, b: Sums) -> np.ndarray:
    """From 0 to 1, row by row: 1 for equal fingerprints, else the cosine of the lanes."""
    x, y = (s.lanes.view(np.int32).astype(np.float64) for s in (a, b))
    size = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    cosine = np.divide((x * y).sum(axis=1), size, out=np.zeros(len(x)), where=size > 0)
    equal = (a.exact == b.exact).all(axis=1) & (a.lanes == b.lanes).all(axis=1)
    return np.where(equal, 1.0, np.clip(cosine, 0.0, 1.0))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the ``fingerprint`` of their whole text (hex).

    Paragraphs are lines; an empty line is one, a null or empty text is one empty line.
    Null and repeated ids keep a row each, a column of that name is replaced, and an empty
    table gives an empty result.
    """
    plain, names = numbered(docs, ("fingerprint",))
    text = f"c{names.index('text')}"
    schema = T.StructType([*plain.schema.fields, T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in slices(batch, text):
                found = sums([paragraphs(t or "") for t in small.column(text).to_pylist()])
                yield small.append_column("fingerprint", pa.array(found.hex(), pa.string()))

    return plain.mapInArrow(run, schema).toDF(*names, "fingerprint")


def change_fingerprints(changes: DataFrame) -> DataFrame:
    """``fingerprint`` after ``removed`` and ``added`` (arrays of paragraphs), without the text.

    Null arrays change nothing; a null fingerprint is the one of no paragraphs.  Other
    columns stay.
    """
    plain, names = numbered(changes)
    own, out, into = (f"c{names.index(c)}" for c in ("fingerprint", "removed", "added"))
    zero = "0" * (2 * WIDTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, new = (
                sums([[p.encode() for p in x or []] for x in batch.column(c).to_pylist()])
                for c in (out, into)
            )
            now = from_hex([x or zero for x in batch.column(own).to_pylist()]) - gone + new
            at = batch.schema.get_field_index(own)
            yield batch.set_column(at, own, pa.array(now.hex(), pa.string()))

    return plain.mapInArrow(run, plain.schema).toDF(*names)


PAIRS = "doc_id bigint, n_chars bigint, edited string, edited_sha256 string, fingerprint string, " \
        "edited_fingerprint string, near_edited double, near_next double"  # fmt: skip


def _compared(ids: list, texts: list[str], following: list[str], own: Sums, after: Sums) -> dict:
    """Columns of PAIRS: each text, and it with its second half from the following one."""
    edited, out, into = [], [], []
    for text, other in zip(texts, following, strict=True):
        half = len(text) // 2
        head = text[: len(text) - half]
        edited.append(head + other[:half])
        whole = head.count("\n")  # paragraphs that the edit leaves as they are
        out.append(paragraphs(text)[whole:])
        into.append(paragraphs(edited[-1])[whole:])
    changed = own - sums(out) + sums(into)
    return {
        "doc_id": pa.array(ids, pa.int64()),
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited": pa.array(edited, pa.string()),
        "edited_sha256": pa.array(
            [hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        "fingerprint": pa.array(own.hex(), pa.string()),
        "edited_fingerprint": pa.array(changed.hex(), pa.string()),
        "near_edited": pa.array(likeness(own, changed), pa.float64()),
        "near_next": pa.array(likeness(own, after), pa.float64()),
    }


def compare_with_next(
    docs: DataFrame, texts: bool = True, part_bytes: int = 64 << 20
) -> DataFrame:
    """Each document, the next one, and a mixture of both, compared by fingerprints.

    The next document is the one of the next smaller ``doc_id``, after the last the first;
    null ids come last, and rows of one id go by the hash of their text.  ``edited`` (left
    out unless ``texts``) is the text with its last floor(n_chars / 2) code points replaced
    by the first as many, or all, of the next document.  Its fingerprint is the own one less
    the paragraphs that the edit takes, plus those it brings.  ``near_edited`` and
    ``near_next`` are the likeness of the own fingerprint to it and to the next document's.

    Rows are shuffled once, by ranges of ids of about ``part_bytes`` of text; a task reads
    its range as a stream and keeps one row back.  Only the last row of each range meets
    the first of the next through a window, which holds one row per range.

    A null or empty text is one empty paragraph; a single row is its own next.  Repeated
    ids keep a row each; other columns are left behind; an empty table gives no rows.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(whole_text()))).head()[0] or 0
    # the row number parts a group of equal rows over ranges
    rows = documents(docs).select(
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("place"), F.xxhash64("text").alias("hash"),
        F.monotonically_increasing_id().alias("serial"), "doc_id", "text",
    )
    order = [F.desc("place"), F.isnull("doc_id").cast("int"), F.desc("hash"), F.desc("serial")]
    ranges = rows.repartitionByRange(parts(spark, total, part_bytes), *order)
    ranges = ranges.sortWithinPartitions(*order)
    schema = ", ".join(
        f for f in PAIRS.split(", ") if texts or f != "edited string"
    )

    def given(columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {c: v for c, v in columns.items() if texts or c != "edited"})

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, own = [], [], sums([])  # the row that waits for its next
        for batch in batches:
            for small in slices(batch, "text"):
                now = small.column("text").to_pylist()
                ids += small.column("doc_id").to_pylist()
                held += now
                found = sums([paragraphs(t) for t in now])
                own = Sums(*[np.concatenate(x) for x in zip(own, found, strict=True)])
                if len(ids) > 1:
                    yield given(_compared(ids[:-1], held[:-1], held[1:], own.at(slice(-1)),
                                          own.at(slice(1, None))))
                ids, held, own = ids[-1:], held[-1:], own.at(slice(-1, None))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if len(batch):
                first = first or batch.slice(0, 1)
                last = batch.slice(len(batch) - 1)
        if first is not None:
            names = ["place", "odd", "hash", "serial", "text", "last_id", "last_text"]
            odd = pa.array([int(not first.column("doc_id")[0].is_valid)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [first.column("place"), odd, first.column("hash"), first.column("serial"),
                 first.column("text"), last.column("doc_id"), last.column("text")], names=names,
            )

    ends = ranges.mapInArrow(
        edges, "place bigint, odd int, hash bigint, serial bigint, text string, "
               "last_id bigint, last_text string")  # fmt: skip
    window = Window.orderBy(F.desc("place"), "odd", F.desc("hash"), F.desc("serial"))
    following = F.coalesce(F.lead("text").over(window), F.first("text").over(window))
    joints = ends.select("last_id", "last_text", following.alias("following"))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in slices(batch, "last_text"):
                ids, own, after = (c.to_pylist() for c in small.columns)
                yield given(_compared(ids, own, after, sums([paragraphs(t) for t in own]),
                                      sums([paragraphs(t) for t in after])))

    # both read the one shuffle by ranges
    return ranges.mapInArrow(within, schema).unionByName(joints.mapInArrow(across, schema))
