"""Dropping lines that many documents share.

Documents lie in buckets by hash.  Each bucket asks once for each line hash that it
holds.  A shard of the index is a minimal perfect hash over the distinct line hashes
of the shard with a fingerprint and a document count per slot; requests are sent to
their shard, which answers with the frequent ones, and the bucket drops those lines.
Texts are never joined to lines: a hot line is one request per bucket, and a shard with very
many requests is copied for parts of the buckets.  Rows that repeat very often are dealt over
several buckets, each of which asks for their lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlens.llm.inputs import numbered, whole_text
from martlens.llm.perfecthash import MinimalHash, mix
from martlens.sources.tables import materialize

BLANKS = b" \t\n\v\f\r"
HASHES = "bucket bigint, hi bigint, lo bigint"
HELD = "bucket bigint, spread int, doc bigint, hi bigint, lo bigint"
ROW_BYTES = 64  # what a row takes besides its text
INDEX = "shard bigint, size bigint, hash binary, fingerprints binary, counts binary"


def keys_of(text: str) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text as UTF-8, and the key of each."""
    lines = text.encode().split(b"\n")
    return lines, [line.strip(BLANKS).lower() for line in lines]


def digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return flat[:, 0], flat[:, 1]


def _words(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(table.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("hi", "lo"))


def held_lines(rows: DataFrame, least_chars: int) -> DataFrame:
    """Per bucket, repeated document (or none) and line hash, how many rows hold the line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, digests = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                keys = set(keys_of(text)[1])
                if least_chars == 1:
                    keys.discard(b"")
                else:  # code points, not bytes
                    keys = {k for k in keys if len(k.decode("utf-8", "replace")) >= least_chars}
                own = list(map(digest, keys))
                digests += own
                at += [k] * len(own)
            hi, lo = _halves(digests)
            given = batch.select(["bucket", "spread", "doc"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*given.columns, pa.array(hi), pa.array(lo)],
                names=["bucket", "spread", "doc", "hi", "lo"],
            )

    found = rows.select("bucket", "spread", "doc", "text").mapInArrow(run, HELD)
    return found.groupBy("hi", "lo", "bucket", "spread", "doc").agg(F.count("*").alias("n"))


def line_counts(held: DataFrame) -> DataFrame:
    """In how many documents each line hash is found: ``hi, lo, n``."""
    single = held.filter(F.col("doc").isNull()).groupBy("hi", "lo").agg(F.sum("n").alias("n"))
    # the rows of one document count once
    repeated = held.filter(F.col("doc").isNotNull()).select("hi", "lo", "doc").distinct()
    repeated = repeated.groupBy("hi", "lo").agg(F.count("*").alias("n"))
    return single.unionByName(repeated).groupBy("hi", "lo").agg(F.sum("n").alias("n"))


def shard_of(shards: int) -> Column:
    return F.pmod(F.col("hi"), F.lit(shards)).alias("shard")


def build_index(counted: DataFrame, shards: int) -> DataFrame:
    """A row per shard: the hash, and per slot a 32-bit fingerprint and a document count."""

    def build(table: pa.Table) -> pa.Table:
        hi, lo = _words(table)
        index = MinimalHash.build(hi, lo)
        slot = index.slots(hi, lo)
        fingerprints = np.empty(len(hi), "<u4")
        fingerprints[slot] = _fingerprint(hi, lo)
        counts = np.empty(len(hi), "<u4")
        counts[slot] = np.minimum(table.column("n").to_numpy(), 2**32 - 1)
        return pa.Table.from_pydict({
            "shard": [table.column("shard")[0].as_py()], "size": [len(hi)],
            "hash": [index.to_bytes()], "fingerprints": [fingerprints.tobytes()],
            "counts": [counts.tobytes()],
        }, pa.schema([("shard", pa.int64()), ("size", pa.int64()), ("hash", pa.binary()),
                      ("fingerprints", pa.binary()), ("counts", pa.binary())]))

    return counted.select("*", shard_of(shards)).groupBy("shard").applyInArrow(build, INDEX)


def _fingerprint(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return (mix(lo, hi, 1_000) >> np.uint64(32)).astype("<u4")


def probe_index(
    requests: DataFrame, index: DataFrame, shards: int, least_docs: int, shard_rows: int
) -> DataFrame:
    """The requests whose line is found in at least ``least_docs`` documents.

    A shard of more than twice ``shard_rows`` requests holds lines of very many buckets: its
    requests are parted by bucket, and its arrays copied for each part.
    """

    def probe(asked: pa.Table, arrays: pa.Table) -> pa.Table:
        hi, lo = _words(asked)
        row = arrays.to_pylist()[0]
        slot = MinimalHash.from_bytes(row["hash"]).slots(hi, lo)
        fingerprints = np.frombuffer(row["fingerprints"], "<u4")
        counts = np.frombuffer(row["counts"], "<u4")
        hit = (slot >= 0) & (fingerprints[slot] == _fingerprint(hi, lo))
        hit &= counts[slot] >= least_docs
        return asked.select(["bucket", "hi", "lo"]).filter(pa.array(hit))

    asked = requests.select("bucket", "hi", "lo", shard_of(shards))
    sizes = asked.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * shard_rows)
    copies = F.ceil(F.col("n") / shard_rows).cast("int").alias("copies")
    hot = materialize(sizes.select("shard", copies), "hot-shards")
    asked = asked.join(hot, "shard", "left").select(
        "bucket", "hi", "lo", "shard",
        F.pmod(F.xxhash64("bucket"), F.coalesce("copies", F.lit(1))).alias("part"),
    )
    again = hot.select(F.col("shard"), F.col("copies").cast("bigint").alias("times"))
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("times", F.lit(1)) - 1))
    index = index.join(again, "shard", "left").select(*index.columns, parts.alias("part"))
    both = asked.groupBy("shard", "part").cogroup(index.groupBy("shard", "part"))
    return both.applyInArrow(probe, HASHES)


def drop_common_lines(
    docs: DataFrame, least_docs: int = 10, least_chars: int = 1,
    bucket_bytes: int = 16 << 20, shard_rows: int = 500_000,
) -> DataFrame:
    """Documents without the lines that at least ``least_docs`` documents hold.

    A text is split at line ends; a line's key is the line without the blanks
    [\\x20\\x09-\\x0D] at its ends and with A-Z lower-cased.  Keys of fewer than
    ``least_chars`` code points stay (at least 1: the empty key always does).  Rows of one
    ``doc_id`` are one document; every row without an id is one of its own.

    Returns the rows with all their columns, ``text`` being what is kept (lines joined by
    line ends), plus ``n_lines`` (before dropping), ``n_dropped`` and ``kept_sha256``;
    columns of these names are replaced.  ``n_chars``, if there is one, follows the new
    text.  A null or empty text is one empty line; an empty table gives an empty result.

    ``bucket_bytes`` of text and ``shard_rows`` requests bound what one task holds; a
    single text larger than a bucket makes a bucket of its own size.  Equal rows of more than
    a bucket's text are dealt over as many buckets as that takes.
    """
    added = ("n_lines", "n_dropped", "kept_sha256")
    plain, names = numbered(docs, added)
    text, one = f"c{names.index('text')}", f"c{names.index('doc_id')}"
    plain = plain.withColumn(text, whole_text(text))
    size = F.octet_length(text)
    total = plain.agg(F.sum(size)).head()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    row_key = F.xxhash64(one, text)
    # documents of several rows, and rows that repeat beyond a bucket: written, short lists
    ids = plain.filter(F.col(one).isNotNull()).groupBy(F.col(one).alias("id"))
    ids = ids.agg(F.count("*").alias("n")).filter("n > 1")
    ids = materialize(ids.select("id", F.xxhash64("id").alias("doc")), "repeated-ids")
    hot = plain.groupBy(row_key.alias("row_key")).agg(F.sum(size + ROW_BYTES).alias("bytes"))
    spread = F.ceil(F.col("bytes") / bucket_bytes).cast("int").alias("spread")
    hot = materialize(
        hot.filter(F.col("bytes") > max(bucket_bytes, 2 * ROW_BYTES)).select("row_key", spread), "hot-rows")
    rows = plain.withColumn("row_key", row_key).join(hot, "row_key", "left")
    rows = rows.join(ids, F.col(one) == F.col("id"), "left").drop("id")
    rows = rows.withColumns({
        "spread": F.coalesce("spread", F.lit(1)),
        "bucket": F.pmod("row_key", F.lit(buckets)),
    }).drop("row_key")

    held = materialize(
        held_lines(rows.select("bucket", "spread", "doc", F.col(text).alias("text")),
                   max(1, least_chars)), "held-lines")
    # a row that is spread may lie in any of its buckets: each of them asks
    steps = F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias("step")
    place = F.pmod(F.col("bucket") + F.col("step"), F.lit(buckets)).alias("bucket")
    requests = held.select("hi", "lo", "bucket", steps).select("hi", "lo", place).distinct()
    shards = max(1, -(-held.count() // shard_rows))
    answers = probe_index(
        requests, build_index(line_counts(held), shards), shards, least_docs, shard_rows
    )
    step = F.floor(F.rand() * F.col("spread")).cast("bigint")
    rows = rows.withColumn("bucket", F.pmod(F.col("bucket") + step, F.lit(buckets)))
    rows = rows.drop("spread", "doc")

    schema = T.StructType(
        [*plain.schema.fields,
         T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()),
         T.StructField("kept_sha256", T.StringType())]
    )

    def drop(texts: pa.Table, found: pa.Table) -> pa.Table:
        hi, lo = (found.column(c).to_numpy().astype("<i8") for c in ("hi", "lo"))
        gone = set(map(bytes, np.stack([hi, lo], 1).view("V16").ravel().tolist()))
        out, n_lines, n_dropped, digests, sizes = [], [], [], [], []
        for whole in texts.column(text).to_pylist():
            lines, keys = keys_of(whole)
            left = [x for x, k in zip(lines, keys, strict=True) if digest(k) not in gone]
            kept_bytes = b"\n".join(left)
            out.append(kept_bytes.decode())
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(left))
            digests.append(hashlib.sha256(kept_bytes).hexdigest())
            sizes.append(len(out[-1]))
        columns = {f"c{k}": texts.column(f"c{k}") for k in range(len(names))}
        columns[text] = pa.array(out, pa.string())
        if "n_chars" in names:
            c = f"c{names.index('n_chars')}"
            columns[c] = pa.array(sizes, pa.int64()).cast(columns[c].type)
        columns["n_lines"] = pa.array(n_lines, pa.int64())
        columns["n_dropped"] = pa.array(n_dropped, pa.int64())
        columns["kept_sha256"] = pa.array(digests, pa.string())
        return pa.Table.from_pydict(columns)

    cleaned = rows.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(drop, schema)
    return cleaned.toDF(*names, *added)
