"""Token counts with a cache keyed by content and tokenizer digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.llm.bpe import slices
from martlens.llm.inputs import whole_text
from martlens.llm.wordtokens import version, word_ids
from martlens.sources.tables import materialize

CACHE = "content binary, tokenizer string, n_tokens bigint"
NORMAL = "normal-1"  # changes when the digested form of a text does


def content_digest(text: Column, path: str) -> Column:
    """SHA-256 of what the tokenizer's own normaliser makes of the text; null is empty.

    Texts that differ in case, in runs of white space or in how marks are composed have the
    same ids and the same digest.
    """

    @F.pandas_udf("binary")
    def digest(texts: pd.Series) -> pd.Series:
        model = word_ids(path)
        return pd.Series([hashlib.sha256(model.content(t)).digest() for t in texts])

    return digest(F.coalesce(text, F.lit("")))


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache at ``path``, made if there is none; a digest met twice counts once."""
    spark.createDataFrame([], CACHE).write.mode("ignore").parquet(path)
    rows = spark.read.schema(CACHE).parquet(path)
    return rows.groupBy("content", "tokenizer").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame, path: str, cache_path: str, limit: int = 2048
) -> DataFrame:
    """Tokens of every whole text under the tokenizer file ``path``.

    Digests of the normalised content are joined to the counts stored at ``cache_path`` (a
    folder all executors share) for this version of the tokenizer and its normalisation;
    of the digests not found there one text each is encoded and its count appended.  Where
    all are found no text is encoded.  A job that failed half way leaves no part of its
    rows; one that is repeated finds what an earlier one stored.

    Null texts count as empty (0 tokens).  Null and repeated ids keep a row each; other
    columns are left behind; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    known = f"{version(path)}-{NORMAL}"
    rows = materialize(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.octet_length(whole_text()).cast("bigint").alias("n_bytes"),
            content_digest(F.col("text"), path).alias("content"),
        ),
        "token-rows",
    )

    def stored() -> DataFrame:
        counts = open_cache(spark, cache_path).filter(F.col("tokenizer") == known)
        return counts.select("content", "n_tokens")

    misses = rows.select("content").distinct().join(stored(), "content", "left_anti")
    misses = materialize(misses, "token-misses")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_ids(path)
        for batch in batches:
            for small in slices(batch, "text"):
                ids = model.run(small.column("text").to_pylist())
                yield pa.RecordBatch.from_pydict({
                    "content": small.column("content"),
                    "tokenizer": pa.array([known] * len(ids), pa.string()),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                })

    if not misses.isEmpty():
        texts = docs.select(
            content_digest(F.col("text"), path).alias("content"), whole_text().alias("text")
        )
        # copies fall together in the map tasks, before anything is joined
        once = texts.dropDuplicates(["content"]).join(misses, "content", "left_semi")
        once.mapInArrow(run, CACHE).write.mode("append").parquet(cache_path)
    return rows.join(stored(), "content").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
