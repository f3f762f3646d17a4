"""Documents to packed training sequences: filter, clean, deduplicate, pack.

Each stage takes what its predecessor kept, works on all of it, and keeps the columns of
documents; the last returns pieces.  A text that loses everything stays as an empty row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.llm.inputs import numbered, read, ready, whole_text
from martlens.llm.linededup import drop_common_lines
from martlens.llm.packing import pack
from martlens.llm.quality import score_quality
from martlens.llm.queries import tokenizer_file
from martlens.llm.simhash import near_duplicates
from martlens.llm.suffixdedup import NO_ID, remove_repeats
from martlens.session import delete_path, scratch_path, scratch_scope


OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on documents whose other columns cannot clash with those that it adds."""
    names = [c if c in OWN else f"extra_{i}" for i, c in enumerate(docs.columns)]
    return work(docs.toDF(*names)).select(*names).toDF(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    ready(spark)
    labels = read(spark, sf_dir, "labels")
    return _apart(docs, lambda d: score_quality(d, labels).filter(F.col("predicted") == 1))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten of them share; none is dropped as a whole."""
    ready(spark)
    return _apart(docs, lambda d: drop_common_lines(d, least_docs=10, least_chars=1))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest id.

    Rows without an id come after all others; of rows of one id the smallest hash of the
    text decides, and of rows equal in both one stays.
    """
    ready(spark)
    plain, names = numbered(docs)
    own = F.coalesce(F.col(f"c{names.index('doc_id')}").cast("bigint"), F.lit(NO_ID))
    rows = plain.withColumns(
        {"key": own, "text_hash": F.xxhash64(whole_text(f"c{names.index('text')}"))}
    )
    key = F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("key")
    found = near_duplicates(docs, shingle=3, distance=2).select("component", key, "text_hash")
    kept = found.groupBy("component").agg(F.min(F.struct("key", "text_hash")).alias("kept"))
    kept = kept.select("kept.key", "kept.text_hash").distinct()
    same = ["key", "text_hash"]
    left = rows.join(kept, same, "left_semi").dropDuplicates(same)
    return left.drop(*same).toDF(*names)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes that an earlier place has."""
    ready(spark)
    return _apart(docs, lambda d: remove_repeats(d, 100))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as training sequences; a row per piece."""
    ready(spark)
    return pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near),
    ("suffix-array dedup", repeats),
    ("best-fit packing", packing),
]

# Encoding, vectors and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each one's input and working copies go once it is written."""
    docs, given = read(ready(spark), sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name.replace(' ', '-')}")
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if given:
            delete_path(spark, given)
        docs, given = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
