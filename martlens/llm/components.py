"""Connected components of a written list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.sources.tables import materialize


def _both_ways(links: DataFrame) -> DataFrame:
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return links.select("a", "b").unionByName(turned)


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the smallest: the larger ones (large star) or the smaller ones."""
    pairs = _both_ways(links) if large else links.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = pairs.groupBy("a").agg(F.min("b").alias("low"))
    low = low.select("a", F.least("a", "low").alias("low"))
    joined = pairs.join(low, "a")
    if large:
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), "low")
    else:
        moved = joined.select(F.col("b").alias("a"), "low").unionByName(low)
    return moved.filter(F.col("a") != F.col("low")).select("a", F.col("low").alias("b")).distinct()


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """``node`` and ``root`` (its component's smallest node) of every linked node.

    ``links`` has the columns a and b of 64-bit integers; loops and repeats do no harm.
    Large and small stars take turns until nothing changes; a star's centre is summed
    before its neighbours are joined to it, and each round is written to shared storage.
    """
    now = materialize(links.filter("a != b").select("a", "b").distinct(), label)
    last = None
    while True:
        now = materialize(_star(_star(now, large=True), large=False), label)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if mark == last:
            break
        last = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
