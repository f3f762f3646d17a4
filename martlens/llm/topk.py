"""Exact top-k search by global score histograms.

Queries and candidates are dealt into tiles, and every pass scores all tiles anew.  A
pass counts each query's scores per bin, adds the counts of all tiles, and finds the bin
that holds the k-th highest score; the next pass cuts that bin into finer ones until a
bin is a single score.  Then scores above the k-th pass the filter, and of those equal to
it as many of the smallest ids as are still needed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlens.llm.vectors import copied, dealt, matrix, named_vectors
from martlens.sources.tables import materialize

BINS = 512
STEP = 256  # queries scored at a time
EXACT = 2**53  # doubles hold all integers up to here


def _scored(cands: pa.Table, asked: pa.Table, dim: int, most: float):
    """Runs of queries: where they begin, their ids, all scores, and where they meet themselves."""
    kind = np.float32 if most < 2**24 else np.float64
    ids = cands.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    left = matrix(cands.column("vector"), dim)[order].astype(kind)
    right = matrix(asked.column("vector"), dim).astype(kind)
    query_ids = asked.column("query_id").to_numpy()
    for at in range(0, len(right), STEP):
        own = query_ids[at : at + STEP]
        scores = (right[at : at + STEP] @ left.T).astype(np.int64)
        first, last = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
        itself = np.zeros(scores.shape, bool)
        for k in np.flatnonzero(first < last).tolist():
            itself[k, first[k] : last[k]] = True
        yield at, own, ids, scores, itself


def _counts(dim: int, most: float, k: int):
    """Counts of each query's scores per bin of its range, from the highest bin down.

    A tile's bins below its own k-th highest score cannot hold the global one.
    """
    schema = pa.schema([("query_id", pa.int64()), ("bin", pa.int64()), ("n", pa.int64())])

    def run(cands: pa.Table, asked: pa.Table) -> pa.Table:
        parts = []
        low, width = asked.column("low").to_numpy(), asked.column("width").to_numpy()
        bins = asked.column("bins").to_numpy()
        if not len(cands) or not len(asked):
            return schema.empty_table()
        for at, own, _, scores, itself in _scored(cands, asked, dim, most):
            n = len(own)
            place = (scores - low[at : at + n, None]) // width[at : at + n, None]
            inside = (place >= 0) & (place < bins[at : at + n, None]) & ~itself
            flat = (np.arange(n)[:, None] * BINS + place)[inside]
            table = np.bincount(flat, minlength=n * BINS).reshape(n, BINS)
            above = np.cumsum(table[:, ::-1], axis=1)[:, ::-1] - table  # in higher bins
            query, place = np.nonzero((table > 0) & (above < k))
            parts.append(pa.Table.from_arrays(
                [pa.array(own[query]), pa.array(place), pa.array(table[query, place])],
                schema=schema))
        return pa.concat_tables(parts)

    return run


def _kept(dim: int, most: float):
    """Scores above each query's k-th, and of those equal to it the smallest ids needed."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(cands: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(cands) or not len(asked):
            return schema.empty_table()
        low, need = asked.column("low").to_numpy(), asked.column("need").to_numpy()
        parts = []
        for at, own, ids, scores, itself in _scored(cands, asked, dim, most):
            n = len(own)
            kth = low[at : at + n, None]
            equal = (scores == kth) & ~itself
            equal &= np.cumsum(equal, axis=1) <= need[at : at + n, None]  # ids ascend
            query, cand = np.nonzero(equal | (scores > kth) & ~itself)
            parts.append(pa.Table.from_arrays(
                [pa.array(own[query]), pa.array(ids[cand]), pa.array(scores[query, cand])],
                schema=schema))
        return pa.concat_tables(parts)

    return run


def tiling(
    n: int, asked: int, tile_rows: int, tile_queries: int, tasks: int
) -> tuple[int, int]:
    """How many groups of candidates and blocks of queries there are.

    A candidate is copied once per block, a query once per group, in each pass.  Few large
    blocks keep that near the size of both tables; groups are smaller where there would
    else be fewer tiles than ``tasks``.
    """
    blocks = max(1, -(-asked // tile_queries))
    spare = min(-(-tasks // blocks), -(-n // 1_024))
    return max(1, -(-n // tile_rows), spare), blocks


def top_k(
    candidates: DataFrame, queries: DataFrame, k: int = 20,
    tile_rows: int = 16_384, tile_queries: int = 32_768,
) -> DataFrame:
    """The ``k`` candidates of highest integer inner product for each query.

    Both tables have ``vec_id`` and ``vector``, an array of doubles with whole values;
    shorter vectors count as filled up with zeros.  A query is not its own candidate.
    Returns ``query_id``, ``rank`` from 1, ``vec_id`` and ``score``, ties to the smaller
    ``vec_id``; all candidates if there are fewer than ``k``.

    Of a query id that repeats the smallest vector asks; candidates with one id are
    candidates each.  Empty tables give an empty result.  Products beyond 2**53 are an
    error.  Tiles of ``tile_rows`` by ``tile_queries`` bound what a task holds.
    """
    spark = candidates.sparkSession
    empty = "query_id bigint, rank int, vec_id bigint, score bigint"
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    facts = candidates.agg(
        F.count("*").alias("n"), F.max(norm).alias("norm"), F.max(F.size("vector")).alias("dim")
    ).head()
    asked = queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector"))
    own = asked.agg(
        F.count("*").alias("n"), F.max(norm).alias("norm"), F.max(F.size("vector")).alias("dim")
    ).head()
    if not facts["n"] or not own["n"]:
        return spark.createDataFrame([], empty)
    dim = max(facts["dim"], own["dim"])
    most = float(np.sqrt(facts["norm"]) * np.sqrt(own["norm"])) + 1  # no product is larger
    if most >= EXACT:
        raise ValueError("inner products beyond 2**53 are not exact")
    tasks = 2 * spark.sparkContext.defaultParallelism
    groups, blocks = tiling(facts["n"], own["n"], tile_rows, tile_queries, tasks)
    cands = candidates.withColumn("tile", dealt(F.col("vec_id"), groups))
    cands = copied(cands, "block", blocks).groupBy("tile", "block")

    def tiled(bounds: DataFrame):
        placed = bounds.withColumn("block", dealt(F.col("query_id"), blocks, 1).cast("int"))
        tiles = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint")))
        return placed.withColumn("tile", tiles).groupBy("tile", "block")

    reach = int(most)
    width = max(1, -(-(2 * reach + 1) // BINS))
    bounds = asked.withColumns({
        "low": F.lit(-reach).cast("bigint"), "width": F.lit(width).cast("bigint"),
        "bins": F.lit(BINS).cast("bigint"), "need": F.lit(k).cast("bigint"),
    })
    while True:
        bounds = materialize(bounds, "score-bounds")
        counts = cands.cogroup(tiled(bounds)).applyInArrow(
            _counts(dim, most, k), "query_id bigint, bin bigint, n bigint"
        )
        # from the highest bin down, the first that brings the count to what is needed
        total = counts.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        listed = total.groupBy("query_id").agg(
            F.sort_array(F.collect_list(F.struct((-F.col("bin")).alias("at"), "n"))).alias("counts")
        )
        state = F.aggregate(
            "counts",
            F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).cast("bigint").alias("at"),
                     F.lit(0).cast("bigint").alias("above")),
            lambda s, x: F.when(s["sum"] >= F.col("need"), s).otherwise(
                F.struct((s["sum"] + x["n"]).alias("sum"), (-x["at"]).alias("at"),
                         s["sum"].alias("above"))),
        )
        found = bounds.join(listed, "query_id").withColumn("state", state)
        step = max(1, -(-width // BINS))
        bounds = found.select(
            "query_id", "vector",
            (F.col("low") + F.col("state.at") * F.col("width")).alias("low"),
            F.lit(step).cast("bigint").alias("width"),
            F.lit(-(-width // step)).cast("bigint").alias("bins"),
            (F.col("need") - F.col("state.above")).alias("need"),
        )
        if width == 1:
            break
        width = step
    # a query with fewer than k candidates ends at its lowest score and takes them all
    kept = cands.cogroup(tiled(materialize(bounds, "score-bounds"))).applyInArrow(
        _kept(dim, most), "query_id bigint, vec_id bigint, score bigint"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def whole_steps(rows: DataFrame, steps: int = 64) -> DataFrame:
    """Vectors whose components x become floor(steps * x), x as double."""
    return named_vectors(rows).select(
        "vec_id",
        F.transform("vector", lambda x: F.floor(F.lit(float(steps)) * x).cast("double")).alias(
            "vector"),
    )
