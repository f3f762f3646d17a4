"""Approximate nearest neighbours by a forest of random-projection trees.

The forest is fitted on a bounded sample and sent to all tasks: its size depends on the
sample and the number of trees alone.  Every distinct vector is placed in one leaf per
tree.  A query opens leaves of all trees from one priority queue, once, and goes to the
shards that hold them; a shard is a run of leaves of one tree, so no member is twice in
it.  There the members of the opened leaves are scored in single precision, and all that
rounding may have kept from the best are scored again in double precision.  Equal vectors are
one member with its k + 1 smallest ids, which is all that a result can hold of them.

Many trees with few leaves opened in each find more than few trees opened wide.  On vectors
without structure, where no index helps much, 12 trees of which 8 percent are opened score
0.96 pairs per candidate and query and find 0.93 to 0.97 of the nearest; 6 trees of which a
quarter is opened scored 1.5 pairs, more than an exhaustive search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlens.llm.forest import Forest
from martlens.llm.vectors import copied, dealt, matrix
from martlens.sources.tables import materialize

MEMBERS = "shard bigint, leaf bigint, member bigint, vector array<double>, ids array<bigint>"
VISITS = "shard bigint, query_id bigint, vector array<double>, leaves array<bigint>"
FOUND = "query_id bigint, score double, member bigint, ids array<bigint>"
PAIRS = 1 << 20  # pairs of a query and a member that wait for their exact score
TILE = 1 << 22  # single-precision scores at a time


def _lifted(vectors: np.ndarray, top: float) -> np.ndarray:
    """One more component brings all candidates to length ``top``: the largest product is
    then the smallest angle."""
    rest = np.maximum(top * top - np.einsum("ij,ij->i", vectors, vectors), 0)
    return np.column_stack([vectors, np.sqrt(rest)])


def _small(vectors: np.ndarray, axis: int | None = None) -> np.ndarray:
    """Single precision, brought to lengths of at most 1: all rows alike, or each row."""
    sizes = np.abs(vectors).max(
        axis=axis, keepdims=True, initial=0, where=np.isfinite(vectors))
    sizes = np.where(sizes > 0, sizes, 1)
    return (vectors / sizes / np.sqrt(vectors.shape[1])).astype(np.float32)


def _lists(rows: list[np.ndarray] | np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(list(rows), pa.list_(kind))


def nearest(
    candidates: DataFrame, queries: DataFrame, k: int = 20, trees: int = 12,
    leaf_rows: int = 64, sample_rows: int = 16_384, opened: float = 0.08,
    shard_rows: int = 32_768, block_queries: int = 16_384,
) -> DataFrame:
    """The ``k`` nearest found candidates of each query by inner product.

    Both tables have ``vec_id`` and ``vector`` (doubles); zero vectors take no part and
    shorter ones count as filled up with zeros.  Returns ``query_id``, ``rank`` from 1,
    ``vec_id`` and ``score``, the inner product in double precision, ties to the smaller
    ``vec_id``.  A query is never its own candidate.

    The trees are fitted on at most ``sample_rows`` rows, chosen by the hash of their id,
    down to leaves of about ``leaf_rows`` of them; a query opens the part ``opened`` of
    all leaves, and no fewer than hold 200 k rows of the sample.  Every row is indexed.  With at most k candidates all are returned.

    Of a query id that repeats the smallest vector asks.  Empty tables give an empty
    result.  A task holds ``shard_rows`` members and ``block_queries`` queries.
    """
    spark = candidates.sparkSession
    out = "query_id bigint, rank int, vec_id bigint, score double"
    some = F.exists("vector", lambda x: x != 0)
    nearby = Window.partitionBy("vector").orderBy("vec_id")
    members = (
        candidates.filter(some).withColumn("at", F.row_number().over(nearby))
        .filter(F.col("at") <= k + 1).groupBy("vector")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    members = materialize(members.withColumn("member", F.col("ids")[0]), "members")
    asked = queries.filter(some).groupBy(F.col("vec_id").alias("query_id")).agg(
        F.min("vector").alias("vector"))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    facts = members.agg(F.count("*").alias("n"), F.max(norm).alias("norm"),
                        F.max(F.size("vector")).alias("dim")).head()
    own = asked.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).head()
    if not facts["n"] or not own["n"]:
        return spark.createDataFrame([], out)
    dim, top = max(facts["dim"], own["dim"]), float(np.sqrt(facts["norm"]))

    sample = members.orderBy(F.xxhash64("member"), "member").limit(sample_rows)
    sample = matrix(sample.select("vector").toArrow().column("vector"), dim)
    forest = Forest.fit(_lifted(sample, top), trees, leaf_rows)
    sent = spark.sparkContext.broadcast((forest.directions, forest.cuts))
    # small tables: as many leaves as hold 200 k members
    budget = max(trees, int(np.ceil(opened * trees * forest.leaves)), -(-200 * k // leaf_rows))
    forest_leaves = forest.leaves
    runs = min(forest.leaves, -(-facts["n"] // shard_rows))  # of leaves per tree
    splits = -(-facts["n"] // (runs * shard_rows))  # of members, where leaves are large
    blocks = max(1, -(-own["n"] // block_queries))

    def shard_of(tree, leaf):
        return tree * runs + leaf * runs // forest_leaves

    def place(batches):
        model = Forest(*sent.value)
        for batch in batches:
            if not len(batch):
                continue
            vectors = batch.column("vector")
            leaves = model.place(_lifted(matrix(vectors, dim), top))
            for t in range(model.trees):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard_of(t, leaves[t])), pa.array(leaves[t]),
                     batch.column("member"), vectors, batch.column("ids")],
                    names=["shard", "leaf", "member", "vector", "ids"],
                )

    def visit(batches):
        model = Forest(*sent.value)
        for batch in batches:
            at, shards, opened_leaves = [], [], []
            for k, vector in enumerate(matrix(batch.column("vector"), dim)):
                by_shard: dict[int, list[int]] = {}
                for t, leaf in model.search(np.append(vector, 0.0), budget):
                    by_shard.setdefault(shard_of(t, leaf), []).append(leaf)
                at += [k] * len(by_shard)
                shards += by_shard.keys()
                opened_leaves += by_shard.values()
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards, pa.int64()), batch.column("query_id").take(at),
                 batch.column("vector").take(at),
                 pa.array(opened_leaves, pa.list_(pa.int64()))],
                names=["shard", "query_id", "vector", "leaves"],
            )

    def score(table: pa.Table, visitors: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("score", pa.float64()),
                            ("member", pa.int64()), ("ids", pa.list_(pa.int64()))])
        if not len(table) or not len(visitors):
            return schema.empty_table()
        left, right = matrix(table.column("vector"), dim), matrix(visitors.column("vector"), dim)
        member, leaf = table.column("member").to_numpy(), table.column("leaf").to_numpy()
        order = np.lexsort((member, leaf))
        left, member, leaf = left[order], member[order], leaf[order]
        small, asked_small = _small(left), _small(right, 1)
        odd = not (np.isfinite(small).all() and np.isfinite(asked_small).all())
        by_leaf: dict[int, list[int]] = {}
        for q, leaves in enumerate(visitors.column("leaves").to_pylist()):
            for x in leaves:
                by_leaf.setdefault(x, []).append(q)
        most = k + 1  # the query itself may be among them
        # rows of length 1 at most: a product is off by less than half of this
        slack = np.float32((dim + 8) * 2.0**-22)
        best = np.full((len(right), most), -np.inf, np.float32)
        q, m, exact = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def settle():
            """The ``most`` best by exact score, ties to the smaller member, of those so far."""
            least = best.min(axis=1) - slack
            new_q, new_m, single = (np.concatenate(x) for x in zip(*waiting, strict=True))
            stay = single >= least[new_q]
            new_q, new_m = new_q[stay], new_m[stay]
            new = np.empty(len(new_q))
            for a in range(0, len(new_q), 1 << 16):
                run = slice(a, a + (1 << 16))
                new[run] = (right[new_q[run]] * left[new_m[run]]).sum(axis=1)
            all_q, all_m = np.append(q, new_q), np.append(m, new_m)
            scores = np.append(exact, new)
            by = np.lexsort((member[all_m], -scores, all_q))
            first = np.searchsorted(all_q[by], all_q[by])
            by = by[np.arange(len(by)) - first < most]
            return all_q[by], all_m[by], scores[by]

        starts = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(leaf)], strict=True):
            everyone = np.array(by_leaf.get(int(leaf[a]), ()), np.int64)
            step = max(1, TILE // (b - a))
            for at in range(0, len(everyone), step):
                asking = everyone[at : at + step]
                scores = asked_small[asking] @ small[a:b].T
                if odd:
                    scores[np.isnan(scores)] = -np.inf
                both = np.concatenate([best[asking], scores], axis=1)
                highest = np.partition(both, both.shape[1] - most, axis=1)[:, -most:]
                best[asking] = highest
                near, row = np.nonzero(scores >= highest[:, :1] - slack)
                waiting.append((asking[near], row + a, scores[near, row]))
                count += len(near)
                if count > PAIRS:
                    q, m, exact = settle()
                    waiting, count = [], 0
        if waiting:
            q, m, exact = settle()
        query_ids = visitors.column("query_id").to_numpy()
        ids = table.column("ids").combine_chunks().take(pa.array(order[m]))
        return pa.Table.from_arrays(
            [pa.array(query_ids[q]), pa.array(exact), pa.array(member[m]), ids], schema=schema
        )

    def split(rows: DataFrame, by: Column) -> DataFrame:
        return rows.withColumn("shard", F.col("shard") * splits + by)

    placed = members.select("member", "vector", "ids").mapInArrow(place, MEMBERS)
    placed = split(placed, dealt(F.col("member"), splits))
    index = copied(placed, "block", blocks).groupBy("shard", "block")
    visits = asked.select("query_id", "vector").mapInArrow(visit, VISITS)
    visits = split(copied(visits, "part", splits), F.col("part")).drop("part")
    visits = visits.withColumn("block", dealt(F.col("query_id"), blocks, 1).cast("int"))
    found = index.cogroup(visits.groupBy("shard", "block")).applyInArrow(score, FOUND)
    # a member is in a leaf of every tree
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "member")
    once = found.dropDuplicates(["query_id", "member"])
    flat = once.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k + 1)
    flat = flat.select("query_id", "score", F.explode("ids").alias("vec_id"))
    flat = flat.filter(F.col("query_id") != F.col("vec_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return flat.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
