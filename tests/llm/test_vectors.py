import random

import duckdb
import numpy as np
import pytest

from martlens.llm import neighbours, topk
from martlens.llm.forest import Forest
from martlens.llm.inputs import read, ready
from martlens.llm.neighbours import nearest
from martlens.llm.queries import ORACLE, QUERIES
from martlens.llm.topk import tiling, top_k, whole_steps
from martlens.llm.vectors import named_vectors

SF = "/root/testdata/sf0.01"


def brute(rows, queries, k):
    out = []
    for q, own in queries:
        found = sorted((-int(np.dot(own, v)), i) for i, v in rows if i != q)[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale, bins", [(3, 512), (3_000, 512), (3_000, 8)])
def test_top_k_against_brute_force(spark, monkeypatch, scale, bins):
    monkeypatch.setattr(topk, "BINS", bins)
    rng = random.Random(scale)
    rows = [(i, [float(rng.randint(-scale, scale)) for _ in range(5)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(100)]  # ties beyond any tile
    asked = [r for r in rows if r[0] % 20 == 0]
    frames = [spark.createDataFrame(x, "vec_id long, vector array<double>") for x in (rows, asked)]
    for k in (1, 20, 1_000):
        got = top_k(*frames, k=k, tile_rows=64, tile_queries=9).collect()
        assert sorted(tuple(r) for r in got) == brute(rows, asked, k)


def test_top_k_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(con.execute(ORACLE["op4_exact_top_k"]).fetchall())
    got = QUERIES["op4_exact_top_k"](spark, SF).select("query_id", "rank", "vec_id", "score")
    assert sorted(tuple(r) for r in got.collect()) == want


ODD = [
    (0, [1.0, 2.0]), (20, None), (40, [None, 1.0]), (60, [float("nan"), 1.0]),
    (80, [float("inf"), 0.0]), (100, []), (None, [1.0, 1.0]), (120, [1.0, 2.0]),
    (120, [1.0, 2.0]), (140, [0.5]), (160, [0.0, 0.0]), (7, [1.0, 2.0]),
]


def test_top_k_of_odd_vectors(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<double>")
    rows = whole_steps(df.selectExpr("*", "1 AS rank", "2 AS low"))
    got = top_k(rows, rows.filter("vec_id % 20 = 0"), 3).collect()
    assert {r.query_id for r in got} == {0, 120, 140, 160}
    assert [(r.rank, r.vec_id, r.score) for r in got if r.query_id == 0] == [
        (1, 7, 20_480), (2, 120, 20_480), (3, 120, 20_480)]
    assert top_k(rows.limit(0), rows, 3).count() == top_k(rows, rows.limit(0), 3).count() == 0
    alone = rows.filter("vec_id = 0")
    assert top_k(alone, alone, 3).count() == 0
    with pytest.raises(ValueError, match="2\\*\\*53"):
        big = spark.createDataFrame([(1, [1e9])], "vec_id long, vector array<double>")
        top_k(big, big)


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_of_the_forest(spark, folder):
    sf = f"/root/testdata/{folder}"
    table = named_vectors(read(ready(spark), sf, "embeddings")).collect()
    ids = np.array([r.vec_id for r in table])
    vectors = np.array([r.vector for r in table])
    got = {}
    for r in QUERIES["op5_nearest_neighbours"](spark, sf).collect():
        got.setdefault(r.query_id, []).append(r)
    asked = np.flatnonzero(ids % 20 == 0)
    assert set(got) == set(ids[asked].tolist())
    hits = 0
    for q in asked:
        scores = (vectors * vectors[q]).sum(axis=1)
        exact = dict(zip(ids.tolist(), scores.tolist(), strict=True))
        del exact[int(ids[q])]
        best = set(sorted(exact, key=lambda i: (-exact[i], i))[:20])
        rows = sorted(got[int(ids[q])], key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, 21))
        assert all(r.score == pytest.approx(exact[r.vec_id], abs=1e-12) for r in rows)
        assert all((-a.score, a.vec_id) < (-b.score, b.vec_id)
                   for a, b in zip(rows, rows[1:], strict=False))
        hits += len(best & {r.vec_id for r in rows})
    assert hits >= 0.9 * 20 * len(asked)


def test_neighbours_of_odd_and_equal_vectors(spark):
    rng = random.Random(1)
    rows = ODD + [(1000 + i, [3.0, 1.0]) for i in range(60)]
    rows += [(2000 + i, [rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(200)]
    df = named_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = nearest(df, df.filter("vec_id % 20 = 0"), 5, opened=1.0, shard_rows=100,
                  block_queries=7, sample_rows=128, leaf_rows=16).collect()
    usable = [(r.vec_id, np.array(r.vector + [0.0] * (2 - len(r.vector)))) for r in df.collect()]
    usable = [(i, v) for i, v in usable if v.any()]
    for q, own in {i: v for i, v in usable if i % 20 == 0}.items():
        want = sorted((-(own * v).sum(), i) for i, v in usable if i != q)[:5]
        found = sorted((r.rank, r.vec_id) for r in got if r.query_id == q)
        assert [i for _, i in found] == [i for _, i in want]
    assert 160 not in {r.query_id for r in got}
    assert nearest(df.limit(0), df).count() == nearest(df, df.limit(0)).count() == 0
    one = df.filter("vec_id = 0")
    assert nearest(one, one).count() == 0


def test_every_vector_has_one_leaf_per_tree():
    rng = np.random.default_rng(0)
    rows = rng.standard_normal((500, 6))
    forest = Forest.fit(rows, 3, 16)
    leaves = forest.place(rows)
    assert leaves.shape == (3, 500) and leaves.min() >= 0 and leaves.max() < forest.leaves
    opened = forest.search(rows[0], 3 * forest.leaves)
    assert len(set(opened)) == 3 * forest.leaves
    assert {(t, int(leaves[t, 0])) for t in range(3)} <= set(opened[:3])


@pytest.mark.parametrize("pairs", [1 << 20, 100])
def test_neighbours_closer_than_single_precision(spark, monkeypatch, pairs):
    monkeypatch.setattr(neighbours, "PAIRS", pairs)
    rng = np.random.default_rng(2)
    base = rng.normal(size=16) * 1e3
    cluster = base + rng.normal(size=(300, 16)) * 1e-9
    tied = np.tile(base * 0.5, (200, 1))  # equal products of different vectors
    asked = np.append(base[:15], 0.0)
    tied[:, 15] = np.arange(200)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([cluster, tied]))]
    queries = [(1_000, base.tolist()), (1_001, (-asked).tolist())]
    frames = [spark.createDataFrame(x, "vec_id long, vector array<double>") for x in (rows, queries)]
    got = {}
    for r in neighbours.nearest(*frames, k=20, opened=1.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    matrix = np.array([v for _, v in rows])
    for one, vector in queries:
        scores = (np.array(vector) * matrix).sum(axis=1)
        want = np.lexsort((np.arange(len(rows)), -scores))[:20]
        assert sorted(got[one]) == list(enumerate(want.tolist(), 1))


def test_candidates_are_copied_once_per_large_block():
    # candidates are not copied until there are more queries than a block holds
    for n in (1, 10_000, 600_000):
        groups, blocks = tiling(n, -(-n // 20), 16_384, 32_768, 16)
        assert blocks == 1 and (groups - 1) * 1_024 < n and groups * 16_384 >= n
    assert tiling(600_000, 30_000, 16_384, 32_768, 16)[0] == 37
    groups, blocks = tiling(6_400_000, 320_000, 16_384, 32_768, 16)
    assert (groups, blocks) == (391, 10)
    assert tiling(0, 0, 16_384, 32_768, 16) == (1, 1)
