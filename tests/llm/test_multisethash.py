import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from martlens.llm.inputs import read, ready
from martlens.llm.multisethash import (
    WIDTH,
    change_fingerprints,
    compare_with_next,
    fingerprint_documents,
    from_hex,
    likeness,
    paragraphs,
    sums,
)
from martlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def one(text):
    return sums([paragraphs(text)]).hex()[0]


def brute(rows):
    """doc_id, n_chars, edited text, next text; rows of one id by their text only if equal."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (doc, text) in enumerate(order):
        text, other = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        out.append((doc, len(text), text[: len(text) - half] + other[:half], other))
    return out


def cosine(a, b):
    """Of the counts of 16-byte runs, exactly."""
    x, y = (Counter(p[i : i + 16] for p in paragraphs(t) for i in range(max(1, len(p) - 15)) if p)
            for t in (a, b))
    size = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
    return sum(v * y[k] for k, v in x.items()) / size if size else 0.0


def check(got, rows, texts):
    want = sorted(brute(rows), key=repr)
    assert [(g[0], g[1], g[2]) for g in got] == [
        (d, n, hashlib.sha256(e.encode()).hexdigest()) for d, n, e, _ in want
    ]
    errors = []
    for (doc, _, _, own, edited, near_edited, near_next), (_, _, text, other) in zip(
        got, want, strict=True
    ):
        assert len(own) == 2 * WIDTH and edited == one(text)
        whole = texts[doc]
        assert own == one(whole)
        for near, exact in ((near_edited, cosine(whole, text)), (near_next, cosine(whole, other))):
            assert 0 <= near <= 1
            errors.append(abs(near - exact) if near < 1 else 0.0)
    # an estimate: of short texts two runs may meet in one lane
    assert np.mean(errors) < 0.06 and np.quantile(errors, 0.98) < 0.3


def result(df):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
             "near_edited", "near_next"]
    return sorted((tuple(r) for r in df.select(names).collect()), key=repr)


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in read(ready(spark), SF, "documents").select("doc_id", "text").collect()]
    got = result(QUERIES["op13_document_fingerprints"](spark, SF))
    check(got, rows, {d: t or "" for d, t in rows})
    long = {d for d, t in rows if t and len(t) > 500}
    apart = [g for g in got if g[0] in long and g[6] < 0.5]
    assert sum(g[5] > g[6] for g in apart) > 0.95 * len(apart) > 50
    exact = {d: (e, o) for d, _, e, o in brute(rows)}
    texts = dict(rows)
    errors = [abs(g[5] - cosine(texts[g[0]], exact[g[0]][0])) for g in got if g[0] in long]
    assert np.mean(errors) < 0.06


@pytest.mark.parametrize("part_bytes", [1, 200, 1 << 20])
def test_next_over_borders(spark, part_bytes):
    ready(spark)
    rng = random.Random(3)
    rows = [(i * 3, "\n".join("é" * rng.randint(0, 9) + str(i) for _ in range(rng.randint(1, 6))))
            for i in range(200)]
    rows += [(601, None), (602, ""), (None, "no id\nx"), (-5, "x" * 70_000), (-6, "\n\n\n")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    named = df.selectExpr("1 AS place", "doc_id", "text", "2 AS hash", "3 AS edited", "4 AS serial")
    got = compare_with_next(named.repartition(5), part_bytes=part_bytes)
    check(result(got), rows, {d: t or "" for d, t in rows})
    assert {r.edited for r in got.collect()} == {e for _, _, e, _ in brute(rows)}


def test_odd_tables(spark):
    ready(spark)
    df = spark.createDataFrame([(1, "ab\ncd")], "doc_id long, text string")
    (alone,) = compare_with_next(df).collect()
    assert (alone.edited, alone.near_next) == ("ab\nab", 1.0)
    assert compare_with_next(df.limit(0)).count() == 0
    # equal rows, more than a range holds, follow one another
    same = spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.lit("abc").alias("text"))
    rows = compare_with_next(same, texts=False, part_bytes=100).collect()
    assert len(rows) == 500 and {r.near_next for r in rows} == {1.0}
    assert len({r.fingerprint for r in rows}) == 1


def test_one_shuffle_of_texts(spark):
    ready(spark)
    got = compare_with_next(read(spark, SF, "documents").repartition(3), texts=False)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Exchange rangepartitioning") - final.count("ReusedExchange") == 1


def test_order_insertion_and_deletion(spark):
    ready(spark)
    assert one("a\nb\nb") == one("b\na\nb") != one("a\nb")
    assert one("a\n\nb") != one("a\nb") and one("") != one("\n")
    df = spark.createDataFrame(
        [(1, "a\nlong paragraph of words\nb", ["a", "b"], ["c"]), (2, "x", None, ["x", "y"]),
         (3, "", [""], [])],
        "doc_id long, text string, removed array<string>, added array<string>",
    )
    first = fingerprint_documents(df.withColumn("fingerprint", F.lit(7)))
    assert first.columns == ["doc_id", "text", "removed", "added", "fingerprint"]
    got = {r.doc_id: r.fingerprint for r in change_fingerprints(first).collect()}
    assert got[1] == one("c\nlong paragraph of words")
    assert got[2] == one("y\nx\nx")
    assert got[3] == "0" * (2 * WIDTH)
    none = change_fingerprints(first.withColumn("fingerprint", F.lit(None).cast("string")))
    back = sums([[b""], [b"a", b"b", b"c"]])
    assert {r.doc_id: r.fingerprint for r in none.collect()}[2] == sums([[b"x", b"y"]]).hex()[0]
    assert from_hex(back.hex()).hex() == back.hex()
    assert fingerprint_documents(df.select("doc_id", "text").limit(0)).count() == 0


def test_likeness_of_the_same_runs():
    a, b = sums([paragraphs("x" * 50), []]), sums([paragraphs("y" * 50), []])
    assert likeness(a, a).tolist() == [1.0, 1.0] and likeness(a, b)[0] <= 1
    assert likeness(sums([[b""]]), sums([[b"", b""]])).tolist() == [0.0]
