import zlib

import numpy as np
import pytest

from martlens.llm.inputs import read, ready
from martlens.llm.quality import LatentSpace, score_quality, terms, vote
from martlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = QUERIES["op8_quality_classifier"](spark, SF).collect()
    label = {r.doc_id: r.quality for r in read(ready(spark), SF, "labels").collect()}
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(r.predicted, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.95
    assert all(a == 1 for a, b in held if b == 1)


def test_held_out_labels_change_nothing(spark):
    docs = read(ready(spark), "/root/testdata/sf0.001", "documents")
    labels = read(spark, "/root/testdata/sf0.001", "labels")
    turned = labels.selectExpr(
        "doc_id", "if(crc32(CAST(string(doc_id) AS BINARY)) % 5 = 0, 1 - quality, quality) AS quality"
    )
    scores = [{r.doc_id: r.score for r in score_quality(docs, x).collect()}
              for x in (labels, turned)]
    assert scores[0] == pytest.approx(scores[1], abs=1e-6)


def test_nulls_repeats_no_labels_and_clashing_names(spark):
    good, bad = "a quiet sentence with many words in it. ", "$$$ ### $$$ ### "
    rows = [(i, (good if i % 2 else bad) * (1 + i % 3)) for i in range(1, 40)]
    rows += [(None, good), (1, good), (1, None), (100, ""), (101, "x"), (102, bad * 5_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "'s' AS score", "2 AS label", "3 AS c0")
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(1, 40)] + [(2, None), (3, 1), (None, 1), (999, 0)],
        "doc_id long, quality int",
    )
    got = score_quality(docs, labels)
    assert got.columns == ["doc_id", "text", "label", "c0", "held_out", "score", "predicted"]
    found = got.collect()
    assert len(found) == len(rows) and all(r.label == 2 and r.c0 == 3 for r in found)
    assert next(r for r in found if r.doc_id is None).held_out
    assert [r.score for r in found if r.doc_id == 100] == [0.0]
    assert [r.predicted for r in found if r.doc_id == 102] == [0]
    assert {r.score for r in score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert score_quality(docs.limit(0), labels).count() == 0


def test_votes_against_brute_force():
    rng = np.random.default_rng(0)
    space = LatentSpace.fit(rng.random((50, 40)).astype(np.float32), 8)
    vectors = space.vectors(rng.random((30, 40)).astype(np.float32))
    voters = space.vectors(rng.random((60, 40)).astype(np.float32))
    labels = rng.integers(0, 2, 60).astype(float)
    got = vote(vectors, voters, labels, 7, block=11)
    for own, score in zip(vectors, got, strict=True):
        cosine = voters @ own
        near = np.argsort(-cosine)[:8]
        weight = cosine[near] - cosine[near].min() + 1e-6
        assert score == pytest.approx((weight * labels[near]).sum() / weight.sum(), abs=1e-4)


def test_terms_use_the_whole_text():
    text = "plain words go on. " * 4_000
    assert not np.allclose(terms(text), terms(text + "$$$%%%" * 50))
    assert not terms("").any() and not terms("ab").any()
