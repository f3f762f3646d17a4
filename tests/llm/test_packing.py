import zlib

import numpy as np
import public_tokenizers
import pytest

from martlens.llm.inputs import read, ready
from martlens.llm.packing import pack, placing_order, sum_of_squares
from martlens.llm.queries import QUERIES
from martlens.llm.wordtokens import library

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def check(docs, packed, size):
    model = library(WORDS)
    want = []
    for doc_id, text in docs:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), size)):
            part = ids[at : at + size]
            want.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
    pieces = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed]
    assert sorted(pieces, key=repr) == sorted(want, key=repr)
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences), -(-sum(p[3] for p in want) // size)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in read(ready(spark), SF, "documents").collect()]
    used, least = check(docs, QUERIES["op9_best_fit_packing"](spark, SF).collect(), 2048)
    assert used <= 1.05 * least + 1


@pytest.mark.parametrize("group", [3, 30_000])
def test_nulls_repeats_and_long_texts(spark, group):
    docs = [(1, None), (1, None), (None, ""), (2, "a b c d e f g h i j"), (2, "a b c d e f g"),
            (3, "x " * 700)] + [(i, "w " * (i % 13)) for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS piece")
    used, least = check(docs, pack(df, WORDS, 8, group_rows=group).collect(), 8)
    assert least <= used <= 2 * least
    assert pack(df.limit(0), WORDS).count() == 0


def brute_places(lengths, size):
    """Tries every open gap and a new bin, by the sum of squares itself."""
    gaps = []
    for n in lengths:
        def score(left):
            count = np.bincount([g for g in left if g], minlength=1)
            return int((count**2).sum())

        options = []
        for gap in sorted(set(g for g in gaps if g >= n)):
            left = list(gaps)
            left[left.index(gap)] -= n
            options.append((score(left), gap, left))
        options.append((score([*gaps, size - n]), size, [*gaps, size - n]))
        gaps = min(options, key=lambda o: o[:2])[2]
    return sorted(gaps)


def test_places_have_the_smallest_sum_of_squares():
    rng = np.random.default_rng(4)
    for _ in range(60):
        size = int(rng.integers(3, 20))
        lengths = rng.integers(1, size + 1, rng.integers(1, 30))
        bins, offsets = sum_of_squares(lengths, size)
        used = np.bincount(bins, weights=lengths)
        assert used.max() <= size
        assert sorted((size - used).astype(int).tolist()) == brute_places(lengths.tolist(), size)
        order = np.lexsort((offsets, bins))
        for b in range(bins.max() + 1):
            own = order[bins[order] == b]
            assert offsets[own].tolist() == [0, *np.cumsum(lengths[own])[:-1].tolist()]


def test_a_full_group_wastes_next_to_nothing():
    rng = np.random.default_rng(9)
    lengths = np.minimum(rng.lognormal(5.8, 1.1, 30_000).astype(np.int64) + 1, 2047)
    order = placing_order(lengths, rng.permutation(len(lengths)))
    assert sorted(order.tolist()) == list(range(len(lengths)))
    bins, _ = sum_of_squares(lengths[order], 2048)
    assert bins.max() + 1 <= 1.001 * lengths.sum() / 2048
    longest_first = sum_of_squares(np.sort(lengths)[::-1], 2048)[0]
    assert bins.max() < longest_first.max()


def test_placing_order_of_few_pieces():
    for n in range(12):
        lengths = np.arange(n) % 4 + 1
        order = placing_order(lengths, np.arange(n) << 40)
        assert sorted(order.tolist()) == list(range(n))
        head = lengths[order[: n - n // 5]].tolist()
        assert head == sorted(head, reverse=True)
