import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from martlens.llm import simhash
from martlens.llm.components import components
from martlens.llm.inputs import read, ready
from martlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints, distance=2):
    """Fingerprint and smallest linked id of each id."""
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    near = [np.flatnonzero(np.bitwise_count(values ^ v) <= distance) for v in values]
    label, changed = np.arange(len(ids)), True
    while changed:
        changed = False
        for own in near:
            low = label[own].min()
            if (label[own] != low).any():
                label[own], changed = low, True
    return {i: (f"{prints[i]:016x}", ids[k]) for i, k in zip(ids, label, strict=True)}


def planted(seed=3):
    rng, out = random.Random(seed), {}

    def near(value, most):
        for _ in range(rng.randrange(most)):
            value ^= 1 << rng.randrange(64)
        return value

    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 3, 8])):
            out[len(out)] = near(base, 4)
    base = rng.getrandbits(64)
    for _ in range(400):
        out[len(out)] = near(base, 6)
    return out


@pytest.mark.parametrize("hot, dense, few", [(100_000, 3_000, 24), (100_000, 30, 4), (50, 30, 24)])
def test_links_of_planted_fingerprints(spark, monkeypatch, hot, dense, few):
    prints = planted()
    monkeypatch.setattr(simhash._group_links, "__defaults__", (dense,))
    monkeypatch.setattr(simhash._bucket_links, "__defaults__", (few,))
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle: docs)
    df = spark.createDataFrame(
        [(i, simhash._signed(v), 0) for i, v in prints.items()],
        "doc_id long, fp long, text_hash long",
    )
    rows = simhash.near_duplicates(df, hot_rows=hot).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == brute_classes(prints)


def test_query_against_brute_force(spark):
    docs = read(ready(spark), SF, "documents").collect()
    rows = QUERIES["op3_simhash_near_dedup"](spark, SF).collect()
    want = brute_classes({r.doc_id: brute_print(r.text) for r in docs})
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == want


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4])
def test_a_shared_variant_for_every_near_pair(distance):
    rng, masks = random.Random(distance), simhash.variant_masks(distance)
    for _ in range(200):
        a = b = rng.getrandbits(64)
        for bit in rng.sample(range(64), distance):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def test_nulls_blanks_and_repeats(spark):
    rows = [(3, None), (1, ""), (2, " \t\n"), (8, "Aa BB"), (8, "aa bb"), (None, "aa\nbb"),
            (None, "one two three four"), (None, "one two three four")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1))
    got = simhash.near_duplicates(df).collect()
    assert len(got) == 8
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert sorted(r.doc_id for r in zero) == [1, 2, 3] and {r.component_id for r in zero} == {1}
    assert sum(r.component_id == 8 for r in got) == 3
    assert sum(r.component_id is None for r in got) == 2
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_hashes_are_those_of_the_engine(spark):
    text = "word1 word2 word3"
    want = spark.sql(f"SELECT xxhash64('{text}') AS h").first()["h"] % 2**64
    assert simhash.text_hashes(text, 3) == [want]


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(7, 7)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    roots = {r.node: r.root for r in got}
    assert all(roots[i] == 0 for i in range(1, 301))
    assert all(roots[1000 + i] == 1000 for i in range(1, 200))


def test_a_text_longer_than_a_block():
    rng = random.Random(6)
    long = " ".join(f"w{rng.randrange(5_000)}" for _ in range(simhash.BLOCK + 70))
    texts = ["", long, "one two", "a b c d e", long + " more"]
    hashes = [simhash.text_hashes(t, 3) for t in texts]
    sizes = np.array([len(h) for h in hashes])
    assert sizes.tolist() == [0, simhash.BLOCK + 68, 1, 3, simhash.BLOCK + 69]
    got = simhash.majority(np.concatenate(hashes), sizes).tolist()
    assert got == [brute_print(t) for t in texts]
