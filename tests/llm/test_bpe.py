import hashlib
import random

import public_tokenizers
import pytest

from martlens.llm.bpe import ByteCodec, encode_decode
from martlens.llm.inputs import read, ready
from martlens.llm.queries import QUERIES
from martlens.llm.wordtokens import WordIds, library, version

SF = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PARTS = [*"ab cZ'st\n\t \r\x0b\x1c\x85\xa0 　é́ßİΣÀÿªµ×÷漢字12½²٣!?.😀‍", "<|endoftext|>",
         "<|startoftext|>", "  ", "'ll", "'S", " \n", "\n ", "aaa", "…", " the", "ing "]


def odd_texts(n=4_000, seed=1):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(n)]
    return [*texts, "", " ", "\n", "a" * 5_000, "ab" * 20_000, "x" + " " * 100, "é" * 999]


def test_byte_codec_is_the_library():
    model, texts = library(BYTES), odd_texts()
    codec = ByteCodec(BYTES, 200)  # a bound that is soon full
    for text, (ids, decoded) in zip(texts, codec.run(texts), strict=True):
        want = model.encode(text, add_special_tokens=False).ids
        assert ids.decode() == ",".join(map(str, want)), text[:80]
        assert decoded.decode() == model.decode(want, skip_special_tokens=False)


def test_word_ids_are_the_library():
    model, texts = WordIds(WORDS, 200), odd_texts(seed=2)
    for _ in range(2):
        found = model.run(texts)
        wanted = model.library.encode_batch(texts, add_special_tokens=False)
        for text, ids, want in zip(texts, found, wanted, strict=True):
            assert memoryview(ids).cast("I").tolist() == want.ids, text[:80]


def test_query_against_the_library(spark):
    model = library(BYTES)
    want = []
    for r in read(ready(spark), SF, "documents").collect():
        ids = model.encode(r.text or "", add_special_tokens=False).ids
        texts = ",".join(map(str, ids)), model.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), *[hashlib.sha256(x.encode()).hexdigest() for x in texts]))
    got = QUERIES["op10_bpe_round_trip"](spark, SF).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_nulls_repeats_and_clashing_names(spark):
    df = spark.createDataFrame(
        [(1, None, 5), (1, "", 5), (None, "a <|endoftext|>b", 6), (2, "x y", 7), (2, "x y", 7)],
        "doc_id long, text string, ids int",
    )
    got = encode_decode(df, BYTES).collect()
    assert sorted((r.n_tokens, r.ids, r.decoded) for r in got)[:2] == [(0, "", "")] * 2
    special = next(r for r in got if r.doc_id is None)
    assert "50256" in special.ids.split(",") and special.decoded == "a <|endoftext|>b"
    assert sum(r.doc_id == 2 for r in got) == 2
    assert encode_decode(df.limit(0), BYTES).count() == 0


def test_versions_differ():
    assert version(BYTES) != version(WORDS) and version(WORDS) == version(WORDS)


def test_other_vocabularies_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        WordIds(BYTES, 10)


def test_worker_keeps_no_long_chunks():
    rng = random.Random(4)
    texts = ["".join(rng.choices("ACGT漢字", k=20_000)) for _ in range(10)] + ["a word or two"]
    codec, model = ByteCodec(BYTES, 250_000), WordIds(WORDS, 250_000)
    list(codec.run(texts))
    model.run(texts)
    for store, most in ((codec.store.kept, 4), (model.store.kept, 4)):
        assert 0 < len(store) <= most and max(map(len, store)) <= 64
