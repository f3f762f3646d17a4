import public_tokenizers

from martlens.llm import tokencounts
from martlens.llm.inputs import read, ready
from martlens.llm.queries import QUERIES
from martlens.llm.tokencounts import CACHE, count_tokens
from martlens.llm.wordtokens import WordIds, library
from martlens.session import scratch_path

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_against_the_library(spark):
    model = library(WORDS)
    want = []
    for r in read(ready(spark), SF, "documents").collect():
        n = len(model.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 2048))
    assert rows(QUERIES["op2_token_counts"](spark, SF)) == sorted(want, key=repr)


def test_only_distinct_misses_are_encoded_and_appended(spark):
    path = scratch_path(ready(spark), "cache")
    first = spark.createDataFrame(
        [(1, "one two"), (2, "one two"), (3, None), (3, ""), (None, "six")],
        "doc_id long, text string",
    ).selectExpr("*", "7 AS n_tokens", "'x' AS content")
    got = rows(count_tokens(first, WORDS, path, limit=1))
    assert got == sorted([(1, 7, 2, True), (2, 7, 2, True), (3, 0, 0, False), (3, 0, 0, False),
                          (None, 3, 1, False)], key=repr)
    assert spark.read.parquet(path).count() == 3
    more = first.union(first.limit(1).selectExpr("9L", "'a new text'", "7", "'x'"))
    assert len(rows(count_tokens(more, WORDS, path))) == 6
    assert spark.read.parquet(path).count() == 4


def test_what_is_stored_is_used_for_its_tokenizer_only(spark):
    path = scratch_path(ready(spark), "cache")
    df = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    count_tokens(df, WORDS, path).collect()
    stored = spark.read.parquet(path).collect()
    # another version's count, and a row that a repeated job stored twice
    spark.createDataFrame(
        [(stored[0].content, "another", 99), tuple(stored[0])], CACHE
    ).write.mode("append").parquet(path)
    assert rows(count_tokens(df, WORDS, path)) == [(1, 7, 2, False)]
    assert count_tokens(df.limit(0), WORDS, path).count() == 0


def test_a_second_run_encodes_nothing(spark, monkeypatch):
    path = scratch_path(ready(spark), "cache")
    df = read(spark, SF, "documents")
    first = rows(count_tokens(df, WORDS, path))
    stored = spark.read.parquet(path)
    files, n = sorted(stored.inputFiles()), stored.count()
    assert n == df.select("text").distinct().count() or n < df.count()
    assert rows(count_tokens(df, WORDS, path)) == first
    assert sorted(spark.read.parquet(path).inputFiles()) == files
    # another version of the tokenizer encodes all anew
    monkeypatch.setattr(tokencounts, "version", lambda _: "another")
    assert rows(count_tokens(df, WORDS, path)) == first
    assert spark.read.parquet(path).count() == 2 * n


def test_texts_of_one_normal_form_are_encoded_once(spark):
    path = scratch_path(ready(spark), "cache")
    same = ["Été  now\n\nA", "été now a", "E\u0301te\u0301 NOW\ta", "É\u0054É\x0b now A"]
    special = ["x <|ENDOFTEXT|>", "x <|endoftext|>", "X <|endoftext|>"]
    texts = [*same, *special]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = library(WORDS)
    want = [(i, len(t.encode()), len(model.encode(t, add_special_tokens=False).ids)) for i, t in enumerate(texts)]
    assert [r[:3] for r in rows(count_tokens(df, WORDS, path))] == want
    assert spark.read.parquet(path).count() == 1 + len(special)


def test_normal_form_is_the_tokenizers():
    model = WordIds(WORDS, 100)
    for text in ["A  b\nÉ ß", "", " ", "\n x", "Σας İ ſ K Å", "a\u0301 \u00a0 b\u2003c", "日本 語"]:
        assert model.content(text).decode() == model.library.normalizer.normalize_str(text)
