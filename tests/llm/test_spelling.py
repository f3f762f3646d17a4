import random
import re
import zlib
from collections import Counter

import pytest

from martlens.llm.fmindex import WordIndex
from martlens.llm.inputs import read, ready
from martlens.llm.queries import QUERIES
from martlens.llm.spelling import spelling_variants

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, least_chars=7, least_n=2, factor=10, every=0):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least_n}
    # words at one edit are equal after a deletion in one or both
    by_rest = {}
    for w in words:
        for rest in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_rest.setdefault(rest, set()).add(w)
    near = {w: set() for w in words}
    for group in by_rest.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= factor * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def result(df):
    return sorted(
        ((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=repr
    )


@pytest.mark.parametrize("seed", range(12))
def test_index_finds_every_word_at_one_edit(seed):
    rng = random.Random(seed)
    letters = rng.choice(["ab", "abc", "aé", "abcdefgh一"])
    longest = rng.choice([4, 8, 30])
    words = {"".join(rng.choices(letters, k=rng.randint(1, longest))) for _ in range(80)}
    words |= {"a" * 40, "a" * 41, "a" * 39 + "b", "a" * 25 + "b" * 20, "b" + "a" * 40}
    index = WordIndex(list(words))
    queries = [*words, *(w + "z" for w in words), "", "a"]
    got = []
    for half in ("left", "right"):
        pairs = zip(*[x.tolist() for x in index.near(queries, half)], strict=True)
        got += [(queries[a], index.words[b]) for a, b in pairs]
    want = [(q, w) for q in queries for w in words if one_edit(q, w)]
    assert sorted(got) == sorted(want)


def test_index_without_words():
    assert all(len(x) == 0 for x in WordIndex([]).near(["a"], "left"))
    assert all(len(x) == 0 for x in WordIndex(["a"]).near([], "right"))


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in read(ready(spark), SF, "documents").select("doc_id", "text").collect()]
    want = brute(rows, every=31)
    assert result(QUERIES["op12_spelling_variants"](spark, SF)) == want
    assert sum(r[1] is not None for r in want) >= 10


# hot halves, chains of forms, ties, letters beyond ASCII, odd rows
ROWS = [
    (1, "colour " * 200 + "color " * 20 + "colr " * 2 + "Colur COLUR coloor"),
    (2, "über Über ÜBER uber ubber ×÷× ß1ßß a-b"), (3, None), (4, ""), (None, "color colours"),
    (5, "x" * 2_000 + " " + "x" * 2_001), (5, "x" * 2_000), (6, "123 ... "),
    (7, " ".join(["abcd" + a + b for a in "abcdefgh" for b in "abcdefgh"] * 2)),
    (8, " ".join([a + b + "wxyz" for a in "abcdefgh" for b in "abcdefgh"])),
    (8, " ".join([a + b + "wxyz" for a in "abcdefgh" for b in "abcdefgh"])),
]


@pytest.mark.parametrize("chars, least, factor, every, group", [
    (1, 1, 2, 0, 50_000), (1, 1, 10, 3, 20), (3, 2, 2, 2, 8), (5, 2, 3, 0, 4), (7, 2, 10, 31, 16),
])
def test_against_brute_force(spark, chars, least, factor, every, group):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = spelling_variants(df, chars, least, factor, every, group_words=group)
    assert result(got) == brute(ROWS, chars, least, factor, every)


def test_other_columns_and_empty_table(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    named = df.selectExpr("'x' AS word", "doc_id", "text", "5 AS n", "1 AS half", "2 AS block")
    assert result(spelling_variants(named, 5)) == result(spelling_variants(df, 5))
    assert spelling_variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="factor"):
        spelling_variants(df, factor=1)
