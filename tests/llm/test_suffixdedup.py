import hashlib
import random

import numpy as np
import pytest

from martlens.llm import suffixdedup
from martlens.llm.inputs import read, ready
from martlens.llm.queries import QUERIES
from martlens.llm.suffixdedup import NO_ID, remove_repeats, segments
from martlens.llm.suffixes import longest_previous

SF = "/root/testdata/sf0.001"


def brute(rows, length):
    seen, out = set(), []
    documents = sorted({(NO_ID if i is None else i, (t or "").encode()) for i, t in rows})
    for i, data in documents:
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(window)
        left = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        runs = sum(g and not before for g, before in zip(gone, b"\0" + gone, strict=False))
        out.append((i, len(data), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def result(df):
    return sorted(
        (NO_ID if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
        for r in df.collect()
    )


def make_rows(seed=5, n=120):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdé ") for _ in range(900))

    def part():
        a = rng.randrange(800)
        return rng.choice([base[a : a + rng.randrange(5, 200)], "xyz", str(rng.random())])

    return [
        (i, None if i % 17 == 0 else "".join(part() for _ in range(rng.randrange(9))))
        for i in range(n)
    ]


@pytest.mark.parametrize("length, hot", [(20, 20_000), (33, 2), (100, 20_000)])
def test_against_brute_force(spark, length, hot):
    rows = make_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = result(remove_repeats(df, length, texts=False, hot_segments=hot))
    assert got == brute(rows, length)
    assert sum(r[2] for r in got) > 0


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in read(ready(spark), SF, "documents").collect()]
    assert result(QUERIES["op1_suffix_array_dedup"](spark, SF)) == brute(rows, 100)


def test_copies_nulls_ties_and_clashing_names(spark):
    text = "0123456789 once more and again " * 8
    rows = [(5, text, 1), (5, text, 2), (None, text, 3), (9, None, 4), (2, "", 5), (7, text, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int").withColumnsRenamed({})
    df = df.selectExpr("doc_id", "text", "n_bytes", "n_bytes AS id", "n_bytes AS c0",
                       "'t' AS tag", "1 AS cuts", "length(text) AS n_chars")
    got = {r.id: r for r in remove_repeats(df, 100).collect()}
    assert len(got) == 6 and got[1].c0 == 1 and got[1].tag == "t"
    # both rows of id 5 are one document: its own repeats go, its first 100 bytes stay
    assert got[1].kept == got[2].kept and 0 < len(got[1].kept) < len(text)
    assert got[1].text == got[1].kept.decode() and got[1].n_chars == len(got[1].text)
    assert got[3].n_removed == got[6].n_removed == len(text) and got[6].spans[0].start == 0
    assert got[4].kept == b"" and got[4].n_bytes == 0 and got[5].n_spans == 0


def test_cut_characters_leave_no_broken_text(spark):
    base = "é" * 10 + "ab" * 60
    df = spark.createDataFrame([(1, base), (2, "x" + base[5:])], "doc_id long, text string")
    assert all(r.text is not None for r in remove_repeats(df, 31).collect())


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_longest_previous_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(60):
        depth, n = int(rng.choice([8, 9, 16, 31])), int(rng.integers(30, 150))
        flat = rng.integers(97, 97 + rng.integers(1, 4), n + depth).astype(np.uint8)
        places = np.sort(rng.choice(n, rng.integers(1, n), replace=False))
        data = flat.tobytes()

        def common(p, q, data=data, depth=depth):
            k = 0
            while k < depth and data[p + k] == data[q + k]:
                k += 1
            return k

        want = [max((common(p, q) for q in places[:i]), default=0) for i, p in enumerate(places)]
        assert longest_previous(flat, places, depth).tolist() == want


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 100, 3_000).astype(np.uint8)
    data = np.concatenate([text[:2000], rng.integers(65, 70, 77).astype(np.uint8), text[500:2500]])
    ends = np.array([2000, len(data)])
    starts, counts, anchors = segments(data, ends, 100)
    covered = np.repeat(starts, counts) + np.concatenate([np.arange(c) for c in counts])
    valid = [p for p in range(len(data) - 99) if p + 100 <= 2000 or p >= 2000]
    assert covered.tolist() == valid
    by_window = {}
    for p, a in zip(covered.tolist(), np.repeat(anchors, counts).tolist(), strict=True):
        assert by_window.setdefault(data[p : p + 100].tobytes(), a) == a


def test_a_passage_in_many_different_documents_is_not_gathered(spark, monkeypatch):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(120))

    def around():
        return "".join(rng.choice("ijklmnop") for _ in range(150))

    rows = [(i, around() + passage + around()) for i in range(80)]
    rows += [rows[7], (None, passage), (500, passage * 3)]
    factors, hot = suffixdedup._factors, 10

    def guarded(length):
        inner = factors(length)

        def run(batches):
            batches = list(batches)
            routes = [r for b in batches for r in b.column("route").to_pylist()]
            assert max(map(routes.count, routes), default=0) <= hot
            yield from inner(iter(batches))

        return run

    monkeypatch.setattr(suffixdedup, "_factors", guarded)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = result(remove_repeats(df, 100, texts=False, hot_segments=hot))
    assert sorted(set(got)) == brute(rows, 100) and len(got) == len(rows)
    assert sum(r[2] for r in got) > 80 * 120


def test_equal_windows_fall_to_one_row_before_the_shuffle(spark):
    text = "0123456789 of a passage " * 6
    rows = [(i, 0, text[:120]) for i in range(50)]
    docs = spark.createDataFrame(rows, "id long, tag long, whole string").coalesce(1)
    needs = [(1, i, 0, 0, 120) for i in range(50)]
    needs = spark.createDataFrame(
        needs, "anchor long, id long, tag long, start long, length int").coalesce(1)
    out = suffixdedup._window_rows(docs, needs, 100).collect()
    single = [r for r in out if not r.settled]
    batches = -(-len(single) // 21)
    assert len(out) - len(single) == 50 - batches and batches < 25


def test_a_very_long_text(spark):
    rng = random.Random(11)
    block = "".join(rng.choice("abcdefgh é") for _ in range(300_000))
    rows = [(1, block + "new" + block[:5_000]), (2, block[1_000:200_000]), (3, "a" * 200_000)]
    got = {r.doc_id: r for r in remove_repeats(
        spark.createDataFrame(rows, "doc_id long, text string"), 100, texts=False).collect()}
    assert got[1].n_removed == len(block[:5_000].encode()) and got[1].n_spans == 1
    assert got[2].n_removed == got[2].n_bytes and got[2].n_spans == 1
    assert got[3].n_removed == 200_000 - 1  # its first byte is in the first string alone
