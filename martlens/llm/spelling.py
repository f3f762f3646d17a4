"""Grouping of spelling variants: words at one edit, and the common word they stand for.

The vocabulary is too large for one index.  Two words at one edit share either the first
half of one of them as a prefix or its second half as a suffix, so each word is sent to the
groups of its possible halves, and every group is a bounded FM-index that answers the words
whose half it is.  A half that very many words share has its words dealt over blocks, and
asks each of them.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.llm.fmindex import WordIndex
from martlens.llm.inputs import documents, parts
from martlens.sources.tables import materialize

LETTERS = "a-zÀ-ÿ"  # fixed: the letters of a run after A-Z is lower-cased
COUNTS = "word string, n bigint"
FOUND = "word string, n bigint, n_near bigint, best struct<less: bigint, word: string>"
HELD = 200_000  # words that a task counts before it sends them on
CHUNK = 10_000  # queries that move through an index together


def altered(doc_id: int | None, run: str, every: int) -> str:
    """The run, or without one letter where ``every`` divides its checksum in the document."""
    if every:
        h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
        if h % every == 0:
            k = h % len(run)
            return run[:k] + run[k + 1 :]
    return run


def word_counts(docs: DataFrame, least_chars: int, least_n: int, every: int) -> DataFrame:
    """``word, n`` of the runs of letters with at least so many letters and occurrences."""
    runs = re.compile(f"[{LETTERS}]{{{least_chars},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                names=["word", "n"],
            )

        held: dict[str, int] = {}
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for i in range(len(batch)):
                # bytes lower-case A-Z and nothing else
                found = Counter(runs.findall(texts[i].as_py().encode().lower().decode()))
                doc = ids[i].as_py()
                for run, n in found.items():
                    word = altered(doc, run, every)
                    if len(word) >= least_chars:
                        held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield sent()
                    held = {}
        if held:
            yield sent()

    counted = documents(docs).mapInArrow(count, COUNTS)
    total = counted.groupBy("word").agg(F.sum("n").alias("n"))
    return total.filter(F.col("n") >= least_n)


def halves(words: DataFrame) -> DataFrame:
    """A row per word and half that a word at one edit from it (or it) may have.

    A word of m letters has m // 2 in its first half.  ``asks`` marks the word's own halves.
    """
    size = F.length("word")
    # the words at one edit have one letter less, as many, or one more
    firsts = F.array_distinct(F.transform(
        F.array(size - 1, size, size + 1), lambda m: F.floor(m / 2).cast("int")))
    seconds = F.array_distinct(F.transform(
        F.array(size - 1, size, size + 1), lambda m: (m - F.floor(m / 2)).cast("int")))
    kinds = F.concat(
        F.transform(firsts, lambda k: F.struct(
            F.lit("left").alias("side"), k.alias("k"),
            (k == F.floor(size / 2)).alias("asks"))),
        F.transform(seconds, lambda k: F.struct(
            F.lit("right").alias("side"), k.alias("k"),
            (k == size - F.floor(size / 2)).alias("asks"))),
    )
    rows = words.select("word", "n", F.explode(kinds).alias("x")).select("word", "n", "x.*")
    part = F.expr("if(side = 'left', left(word, k), right(word, k))")
    return rows.select("word", "n", "side", "asks", F.xxhash64("side", part).alias("half"))


def near_words(words: DataFrame, group_words: int = 50_000) -> DataFrame:
    """Per word of ``word, n`` how many others are at one edit, and the commonest of them.

    ``best`` holds its count, negative, and the word: the smallest is the commonest, ties
    by code points; null if there is none.  A group holds about ``group_words`` words; a
    half with a quarter as many has groups of its own.
    """
    spark = words.sparkSession
    rows = halves(words)
    hot_rows = max(1, group_words // 4)
    counts = rows.groupBy("half").agg(F.count("*").alias("held"))
    counts = materialize(counts, "word-halves")
    total = counts.agg(F.sum("held")).head()[0] or 0
    slots = parts(spark, total, group_words)
    hot = counts.filter(F.col("held") > hot_rows).select(
        "half", F.ceil(F.col("held") / hot_rows).cast("int").alias("blocks")
    )
    dealt = rows.join(hot, "half", "left")
    block = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    # a word lies in one block of a half; its question goes to all of them
    to = F.when(F.col("blocks").isNull(), F.array(F.lit(-1))).when(
        F.col("asks"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block))
    dealt = dealt.select("*", block.alias("own"), F.explode(to).alias("block")).select(
        "word", "n", "side", "asks", "block",
        F.coalesce(F.col("block") == F.col("own"), F.lit(True)).alias("lies"),
        F.when(F.col("block") < 0, F.pmod("half", F.lit(slots))).otherwise(F.col("half")).alias("slot"),
    )

    def search(table: pa.Table) -> pa.Table:
        side = table.column("side")[0].as_py()
        lies, asks = table.filter(table.column("lies")), table.filter(table.column("asks"))
        counts = dict(zip(*[lies.column(c).to_pylist() for c in ("word", "n")], strict=True))
        index = WordIndex(list(counts))
        queries, own = (asks.column(c).to_pylist() for c in ("word", "n"))
        n_near, best = [0] * len(queries), [None] * len(queries)
        for at in range(0, len(queries), CHUNK):
            pairs = index.near(queries[at : at + CHUNK], side)
            for query, number in zip(*[x.tolist() for x in pairs], strict=True):
                found = index.words[number]
                rank = (-counts[found], found)
                n_near[at + query] += 1
                if best[at + query] is None or rank < best[at + query]:
                    best[at + query] = rank
        best = [b and {"less": b[0], "word": b[1]} for b in best]
        kind = pa.struct([("less", pa.int64()), ("word", pa.string())])
        return pa.table({
            "word": pa.array(queries, pa.string()), "n": pa.array(own, pa.int64()),
            "n_near": pa.array(n_near, pa.int64()), "best": pa.array(best, kind),
        })

    found = dealt.groupBy("side", "slot", "block").applyInArrow(search, FOUND)
    return found.groupBy("word", "n").agg(
        F.sum("n_near").alias("n_near"), F.min("best").alias("best")
    )


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """``word, root`` for ``word, form``: forms followed to their end, ``steps`` at most.

    Each round joins the table to itself and so doubles how far it has followed.
    """
    reached = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, steps))))):
        reached = materialize(reached, "word-roots")
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        reached = reached.join(onward, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root")
        )
    return reached


def spelling_variants(
    docs: DataFrame, least_chars: int = 7, least_n: int = 2, factor: int = 10,
    drop_every: int = 0, group_words: int = 50_000,
) -> DataFrame:
    """Words of all texts, each with the common word that it is a variant of.

    Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of at
    least ``least_chars`` letters and ``least_n`` occurrences ``n`` over all texts.  With
    ``drop_every`` a run loses the letter ``h % length`` in documents where that number
    divides ``h``, the CRC-32 of ``<doc_id>:<run>``: planted mistakes for measuring.

    Two words are near if exactly one letter is inserted, deleted or replaced.  ``form`` is
    the near word of the largest n (ties: the smallest by code points) if that is at least
    ``factor`` (2 or more) times the word's n; ``form_n`` its n, ``n_near`` the number of
    near words.  ``root`` is where following forms ends, the word itself without a form.

    A text that is null or has no such run gives no words; a null id counts as an empty one
    in the checksum; each of several equal rows counts.  Very long runs are words like
    others.  An empty table gives no rows; other columns are left behind.
    """
    if factor < 2:
        raise ValueError("factor must be at least 2: forms could else run in a circle")
    words = materialize(word_counts(docs, least_chars, least_n, drop_every), "words")
    near = near_words(words, group_words)
    largest = -F.col("best.less")
    is_form = largest >= factor * F.col("n")
    rows = near.select(
        "word", F.when(is_form, F.col("best.word")).alias("form"), "n", "n_near",
        F.when(is_form, largest).alias("form_n"),
    )
    rows = materialize(rows, "word-forms")
    most = words.agg(F.max("n")).head()[0] or 1
    # a form has factor times the count, which bounds the number of steps to the root
    steps = int(math.log(max(1, most), factor)) + 1
    found = roots(rows.filter(F.col("form").isNotNull()).select("word", "form"), steps)
    return rows.join(found, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
