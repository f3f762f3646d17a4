"""Quality scores by nearest-neighbour voting in a latent semantic space.

A text's terms are hashed character trigrams, hashed trigrams of character classes (how
letters, capitals, digits, blanks and marks follow one another), and steps of three
ratios: words that repeat the word before, distinct words, and lines that repeat.  A
singular value decomposition of weighted term counts of labelled texts gives the latent
space.  Vectors of labelled texts are sent to all tasks; every document takes its exact
cosine with all of them, block by block, and its nearest neighbours vote with the weight
of their similarity.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlens.llm.bpe import slices
from martlens.llm.inputs import documents, numbered, whole_text
from martlens.sources.tables import materialize

GRAMS, SHAPES, STEPS = 1024, 1024, 16
WIDTH = GRAMS + SHAPES + 3 * STEPS
STEP_WEIGHT = 0.5

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_CLASS = np.arange(256, dtype=np.uint32)  # every mark is a class of its own
_CLASS[97:123] = _CLASS[128:] = ord("a")
_CLASS[65:91] = ord("A")
_CLASS[48:58] = ord("0")


def _trigram_counts(codes: np.ndarray, width: int) -> np.ndarray:
    key = (codes[:-2] * np.uint32(961) + codes[1:-1] * np.uint32(31)) * np.uint32(31) + codes[2:]
    key = (key * np.uint32(2654435769)) >> np.uint32(32 - int(np.log2(width)))
    return np.bincount(key, minlength=width)


def _steps(part: float) -> np.ndarray:
    """A ratio as weights of its two nearest steps, finer near 0 and 1."""
    at = (0.5 - 0.5 * np.cos(np.pi * part)) * (STEPS - 1)
    low = min(int(at), STEPS - 2)
    out = np.zeros(STEPS)
    out[low], out[low + 1] = low + 1 - at, at - low
    return out


def terms(text: str) -> np.ndarray:
    """Damped term weights of a whole text; zeros for a text of fewer than 3 bytes."""
    out = np.zeros(WIDTH, np.float32)
    raw = np.frombuffer(text.encode(), np.uint8)
    if len(raw) < 3:
        return out
    for first, width, table in ((0, GRAMS, _LOWER), (GRAMS, SHAPES, _CLASS)):
        counts = np.sqrt(_trigram_counts(table[raw], width))
        out[first : first + width] = counts / np.linalg.norm(counts)
    words = text.split()
    if words:
        lines = text.split("\n")
        again = sum(map(operator.eq, words, words[1:])) / max(1, len(words) - 1)
        # many words must repeat some: compare with what a text of this length has
        fresh = min(1.0, len(set(words)) / len(words) ** 0.85)
        repeated = 1 - len(set(lines)) / len(lines)
        at = GRAMS + SHAPES
        out[at:] = STEP_WEIGHT * np.concatenate([_steps(again), _steps(fresh), _steps(repeated)])
    return out


class LatentSpace:
    """Term weights to unit vectors of the leading directions."""

    def __init__(self, weights: np.ndarray, directions: np.ndarray):
        self.weights, self.directions = weights, directions

    @classmethod
    def fit(cls, rows: np.ndarray, size: int) -> LatentSpace:
        """``rows``: terms of labelled texts.  Rare terms weigh more."""
        seen = (rows > 0).sum(axis=0)
        weights = (np.log((1 + len(rows)) / (1 + seen)) + 0.3).astype(np.float32)
        scaled = rows * weights
        values, vectors = np.linalg.eigh(scaled.T @ scaled)
        top = np.argsort(-values, kind="stable")[:size]
        return cls(weights, vectors[:, top].astype(np.float32))

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        out = (rows * self.weights) @ self.directions
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def vote(
    vectors: np.ndarray, voters: np.ndarray, labels: np.ndarray, near: int, block: int = 512
) -> np.ndarray:
    """Label mean of the ``near`` voters of highest cosine, weighted by similarity.

    The weight is the cosine less that of the first voter left out, so that no order among
    equal cosines matters.  A zero vector has no neighbours: its score is 0.
    """
    out = np.zeros(len(vectors))
    near = min(near, len(voters) - 1)
    for at in range(0, len(vectors), block):
        own = vectors[at : at + block]
        cosine = own @ voters.T
        if near < 1:
            out[at : at + block] = labels.mean() if len(labels) else 0.0
            continue
        top = np.argpartition(-cosine, near, axis=1)[:, : near + 1]
        best = np.take_along_axis(cosine, top, axis=1).astype(np.float64)
        weight = best - best.min(axis=1, keepdims=True) + 1e-6
        out[at : at + block] = (weight * labels[top]).sum(axis=1) / weight.sum(axis=1)
    out[~vectors.any(axis=1)] = 0.0
    return np.clip(out, 0.0, 1.0)


def learned_from(doc_id: Column) -> Column:
    """Whether labels of this row may be learned: crc32 of the id as text, modulo 5, is not 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def _labelled(docs: DataFrame, labels: DataFrame, voters: int) -> DataFrame:
    """Terms and label of at most ``voters`` labelled documents, chosen by the hash of their id."""
    usable = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality")
        .filter(F.col("quality").isNotNull() & learned_from(F.col("doc_id")))
        .groupBy("doc_id").agg(F.avg("quality").alias("label"))
    )
    # labels of documents that are not there would use up the bound
    there = usable.join(docs.select(F.col("doc_id").cast("bigint").alias("doc_id")), "doc_id",
                        "left_semi")
    chosen = materialize(
        there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(voters), "labelled-ids"
    )
    texts = documents(docs).join(chosen, "doc_id").dropDuplicates(["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in slices(batch, "text"):
                rows = [terms(t) for t in small.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": small.column("doc_id"), "label": small.column("label"),
                    "terms": pa.array(rows, pa.list_(pa.float32())),
                })

    found = texts.select("doc_id", "label", "text").mapInArrow(
        run, "doc_id bigint, label double, terms array<float>"
    )
    return materialize(found, "labelled-terms")


def score_quality(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, voters: int = 8_192,
    fit_rows: int = 4_096, size: int = 64, near: int = 10,
) -> DataFrame:
    """Rows with all their columns, ``held_out``, ``score`` (0 to 1) and ``predicted`` (0 or 1).

    ``labels`` has ``doc_id`` and ``quality`` (0 or 1; null: none).  Labels are learned
    only where :func:`learned_from` holds; ``held_out`` is its opposite.  The score uses
    the text alone.  The model is bounded: at most ``voters`` labelled documents vote, and
    at most ``fit_rows`` of them fit the latent space of ``size`` directions, both chosen
    by the hash of their id.  Every document is scored, over its whole text.

    A null text is empty; texts of fewer than 3 bytes score 0.  Several labels of one id
    are averaged; of several texts of a labelled id one votes.  Rows with null or repeated
    ids are scored each; a null id is held out.  With no label to learn from every score
    is 0.5.  Columns named like the added ones are replaced; an empty table gives an empty
    result.
    """
    added = ("held_out", "score", "predicted")
    plain, names = numbered(docs, added)
    text, one = f"c{names.index('text')}", f"c{names.index('doc_id')}"
    known = _labelled(docs, labels, voters)
    learning = not known.isEmpty()
    rows = plain.withColumn("whole", whole_text(text))
    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())])
    if learning:

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.concatenate([b.column(0).flatten().to_numpy() for b in batches])
            space = LatentSpace.fit(found.reshape(-1, WIDTH), size)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.ravel()], pa.list_(pa.float32()))
                 for x in (space.weights, space.directions)],
                names=["weights", "directions"],
            )

        # fitted in one task, over at most fit_rows rows; the driver gets the directions
        order = known.orderBy(F.xxhash64("doc_id"), "doc_id").select("terms").limit(fit_rows)
        model = order.coalesce(1).mapInArrow(
            fit, "weights array<float>, directions array<float>"
        ).toArrow()
        weights, directions = (c.combine_chunks().flatten().to_numpy() for c in model.columns)
        space = LatentSpace(weights, directions.reshape(WIDTH, -1))

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column("terms").flatten().to_numpy().reshape(-1, WIDTH)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label"),
                     pa.array(list(space.vectors(own)), pa.list_(pa.float32()))],
                    names=["label", "vector"],
                )

        table = known.mapInArrow(project, "label double, vector array<float>").toArrow()
        vectors = table.column("vector").combine_chunks().flatten().to_numpy().reshape(len(table), -1)
        sent = docs.sparkSession.sparkContext.broadcast(
            (space.weights, space.directions, vectors, table.column("label").to_numpy())
        )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, directions, voting, label = sent.value
        model = LatentSpace(weights, directions)
        for batch in batches:
            for small in slices(batch, "whole"):
                found = np.stack([terms(t) for t in small.column("whole").to_pylist()])
                scores = vote(model.vectors(found), voting, label, near)
                yield pa.RecordBatch.from_arrays(
                    [*small.columns[:-1], pa.array(scores)], names=schema.names
                )

    scored = rows.mapInArrow(score, schema) if learning else plain.withColumn(
        "score", F.lit(0.5))
    return scored.select(
        *plain.columns, (~learned_from(F.col(one))).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    ).toDF(*names, *added)
