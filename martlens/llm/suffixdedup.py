"""Removing text that an earlier place already has, by longest previous factors.

Every window of ``length`` bytes has an anchor, the place of its smallest k-gram hash;
equal windows have the same anchor in the same place.  Neighbouring windows with one
anchor form a segment, so grouping segments by the anchor's hash brings all equal
windows together.  In a group

* segments equal in whole are settled by their digest: the earliest stays;
* where different segments remain, their texts are fetched, a suffix array orders their
  windows, and the previous and next entries of a smaller place give the longest
  previous factor of each; a window is removed if that reaches ``length``.

Large groups are no burden: equal segments fall to one row per slice of the input
before they are shuffled, and where more than ``hot_segments`` different segments share
an anchor each of their windows goes its own way by its 128-bit digest: as a row without its
text, of equal windows one per slice, settled in sorted order like equal segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlens.llm.bpe import slices
from martlens.llm.inputs import numbered, parts, whole_text
from martlens.llm.suffixes import longest_previous
from martlens.sources.tables import materialize

GRAM = 24
BLOCK = 1 << 17
NO_ID = 2**63 - 1  # a null id comes after all others

ROWS = "settled boolean, anchor bigint, digest bigint, id bigint, tag bigint, start bigint, " \
       "length int"  # fmt: skip
TEXTS = "route bigint, id bigint, tag bigint, start bigint, part binary"
REMOVED = "id bigint, tag bigint, start bigint, length int"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A polynomial hash of the ``gram`` bytes from each place."""
    level, size, power = data.astype(np.uint64) + np.uint64(1), 1, int(_ODD)
    out, have = None, 0
    rest = gram
    while True:
        if rest & 1:
            if out is None:
                out = level
            else:
                n = len(level) - have
                out = out[:n] * np.uint64(power) + level[have:]
            have += size
        rest >>= 1
        if not rest:
            return out
        level = level[:-size] * np.uint64(power) + level[size:]
        power = power * power % 2**64
        size *= 2


def segments(
    data: np.ndarray, ends: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, window count and anchor hash of each segment of the texts in ``data``.

    ``ends`` are the places where the texts end.  Windows never cross texts.
    """
    gram = min(GRAM, length)
    wide = length - gram + 1  # k-grams in a window
    windows = len(data) - length + 1
    if windows <= 0:
        return (np.empty(0, np.int64),) * 3
    anchors, hashes = np.empty(windows, np.int64), np.empty(windows, np.uint64)
    mask = np.uint64((1 << 24) - 1)
    for at in range(0, windows, BLOCK):
        n = min(BLOCK, windows - at)
        full = gram_hashes(data[at : at + n + length - 1], gram)
        own = ((full * _ODD) & ~mask) | np.arange(len(full), dtype=np.uint64)
        low, size = own, 1
        while size * 2 <= wide:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < wide:
            low = np.minimum(low[: len(low) - (wide - size)], low[wide - size :])
        place = (low & mask).astype(np.int64)
        anchors[at : at + n] = place + at
        hashes[at : at + n] = full[place]
    # windows that reach over the end of their text do not count
    valid = np.ones(windows + 1, np.int8)
    for end in ends.tolist():
        valid[max(0, end - length + 1) : min(end, windows)] = 0
    valid = valid[:windows].astype(bool)
    begin = np.append(True, (anchors[1:] != anchors[:-1]) | ~valid[:-1]) & valid
    starts = np.flatnonzero(begin)
    runs = np.cumsum(begin)[valid] - 1
    counts = np.bincount(runs, minlength=len(starts))
    return starts, counts, _mixed(hashes[starts]).view(np.int64)


def _identified(plain: DataFrame, one: str, text: str) -> DataFrame:
    """Documents with ``id`` and ``tag``, which tells texts of one id apart, and ``whole``."""
    key = F.coalesce(F.col(one).cast("bigint"), F.lit(NO_ID))
    counted = plain.select(key.alias("id")).groupBy("id").count()
    single = counted.agg(F.max("count")).head()[0] in (None, 1)
    rows = plain.withColumns({"id": key, "whole": whole_text(text)})
    return rows.withColumn("tag", F.lit(0).cast("bigint") if single else F.xxhash64("whole"))


def _segment_rows(rows: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in slices(batch, "whole"):
                seen, ids, tags, texts = set(), [], [], []
                order = sorted(zip(
                    small.column("id").to_pylist(), small.column("tag").to_pylist(),
                    map(str.encode, small.column("whole").to_pylist()), strict=True))
                for one, tag, text in order:
                    if len(text) >= length and (one, tag) not in seen:
                        seen.add((one, tag))
                        ids.append(one)
                        tags.append(tag)
                        texts.append(text)
                if not texts:
                    continue
                flat = b"".join(texts)
                ends = np.cumsum([len(t) for t in texts])
                starts, counts, anchor = segments(np.frombuffer(flat, np.uint8), ends, length)
                digest = np.fromiter(
                    (xxhash.xxh3_64_intdigest(flat[a:b]) for a, b in zip(
                        starts.tolist(), (starts + counts + length - 1).tolist(), strict=True)),
                    np.uint64, len(starts)).view(np.int64)
                doc = np.searchsorted(ends, starts, side="right")
                place = starts - (ends - [len(t) for t in texts])[doc]
                # rows are in order, so of equal segments the first is the earliest here
                both = _mixed(digest.view(np.uint64)) ^ anchor.view(np.uint64)
                settled = np.ones(len(starts), bool)
                settled[np.unique(both, return_index=True)[1]] = False
                own = _mixed((np.array(ids, np.int64)[doc] * 31 + place).view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(settled), pa.array(np.where(settled, own.view(np.int64), anchor)),
                     pa.array(digest), pa.array(np.array(ids, np.int64)[doc]),
                     pa.array(np.array(tags, np.int64)[doc]), pa.array(place),
                     pa.array((counts + length - 1).astype(np.int32))],
                    names=["settled", "anchor", "digest", "id", "tag", "start", "length"],
                )

    return rows.select("id", "tag", "whole").mapInArrow(run, ROWS)


_NAMES = ("anchor", "digest", "id", "tag", "start", "length")


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, digest and place: of equal segments the first stays.

    The others are settled.  A first segment is given out, unsettled, if its anchor has
    another one.  The last one of a batch waits for the next batch; ``given`` tells
    whether it is out already.
    """
    waiting = [np.empty(0, np.int64)] * 5 + [np.empty(0, np.int32)]
    given = False
    schema = pa.schema([("settled", pa.bool_()), *[(n, pa.int64()) for n in _NAMES[:5]],
                        ("length", pa.int32())])

    def out(settled, columns, pick):
        arrays = [pa.array(settled[pick]), *[pa.array(c[pick]) for c in columns]]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    for batch in batches:
        done = batch.column("settled").to_numpy(zero_copy_only=False)
        columns = [batch.column(n).to_numpy() for n in _NAMES]
        if done.any():
            yield out(done, columns, done)
        columns = [np.concatenate([w, c[~done]]) for w, c in zip(waiting, columns, strict=True)]
        anchor, digest, ids, tags, start, _ = columns
        if not len(anchor):
            continue

        def as_before(x):
            return np.append(False, x[1:] == x[:-1])

        same_anchor = as_before(anchor)
        equal = same_anchor & as_before(digest)
        # a document that is there twice is one document
        again = equal & as_before(ids) & as_before(tags) & as_before(start)
        heads = np.flatnonzero(~equal)
        follows = same_anchor[heads]
        company = follows | np.append(follows[1:], False)
        pick = equal & ~again
        pick[heads] = company
        if given:
            pick[0] = False
        if pick.any():
            yield out(equal, columns, pick)
        if len(heads) > 1:
            given = bool(company[-1])
        waiting = [c[heads[-1] : heads[-1] + 1] for c in columns]


def _cuts(rows: DataFrame, needs: DataFrame) -> DataFrame:
    """The documents of undecided segments, each with its segments."""
    cuts = needs.groupBy("id", "tag").agg(
        F.collect_list(F.struct("anchor", "start", "length")).alias("cuts")
    )
    return rows.select("id", "tag", "whole").join(cuts, ["id", "tag"])


def _fetch(rows: DataFrame, needs: DataFrame) -> DataFrame:
    """The texts of undecided segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in slices(batch, "whole"):
                out = []
                for one, tag, text, own in zip(
                    *(small.column(c).to_pylist() for c in ("id", "tag", "whole", "cuts")),
                    strict=True,
                ):
                    data = text.encode()
                    for cut in own:
                        a, n = cut["start"], cut["length"]
                        out.append((cut["anchor"], one, tag, a, data[a : a + n]))
                if out:
                    kinds = [pa.int64()] * 4 + [pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                        names=["route", "id", "tag", "start", "part"],
                    )

    found = _cuts(rows, needs).mapInArrow(run, TEXTS)
    total = needs.agg(F.sum("length")).head()[0] or 0
    return found.repartition(parts(rows.sparkSession, total, 1_000_000), "route")


def _window_rows(rows: DataFrame, needs: DataFrame, length: int) -> DataFrame:
    """The windows of undecided segments by their digest; all but the first of a slice settled.

    Neighbouring settled windows make one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in slices(batch, "whole"):
                order = sorted(zip(
                    *(small.column(c).to_pylist() for c in ("id", "tag", "whole")),
                    [sorted({(c["start"], c["length"]) for c in own})
                     for own in small.column("cuts").to_pylist()], strict=True))
                digests, ids, tags, starts, counts, last = [], [], [], [], [], None
                for one, tag, text, own in order:
                    if (one, tag) == last:  # a document that is there twice is one document
                        continue
                    last, data = (one, tag), text.encode()
                    for a, n in own:
                        ids.append(one)
                        tags.append(tag)
                        starts.append(a)
                        counts.append(n - length + 1)
                        digests.append(b"".join(
                            xxhash.xxh3_128_digest(data[b : b + length])
                            for b in range(a, a + n - length + 1)))
                if not ids:
                    continue
                keys = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                owner = np.repeat(np.arange(len(ids)), counts)
                begins = np.cumsum(counts) - counts
                place = np.array(starts, np.int64)[owner] + np.arange(len(owner)) - begins[owner]
                sort = np.lexsort((keys[:, 1], keys[:, 0]))  # stable: equal windows by place
                ordered = keys[sort]
                settled = np.zeros(len(owner), bool)
                settled[sort[1:]] = (ordered[1:] == ordered[:-1]).all(axis=1)
                follows = np.append(False, settled[1:] & settled[:-1] & (owner[1:] == owner[:-1]))
                head = np.flatnonzero(~follows)
                runs = np.diff(np.append(head, len(owner)))
                id_of, tag_of = np.array(ids, np.int64)[owner], np.array(tags, np.int64)[owner]
                spread = _mixed((id_of * 31 + place).view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(settled[head]),
                     pa.array(np.where(settled, spread, keys[:, 0])[head]),
                     pa.array(keys[head, 1]), pa.array(id_of[head]), pa.array(tag_of[head]),
                     pa.array(place[head]), pa.array((runs + length - 1).astype(np.int32))],
                    names=["settled", "anchor", "digest", "id", "tag", "start", "length"],
                )

    return _cuts(rows, needs).mapInArrow(run, ROWS)


def _matched(rows: DataFrame, needs: DataFrame, length: int, hot_segments: int) -> DataFrame:
    """The stretches of undecided segments that an earlier place has."""
    hot = needs.groupBy("anchor").count().filter(F.col("count") > hot_segments).select("anchor")
    hot = materialize(hot, "hot-anchors")
    if hot.isEmpty():
        return _fetch(rows, needs).mapInArrow(_factors(length), REMOVED)
    cold = _fetch(rows, needs.join(hot, "anchor", "left_anti"))
    needs = needs.join(hot, "anchor", "left_semi")
    windows = needs.agg(F.sum(F.col("length") - (length - 1))).head()[0]
    each = _window_rows(rows, needs, length)
    each = each.repartition(parts(rows.sparkSession, windows, 1_000_000), "anchor")
    each = each.sortWithinPartitions("anchor", "digest", "id", "tag", "start")
    each = each.mapInArrow(_settle, ROWS).filter("settled")
    return cold.mapInArrow(_factors(length), REMOVED).unionByName(
        each.select("id", "tag", "start", "length")
    )


def _factors(length: int):
    """A task's segments as one text: windows whose longest previous factor is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=_texts_schema())
        if not len(table):
            return
        columns = {c: table.column(c).to_numpy() for c in ("id", "tag", "start")}
        order = np.lexsort((columns["start"], columns["tag"], columns["id"]))
        columns = {c: v[order] for c, v in columns.items()}
        again = np.ones(len(order), bool)
        for v in columns.values():
            again &= np.append(False, v[1:] == v[:-1])
        values = table.column("part").to_pylist()
        segs = [values[i] for i in order[~again].tolist()]
        columns = {c: v[~again] for c, v in columns.items()}
        sizes = np.array([len(s) for s in segs])
        begins = np.cumsum(sizes) - sizes
        counts = sizes - length + 1
        owner = np.repeat(np.arange(len(segs)), counts)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        flat = np.frombuffer(b"".join(segs), np.uint8)
        found = longest_previous(flat, begins[owner] + inside, length)
        hit = np.flatnonzero(found >= length)
        owner, at = owner[hit], columns["start"][owner[hit]] + inside[hit]
        if not len(hit):
            return
        # neighbouring windows of a segment make one removed stretch
        fresh = np.append(True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1))
        first = np.flatnonzero(fresh)
        run_lengths = np.diff(np.append(first, len(at))) + length - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns["id"][owner[first]]), pa.array(columns["tag"][owner[first]]),
             pa.array(at[first]), pa.array(run_lengths.astype(np.int32))],
            names=["id", "tag", "start", "length"],
        )

    return run


def _texts_schema() -> pa.Schema:
    return pa.schema([*[(n, pa.int64()) for n in ("route", "id", "tag", "start")],
                      ("part", pa.binary())])


def _spans(cuts: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal removed runs."""
    out: list[list[int]] = []
    for a, b in sorted((c["start"], c["start"] + c["length"]) for c in cuts or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


ADDED = ("kept", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256")


def remove_repeats(
    docs: DataFrame, length: int = 100, texts: bool = True, hot_segments: int = 20_000
) -> DataFrame:
    """Documents without the bytes of every ``length``-byte string found earlier.

    Texts are UTF-8 bytes.  A byte goes if a string of ``length`` bytes covers it that
    also starts earlier: in a document of smaller ``doc_id``, or earlier in the same one.
    Matches stay inside documents, overlaps count, and strings are judged on the input.

    Returns the rows with their columns and ``kept`` (the remaining bytes), ``n_bytes``,
    ``n_removed``, ``n_spans``, ``spans`` (maximal removed runs as start and end) and
    ``kept_sha256``; columns of these names are replaced.  ``text`` becomes the remaining
    bytes as text, without bytes of characters that were cut apart, and ``n_chars``, if
    there is one, follows it.  ``texts=False`` leaves the other columns, ``text``,
    ``kept`` and ``spans`` out.

    A null text is empty.  Null ids come after all others; texts of one id are ordered by
    their hash, and a row that repeats id and text is the same document: it gets the same
    result.  An empty table gives an empty result.
    """
    if length < 8:
        raise ValueError("length must be at least 8")
    plain, names = numbered(docs, ADDED)
    text, one = f"c{names.index('text')}", f"c{names.index('doc_id')}"
    rows = _identified(plain, one, text)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = _segment_rows(rows, length).repartition(n, "anchor")
    found = found.sortWithinPartitions("anchor", "digest", "id", "tag", "start")
    decided = materialize(found.mapInArrow(_settle, ROWS), "segments")
    removed = ["id", "tag", "start", "length"]
    needs = decided.filter(~F.col("settled")).drop("settled", "digest")
    matched = _matched(rows, needs, length, hot_segments)
    cuts = (
        decided.filter("settled").select(*removed).unionByName(matched)
        .groupBy("id", "tag").agg(F.collect_list(F.struct("start", "length")).alias("cuts"))
    )
    if texts:
        carried, outputs = plain.schema.fields, [*names, *ADDED]
    else:
        rows = rows.select(F.col(one).cast("bigint").alias("c0"), "id", "tag", "whole")
        carried = rows.schema.fields[:1]
        outputs = ["doc_id", *[c for c in ADDED if c not in ("kept", "spans")]]
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                     T.StructField("end", T.LongType())]))
    kinds = {"kept": T.BinaryType(), "spans": span, "kept_sha256": T.StringType()}
    schema = T.StructType([*carried, *[
        T.StructField(c, kinds.get(c, T.LongType())) for c in ADDED if c in outputs]])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in slices(batch, "whole"):
                kept, spans, sizes = [], [], []
                for source, cuts in zip(
                    small.column("whole").to_pylist(), small.column("cuts").to_pylist(),
                    strict=True,
                ):
                    data, at, left = source.encode(), 0, []
                    runs = _spans(cuts)
                    for a, b in runs:
                        left.append(data[at:a])
                        at = b
                    kept.append(b"".join([*left, data[at:]]))
                    spans.append(runs)
                    sizes.append(len(data))
                out = {f.name: small.column(f.name) for f in carried}
                if texts:
                    whole = [k.decode("utf-8", "ignore") for k in kept]
                    out[text] = pa.array(whole, pa.string())
                    if "n_chars" in names:
                        c = f"c{names.index('n_chars')}"
                        out[c] = pa.array(map(len, whole), pa.int64()).cast(out[c].type)
                    out["kept"] = pa.array(kept, pa.binary())
                out["n_bytes"] = pa.array(sizes, pa.int64())
                out["n_removed"] = pa.array([sum(b - a for a, b in x) for x in spans], pa.int64())
                out["n_spans"] = pa.array([len(x) for x in spans], pa.int64())
                if texts:
                    out["spans"] = pa.array(
                        [[{"start": a, "end": b} for a, b in x] for x in spans],
                        pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
                    )
                out["kept_sha256"] = pa.array([hashlib.sha256(k).hexdigest() for k in kept],
                                              pa.string())
                yield pa.RecordBatch.from_pydict(out)

    return rows.join(cuts, ["id", "tag"], "left").mapInArrow(finish, schema).toDF(*outputs)
