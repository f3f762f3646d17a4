"""Byte-pair encoding by batched merge rounds, and decoding.

Many words are encoded together.  Their symbols lie in one flat array; the rank
of each neighbouring pair comes from a binary search over the sorted pair keys.
A round finds every word's lowest rank, merges all places of that pair in the
word from left to right, looks up the pairs that changed, and sets finished
words aside.  This gives what merging one lowest pair at a time gives: a merge
only makes pairs of its own new symbol, which no earlier rank contains.

Texts go to words by chunks: at a space between two other characters a word
always ends, so the chunks between such spaces are encoded on their own and
repeated chunks once per batch.  A bounded store keeps the chunks met first,
which are the frequent ones.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.llm.inputs import whole_text

NONE = np.int32(2**31 - 1)

# White space and word patterns of the two tokenizers.
_SPACE = r"\t\n\v\f\r \x85\xa0  -     　"
BYTE_WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
# A chunk may not be cut where white space meets white space, nor beside these.
_AWKWARD = ("  ", " \n", "\n ")
_AWKWARD_ASCII = tuple("\t\v\f\r\x1c\x1d\x1e\x1f")
_AWKWARD_WIDE = tuple(
    c for c in map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
                         0x205F, 0x3000])
)


def plain_spacing(text: str) -> bool:
    """Whether the only white space is single spaces and line ends that do not touch them."""
    return not (
        any(x in text for x in _AWKWARD)
        or any(x in text for x in _AWKWARD_ASCII)
        or not text.isascii() and any(x in text for x in _AWKWARD_WIDE)
    )


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """The merge table of a byte-level vocabulary as sorted arrays."""

    def __init__(self, vocab: dict[str, int], merges: Sequence[Sequence[str]], suffix: str = ""):
        letters = byte_letters()
        self.size = max(vocab.values()) + 1
        self.first = np.array([vocab.get(letters[b], -1) for b in range(256)], np.int32)
        self.last = np.array([vocab.get(letters[b] + suffix, -1) for b in range(256)], np.int32)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair among the sorted keys, -1 where it is none."""
        key = left.astype(np.int64) * self.size + right
        place = np.searchsorted(self.keys, key)
        place[place == len(self.keys)] = 0
        return np.where(self.keys[place] == key, place, -1)

    def encode(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and where each word's ids end."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        if not len(raw):
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        symbol, word = self.first[raw], np.repeat(np.arange(len(words)), sizes)
        tail = np.append(word[1:] != word[:-1], True)
        symbol[tail] = self.last[raw[tail]]
        known = symbol >= 0
        if not known.all():
            symbol, word = symbol[known], word[known]
        place = self._places(symbol, word)
        done_symbols, done_words = [], []
        while len(symbol):
            rank = np.where(place >= 0, self.ranks[place], NONE)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.minimum.reduceat(rank, starts)
            span = np.diff(np.append(starts, len(word)))
            each = np.repeat(lowest, span)
            over = each == NONE
            if over.any():
                done_symbols.append(symbol[over])
                done_words.append(word[over])
                left = ~over
                symbol, word, place, rank, each = (
                    x[left] for x in (symbol, word, place, rank, each)
                )
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == each)
            # of overlapping places of one pair (a letter repeated) every second one merges
            run = np.append(True, np.diff(at) > 1)
            first = at[np.flatnonzero(run)][np.cumsum(run) - 1]
            at = at[(at - first) % 2 == 0]
            symbol[at] = self.made[place[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            fresh = at - np.arange(len(at))  # places after the removal
            symbol, word, place = symbol[keep], word[keep], place[keep]
            changed = np.zeros(len(symbol), bool)
            changed[fresh] = True
            changed[fresh[fresh > 0] - 1] = True
            again = np.flatnonzero(changed)
            here = again[again + 1 < len(symbol)]
            same = word[here] == word[here + 1]
            place[again] = -1
            here = here[same]
            place[here] = self._lookup(symbol[here], symbol[here + 1])
        ids, owner = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.cumsum(np.bincount(owner, minlength=len(words)))

    def _places(self, symbol: np.ndarray, word: np.ndarray) -> np.ndarray:
        place = np.full(len(symbol), -1, np.int64)
        inside = np.flatnonzero(word[1:] == word[:-1])
        place[inside] = self._lookup(symbol[inside], symbol[inside + 1])
        return place


class Store:
    """What is known of chunks: a bounded part stays, the rest lasts for one batch.

    At most ``bound`` chunks stay, none over ``LONGEST`` letters: a text without spaces is
    one chunk, which would else be kept whole.
    """

    LONGEST = 64

    def __init__(self, make, bound: int):
        self.make, self.bound, self.kept = make, bound, {}

    def of(self, chunk_lists: Sequence[Sequence[str]]) -> dict:
        fresh = list(set().union(*chunk_lists).difference(self.kept))
        if not fresh:
            return self.kept
        made = dict(zip(fresh, self.make(fresh), strict=True))
        room = self.bound - len(self.kept)
        if len(made) <= room and max(map(len, fresh)) <= self.LONGEST:
            self.kept.update(made)
            return self.kept
        if room > 0:
            stay = itertools.islice((c for c in fresh if len(c) <= self.LONGEST), room)
            self.kept.update({c: made[c] for c in stay})
        return {**self.kept, **made}


class ByteCodec:
    """Encodes and decodes as a byte-level tokenizer file says."""

    def __init__(self, path: str, bound: int):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merges = Merges(vocab, pairs)
        letter_bytes = {letter: b for b, letter in byte_letters().items()}
        self.bytes_of = {
            i: bytes(letter_bytes[c] for c in token) if set(token) <= letter_bytes.keys()
            else token.encode() for token, i in vocab.items()
        }
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        most = max(self.bytes_of) + 1
        self.digits = [b"%d" % i for i in range(most)]
        self.raw = [self.bytes_of.get(i, b"") for i in range(most)]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special))) or r"(?!)")
        self.words = regex.compile(BYTE_WORDS)
        self.store = Store(self._make, bound)

    def _make(self, chunks: Sequence[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each chunk."""
        # letters after a space, if any, are one word
        words = [c for c in chunks if c.isalpha() or c[1:].isalpha() and c[0] == " "]
        known = dict.fromkeys(words)
        several = {c: self.words.findall(c) for c in chunks if c not in known}
        words += set().union(*several.values()).difference(known)
        ids, ends = self.merges.encode([w.encode("utf-8", "surrogatepass") for w in words])
        flat, places = ids.astype("<u4").tobytes(), [0, *(ends * 4).tolist()]
        known = {w: flat[a:b] for w, a, b in zip(words, places, places[1:], strict=False)}
        for chunk, own in several.items():
            known[chunk] = b"".join(map(known.__getitem__, own))
        return list(map(known.__getitem__, chunks))

    def chunks(self, text: str) -> list[str]:
        """The text in order, cut where a word surely ends."""
        if not plain_spacing(text):
            return self.words.findall(text)
        pieces = text.split(" ")
        out = [" " + p for p in pieces]
        out[0] = pieces[0]
        return out if pieces[0] else out[1:]

    def plan(self, text: str) -> list[tuple[list[str], bytes]]:
        """Runs of chunks, each with the id of the special string after it."""
        if not any(t in text for t in self.special):
            return [(self.chunks(text) if text else [], b"")]
        out, at = [], 0
        for found in self.cut.finditer(text):
            between = text[at : found.start()]
            i = self.special[found.group()]
            out.append((self.chunks(between) if between else [], i.to_bytes(4, "little")))
            at = found.end()
        return [*out, (self.chunks(text[at:]) if at < len(text) else [], b"")]

    def run(self, texts: Sequence[str]) -> Iterator[tuple[bytes, bytes]]:
        """For each text its ids, joined by commas, and the decoded text."""
        plans = [self.plan(t) for t in texts]
        known = self.store.of([chunks for plan in plans for chunks, _ in plan]).__getitem__
        for plan in plans:
            flat = b"".join([b"".join(map(known, chunks)) + after for chunks, after in plan])
            ids = np.frombuffer(flat, "<u4").tolist()
            raw = b"".join(map(self.raw.__getitem__, ids))
            yield (b",".join(map(self.digits.__getitem__, ids)),
                   raw.decode("utf-8", "replace").encode())


@functools.lru_cache(maxsize=2)
def codec(path: str, bound: int) -> ByteCodec:
    return ByteCodec(path, bound)


OUT = "doc_id bigint, n_tokens bigint, ids string, decoded string, ids_sha256 string, " \
      "decoded_sha256 string"  # fmt: skip


def encode_decode(
    docs: DataFrame, path: str, digests_only: bool = False, bound: int = 250_000
) -> DataFrame:
    """Ids of every whole text (decimals joined by commas) and the text they decode to.

    ``path`` is a byte-level BPE file that every executor has; strings of its special
    tokens become their ids.  Digests are SHA-256 in lowercase hex.  ``digests_only``
    leaves the two long columns out.  ``bound`` limits the chunks a worker remembers, none
    of over 64 letters.

    Null texts count as empty: no ids, empty decoded text.  Null and repeated ids keep
    a row each; other columns are left behind; an empty table gives an empty result.
    """
    fields = [f.strip() for f in OUT.split(",")]
    schema = ", ".join(f for f in fields if not digests_only or f.split()[0] not in (
        "ids", "decoded"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path, bound)
        for batch in batches:
            for small in slices(batch, "text"):
                pairs = list(model.run(small.column("text").to_pylist()))
                columns = {
                    "doc_id": small.column("doc_id"),
                    "n_tokens": pa.array([a.count(b",") + 1 if a else 0 for a, _ in pairs],
                                         pa.int64()),
                }
                if not digests_only:
                    columns["ids"] = pa.array([a.decode() for a, _ in pairs], pa.string())
                    columns["decoded"] = pa.array([b.decode() for _, b in pairs], pa.string())
                columns["ids_sha256"] = pa.array(
                    [hashlib.sha256(a).hexdigest() for a, _ in pairs], pa.string())
                columns["decoded_sha256"] = pa.array(
                    [hashlib.sha256(b).hexdigest() for _, b in pairs], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, schema)


def slices(
    batch: pa.RecordBatch, column: str, most: int = 2 << 20
) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``most`` bytes together."""
    values = batch.column(column)
    if not len(values):
        return
    sizes = np.fromiter(
        (0 if n is None else n for n in pa.compute.binary_length(values).to_pylist()),
        np.int64, len(values),
    )
    group = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(values)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)
