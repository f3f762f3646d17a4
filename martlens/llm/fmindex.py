"""A bidirectional FM-index over distinct words, searched for words at one edit.

The index is the cyclic text ``$word$word...`` of the words in sorted order, and a second
one of the reversed words.  A pattern is a pair of suffix-rank intervals, one in each, which
are kept in step: growing the pattern at one end looks up that side's transformed text and
shifts the other interval by the smaller letters counted there.  All queries of a call move
together; a state is a row of flat arrays.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np

PACKED = 10  # letters in the first sort key


class _Bits:
    """A bit vector with the number of ones before each place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.zeros = len(bits) - int(ones.sum())

    def rank0(self, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return at - self.before[block] - np.bitwise_count(self.words[block] & low)


class _Letters:
    """A wavelet matrix: per letter how often it, and smaller ones, occur in an interval."""

    def __init__(self, letters: np.ndarray, size: int):
        self.depth = max(1, int(size - 1).bit_length())
        self.levels = []
        rest = letters
        for shift in range(self.depth - 1, -1, -1):
            bit = (rest >> shift) & 1 == 1
            self.levels.append(_Bits(bit))
            rest = np.concatenate([rest[~bit], rest[bit]])
        counts = np.bincount(letters, minlength=size)
        # a letter's first suffix rank less its place in the last level
        self.shift = np.cumsum(counts) - counts
        at = np.zeros(size, np.int64)
        for level, shift in zip(self.levels, range(self.depth - 1, -1, -1), strict=True):
            zero = level.rank0(at)
            at = np.where((np.arange(size) >> shift) & 1 == 1, level.zeros + at - zero, zero)
        self.shift -= at

    def step(self, letter: np.ndarray, low: np.ndarray, high: np.ndarray):
        """The interval after ``letter``, and the smaller letters counted in the old one."""
        less = np.zeros(len(low), np.int64)
        for level, shift in zip(self.levels, range(self.depth - 1, -1, -1), strict=True):
            low0, high0 = level.rank0(low), level.rank0(high)
            one = (letter >> shift) & 1 == 1
            less += np.where(one, high0 - low0, 0)
            low = np.where(one, level.zeros + low - low0, low0)
            high = np.where(one, level.zeros + high - high0, high0)
        move = self.shift[letter]
        return low + move, high + move, less

    def split(self, low: np.ndarray, high: np.ndarray):
        """All letters of each interval: (interval number, letter, new low, new high, less)."""
        owner, letter = np.arange(len(low)), np.zeros(len(low), np.int64)
        less = np.zeros(len(low), np.int64)
        for level in self.levels:
            low0, high0 = level.rank0(low), level.rank0(high)
            zero, one = high0 > low0, high - low > high0 - low0
            less = np.concatenate([less[zero], (less + high0 - low0)[one]])
            letter = np.concatenate([letter[zero] << 1, (letter[one] << 1) | 1])
            owner = np.concatenate([owner[zero], owner[one]])
            low, high = (
                np.concatenate([low0[zero], (level.zeros + low - low0)[one]]),
                np.concatenate([high0[zero], (level.zeros + high - high0)[one]]),
            )
        move = self.shift[letter]
        return owner, letter, low + move, high + move, less


def _transformed(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The letters before all rotations of ``flat`` in sorted order.

    Every word begins with letter 0 at its place in ``starts``, and words ascend.  Rotations
    equal to the end of their word go by the next word, whose number is its order: one
    stable sort by packed letters settles them, ties of longer ends are sorted further.
    """
    total, n = len(flat), len(starts)
    bits = max(1, int(flat.max(initial=1)).bit_length())
    letters = min(PACKED, 62 // bits)
    sizes = np.diff(np.append(starts, total))
    ends = np.repeat(starts + sizes, sizes)  # where the next word's 0 stands
    padded = np.append(flat, np.zeros(letters + 1, flat.dtype))

    def key(at: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for k in range(letters):
            here = np.minimum(at + k, total)
            out = (out << bits) | np.where(at + k < end, padded[here], 0)
        return out

    # by the number of the following word: the last word is followed by the first
    order = np.roll(np.arange(total), sizes[-1] if n else 0)
    rank_of_next = np.empty(total, np.int64)
    rank_of_next[order] = np.arange(total)
    first = key(np.arange(total), ends)
    order = order[np.argsort(first[order], kind="stable")]
    group = np.cumsum(np.append(False, first[order[1:]] != first[order[:-1]]))
    done = letters
    while True:
        tied = np.append(False, group[1:] == group[:-1])
        tied |= np.append(tied[1:], False)
        at = np.flatnonzero(tied & (ends[order] - order >= done))
        if not len(at):
            break
        # only ends that what is compared so far does not end; others are equal and in order
        more = key(order[at] + done, ends[order[at]])
        inner = np.lexsort((rank_of_next[order[at]], more, group[at]))
        order[at] = order[at][inner]
        more, own = more[inner], group[at]
        split = np.append(False, (own[1:] != own[:-1]) | (more[1:] != more[:-1]))
        fresh = np.zeros(total, np.int64)
        fresh[at] = split
        group = np.cumsum(np.append(False, group[1:] != group[:-1]) | (fresh > 0))
        done += letters
    return flat[order - 1]


class _Side:
    def __init__(self, words: Sequence[str], codes: np.ndarray):
        text = "".join(["\0" + w for w in words])
        flat = np.searchsorted(codes, np.frombuffer(text.encode("utf-32-le"), "<u4"))
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = np.cumsum(sizes) - sizes
        self.letters = _Letters(_transformed(flat, starts), len(codes))


class State(NamedTuple):
    """Per state its query, letters of it read, and the intervals on both sides."""

    query: np.ndarray
    read: np.ndarray
    low: np.ndarray
    other: np.ndarray
    size: np.ndarray

    def at(self, chosen: np.ndarray) -> State:
        return State(*[x[chosen] for x in self])

    def plus(self, more: State) -> State:
        return State(*[np.concatenate(pair) for pair in zip(self, more, strict=True)])


class WordIndex:
    """Finds, for each query word, the indexed words that differ by exactly one edit."""

    def __init__(self, words: Sequence[str]):
        self.words = sorted(set(words))
        letters = np.frombuffer("".join(self.words).encode("utf-32-le"), "<u4")
        self.codes = np.append(np.uint32(0), np.unique(letters))
        backward = sorted(w[::-1] for w in self.words)
        self.forward = _Side(self.words, self.codes)
        self.backward = _Side(backward, self.codes)
        number = {w: i for i, w in enumerate(self.words)}
        self.back_number = np.array([number[w[::-1]] for w in backward], np.int64)

    def near(self, queries: Sequence[str], half: str) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query number, number in ``words``) at exactly one edit.

        ``half`` "left": the query's first half is exact and the edit lies after it;
        "right": the second half is exact, the edit lies before it, and words that start
        with the first half are left out.  Together both give every such word once.
        """
        if not self.words or not len(queries):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if half == "left":
            return self._search(list(queries), [len(q) // 2 for q in queries],
                                self.forward, self.backward)
        turned = [q[::-1] for q in queries]
        query, rank = self._search(turned, [len(q) - len(q) // 2 for q in queries],
                                   self.backward, self.forward)
        number = self.back_number[rank]
        keep = [not self.words[b].startswith(queries[a][: len(queries[a]) // 2])
                for a, b in zip(query.tolist(), number.tolist(), strict=True)]
        keep = np.array(keep, bool)
        return query[keep], number[keep]

    def _search(self, queries, halves, own: _Side, other: _Side):
        """Match ``halves`` letters and the delimiter before them, then extend to the right.

        The half grows to the left through ``own``, the rest to the right through
        ``other``.  Each way to edit is taken in one place only: a letter is inserted
        where the next one differs, and of a run of equal letters the first is deleted.
        """
        sizes = np.fromiter(map(len, queries), np.int64, len(queries))
        # one zero ends every query: the delimiter, and a stop for reads past the end
        text = "".join([q + "\0" for q in queries])
        raw = np.frombuffer(text.encode("utf-32-le"), "<u4")
        flat = np.searchsorted(self.codes, raw)
        flat[flat == len(self.codes)] = 0
        unknown = self.codes[flat] != raw  # letters that no indexed word has
        flat = np.where(unknown, -1, flat)
        start = np.cumsum(sizes + 1) - sizes - 1
        halves = np.asarray(halves, np.int64)

        total = sum(len(w) + 1 for w in self.words)
        n = len(queries)
        zero = np.zeros(n, np.int64)
        state = State(np.arange(n), halves.copy(), zero, zero.copy(), np.full(n, total))
        done = []
        left = halves.copy()  # letters of the half still to match; then the delimiter
        while len(state.query):
            left = left - 1
            letter = np.where(left >= 0, flat[start[state.query] + np.maximum(left, 0)], 0)
            state, kept = _grow(state, letter, own, leftward=True)
            left = left[kept]
            over = left < 0
            if over.any():
                done.append(state.at(over))
                state, left = state.at(~over), left[~over]
        exact = done[0] if done else state
        for more in done[1:]:
            exact = exact.plus(more)

        edited = state.at(np.empty(0, np.int64))
        hits_query, hits_rank = [], []
        while len(exact.query) or len(edited.query):
            # states with their edit go on without one, to the delimiter
            letter = flat[start[edited.query] + edited.read]
            ended = edited.read == sizes[edited.query]
            edited, kept = _grow(edited, letter, other)
            ended = ended[kept]
            hits_query.append(edited.query[ended])
            hits_rank.append(edited.low[ended])
            edited = edited.at(~ended)._replace(read=edited.read[~ended] + 1)

            here = start[exact.query] + exact.read
            letter, more = flat[here], exact.read < sizes[exact.query]
            before = flat[np.maximum(here - 1, 0)]
            skip = more & ((letter != before) | (exact.read == 0) | (exact.read == halves[exact.query]))
            deleted = exact.at(skip)._replace(read=exact.read[skip] + 1)

            owner, found, low, high, less = other.letters.split(
                exact.other, exact.other + exact.size
            )
            child = State(exact.query[owner], exact.read[owner], exact.low[owner] + less, low,
                          high - low)
            wanted, inner = letter[owner], found != 0
            differs = (found != wanted) & inner
            inserted = child.at(differs)
            swap = differs & more[owner]
            swapped = child.at(swap)._replace(read=child.read[swap] + 1)
            edited = edited.plus(deleted).plus(inserted).plus(swapped)
            same = (found == wanted) & inner & more[owner]
            exact = child.at(same)._replace(read=child.read[same] + 1)
        return np.concatenate(hits_query), np.concatenate(hits_rank)


def _grow(state: State, letter: np.ndarray, side: _Side, leftward: bool = False):
    """States whose pattern grows by their letter, and which of the given ones they are."""
    known = np.flatnonzero(letter >= 0)
    state, letter = state.at(known), letter[known]
    begin = state.low if leftward else state.other
    low, high, less = side.letters.step(letter, begin, begin + state.size)
    alive = np.flatnonzero(high > low)
    size = (high - low)[alive]
    if leftward:
        grown = State(state.query[alive], state.read[alive], low[alive],
                      (state.other + less)[alive], size)
    else:
        grown = State(state.query[alive], state.read[alive], (state.low + less)[alive],
                      low[alive], size)
    return grown, known[alive]
