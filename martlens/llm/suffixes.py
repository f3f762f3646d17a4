"""Suffix order and longest previous factors of short texts, in numpy.

Texts are compared to a depth of ``depth`` bytes, so suffixes of the same first
``depth`` bytes are equal and follow one another by position.
"""

from __future__ import annotations

import numpy as np


def _dense(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].astype(np.int32)


class SuffixRanks:
    """Order-keeping ranks of the 8, 16, 32, ... bytes from each place of ``flat``."""

    def __init__(self, flat: np.ndarray, depth: int):
        if depth < 8:
            raise ValueError("depth must be at least 8")
        self.flat, self.depth = flat, depth
        padded = np.concatenate([flat, np.zeros(depth + 8, np.uint8)])
        word = np.zeros(len(flat), np.uint64)
        for k in range(8):
            word = (word << np.uint64(8)) | padded[k : k + len(flat)]
        size, rank = 8, _dense(word)
        self.levels = [(size, rank)]
        while size * 2 <= depth:
            rank = self._pair(rank, rank, size)
            size *= 2
            self.levels.append((size, rank))
        self.full = self._pair(rank, rank, depth - size) if size < depth else rank

    @staticmethod
    def _pair(left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
        key = left.astype(np.int64) * (int(right.max(initial=0)) + 1)
        key[: max(0, len(key) - shift)] += right[shift:]
        return _dense(key)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the texts from places ``a`` and ``b`` share at their start, to depth."""
        got = np.zeros(len(a), np.int64)
        for size, rank in reversed(self.levels):
            while True:
                room = got + size <= self.depth
                at = np.flatnonzero(room)
                same = at[rank[a[at] + got[at]] == rank[b[at] + got[at]]]
                if not len(same):
                    break
                got[same] += size
                if size == self.levels[0][0]:
                    break
        for _ in range(self.levels[0][0]):
            at = np.flatnonzero(got < self.depth)
            same = at[self.flat[a[at] + got[at]] == self.flat[b[at] + got[at]]]
            # a mismatch stays a mismatch: later rounds compare the same bytes again
            if not len(same):
                break
            got[same] += 1
        return got


def previous_smaller(place: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry in suffix order the nearest earlier entry of a smaller place.

    ``shared[r]`` is what entries r - 1 and r have in common.  Returns that entry (-1 if
    none) and what both have in common, found by jumping along the entries between.
    """
    before = np.arange(len(place)) - 1
    low = shared.copy()
    if len(low):
        low[0] = 0
    active = np.flatnonzero((before >= 0) & (place[np.maximum(before, 0)] > place))
    while len(active):
        over = before[active]
        new_low, new_before = np.minimum(low[active], low[over]), before[over]
        low[active], before[active] = new_low, new_before
        left = (new_before >= 0) & (place[np.maximum(new_before, 0)] > place[active])
        active = active[left]
    low[before < 0] = 0
    return before, low


def longest_previous(flat: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Longest match of the text at each place with one that starts at an earlier place.

    ``places`` ascend; each has ``depth`` bytes of ``flat`` after it.  Matches count to
    ``depth`` bytes.  In suffix order the best earlier match of a place is its previous or
    its next entry of a smaller place.
    """
    if not len(places):
        return np.empty(0, np.int64)
    ranks = SuffixRanks(flat, depth)
    order = np.argsort(ranks.full[places], kind="stable")  # equal suffixes by place
    sorted_places = places[order]
    shared = np.zeros(len(order), np.int64)
    shared[1:] = ranks.common(sorted_places[:-1], sorted_places[1:])
    _, left = previous_smaller(sorted_places, shared)
    # the same from the other end: entry r and its right neighbour share shared[r + 1]
    _, right = previous_smaller(sorted_places[::-1], np.append(0, shared[1:][::-1]))
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(left, right[::-1])
    return out
