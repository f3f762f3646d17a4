"""A minimal perfect hash over distinct 128-bit keys, built and probed in numpy.

Level by level, keys that meet no other key in a bit array of about ``SPREAD`` bits a
key keep their bit; the others go on to the next level.  A key's slot is the number of
set bits before its own, so n keys get the slots 0 .. n - 1.
"""

from __future__ import annotations

import struct

import numpy as np

SPREAD = 2.0


def mix(hi: np.ndarray, lo: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of each key, another one for each level."""
    x = lo ^ (hi * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(level * 0xD1B54A32D192ED03 % 2**64)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class MinimalHash:
    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before, total = [], 0
        for bits in levels:
            self.before.append(np.cumsum(bits, dtype=np.int64) - bits + total)
            total += int(bits.sum())
        self.size = total

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray) -> MinimalHash:
        """``hi`` and ``lo`` are unsigned 64-bit halves of distinct keys."""
        levels: list[np.ndarray] = []
        while len(hi):
            if len(levels) == 200:
                raise ValueError("keys are not distinct")
            width = max(64, int(SPREAD * len(hi)))
            at = (mix(hi, lo, len(levels)) % np.uint64(width)).astype(np.int64)
            alone = np.bincount(at, minlength=width) == 1
            levels.append(alone)
            rest = ~alone[at]
            hi, lo = hi[rest], lo[rest]
        return cls(levels)

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The slot of each key; a key that was not built in gets any slot or -1."""
        out = np.full(len(hi), -1, np.int64)
        left = np.arange(len(hi))
        for level, (bits, before) in enumerate(zip(self.levels, self.before, strict=True)):
            if not len(left):
                break
            at = (mix(hi[left], lo[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = before[at[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = [len(bits) for bits in self.levels]
        head = struct.pack(f"<I{len(sizes)}Q", len(sizes), *sizes)
        return head + b"".join(np.packbits(bits).tobytes() for bits in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> MinimalHash:
        (n,) = struct.unpack_from("<I", data)
        sizes = struct.unpack_from(f"<{n}Q", data, 4)
        levels, at = [], 4 + 8 * n
        for size in sizes:
            part = np.frombuffer(data, np.uint8, -(-size // 8), at)
            levels.append(np.unpackbits(part, count=size).astype(bool))
            at += -(-size // 8)
        return cls(levels)
