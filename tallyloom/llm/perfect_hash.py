"""A minimal perfect hash over 128-bit keys, built and probed with whole-array operations.

Level l hashes the keys still unplaced into gamma * n cells; keys alone in their cell are placed there, the others go to
the next level.  A key's number is the rank of its cell among all used cells, so n keys get the numbers 0..n-1.  About 3.5
bits a key at gamma = 1.6.
"""

from __future__ import annotations

import numpy as np

from .common import mix

GAMMA = 1.6


def _cell(keys: np.ndarray, level: int, cells: int) -> np.ndarray:
    return (mix(mix(keys[:, 0] + np.uint64(level)) ^ keys[:, 1]) % np.uint64(cells)).astype(np.int64)


def build(keys: np.ndarray) -> bytes:
    """`keys`: distinct rows of two unsigned 64-bit integers."""
    sizes, bits = [], []
    level = 0
    while len(keys):
        cells = (int(len(keys) * GAMMA) // 64 + 1) * 64
        at = _cell(keys, level, cells)
        alone = np.bincount(at, minlength=cells) == 1
        sizes.append(cells)
        bits.append(alone)
        keys = keys[~alone[at]]
        level += 1
        if level > 200:
            raise ValueError("keys are not distinct")
    head = np.array([level, *sizes], np.uint32).tobytes()
    return head + (np.packbits(np.concatenate(bits)).tobytes() if bits else b"")


class PerfectHash:
    def __init__(self, data: bytes):
        levels = int(np.frombuffer(data, np.uint32, 1)[0])
        self.sizes = np.frombuffer(data, np.uint32, levels, 4).astype(np.int64)
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=4 + 4 * levels)).astype(bool)
        self.rank = np.cumsum(self.bits, dtype=np.int64) - 1

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the keys; a key outside the set gets any number, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        base = 0
        for level, cells in enumerate(self.sizes):
            at = base + _cell(keys[left], level, int(cells))
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
            base += int(cells)
            if not len(left):
                break
        return out
