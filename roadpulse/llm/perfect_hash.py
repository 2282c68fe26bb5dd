"""Minimal perfect hash over the 128-bit digests of one shard, as flat arrays.

Keys that fall alone into a place of a bit table get it; the others go on to the
next, smaller table. A key's slot is the number of places taken before its own, so
``n`` keys have the slots 0 to ``n - 1``. A key that is not in the shard may fall on a
taken place, so ``find`` compares the digest stored in the slot with the key asked for.
"""

from __future__ import annotations

import numpy as np

from .common import mix64

ROOM = 2  # places for each key of a table
_STEP = 0x9E3779B97F4A7C15


class Slots:
    def __init__(self, depth: np.ndarray, high: np.ndarray, low: np.ndarray):
        """Keys (depth, high, low) are distinct."""
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        n, left, taken = len(depth), np.arange(len(depth)), 0
        self.slot = np.full(n, -1, dtype=np.int64)
        while len(left):
            size = ROOM * len(left)
            at = self._place(len(self.tables), size, depth[left], high[left], low[left])
            alone = np.bincount(at, minlength=size) == 1
            rank = taken + np.cumsum(alone) - alone
            self.tables.append((alone, rank))
            own = alone[at]
            self.slot[left[own]] = rank[at[own]]
            taken += int(own.sum())
            left = left[~own]
        self.keys = [np.empty_like(k) for k in (depth, high, low)]
        for stored, k in zip(self.keys, (depth, high, low)):
            stored[self.slot] = k

    @staticmethod
    def _place(table: int, size: int, depth, high, low) -> np.ndarray:
        seed = np.uint64((table + 1) * _STEP % 2**64)
        x = mix64(high.view(np.uint64) + seed) ^ low.view(np.uint64)
        return (mix64(x + depth.astype(np.uint64)) % np.uint64(size)).astype(np.int64)

    def find(self, depth: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for one that is not in the shard."""
        out = np.full(len(depth), -1, dtype=np.int64)
        left = np.arange(len(depth))
        for k, (alone, rank) in enumerate(self.tables):
            at = self._place(k, len(alone), depth[left], high[left], low[left])
            hit = alone[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        got = np.flatnonzero(out >= 0)
        same = np.ones(len(got), dtype=bool)
        for stored, k in zip(self.keys, (depth, high, low)):
            same &= stored[out[got]] == k[got]
        out[got[~same]] = -1
        return out
