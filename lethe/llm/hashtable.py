"""A hash table that answers for many keys at once."""

from __future__ import annotations

import numpy as np


class Table:
    """An open hash table of two arrays: numbers from 0 on to numbers from 0 on."""

    def __init__(self, bits: int):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.int32)
        self.n = 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values of the keys held, -1 for others."""
        slot = self._slots(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        todo = np.flatnonzero((there != keys) & (there >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            at = slot[todo]
            there = self.keys[at]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            todo = todo[~hit & (there >= 0)]
        return out

    def add(self, keys: np.ndarray, values: list[int]) -> None:
        """Keep new keys; a table that would be over half full forgets the old ones."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            self.clear()
        for key, slot, value in zip(keys.tolist(), self._slots(keys).tolist(), values):
            if 2 * self.n > len(self.keys):
                return
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.values[slot] = key, value
            self.n += 1
