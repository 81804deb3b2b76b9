"""A hash table in numpy: many keys are looked up at once."""

from __future__ import annotations

import numpy as np

EMPTY = np.uint64(2**64 - 1)


class Lookup:
    """Values of different keys (below 2**64 - 1); slots are 1.5 to 3 times the keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys = keys.astype(np.uint64)
        bits = max(8, int(len(keys) * 3 // 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, EMPTY), np.zeros(1 << bits, values.dtype)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == EMPTY)
            at, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.keys[at], self.values[at] = keys[placed], values[placed]
            left = np.ones(len(keys), bool)
            left[placed] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys there are; the value of a missing key means nothing."""
        slot = self._slot(keys)
        held, values = self.keys[slot], self.values[slot]
        found = held == keys
        todo = np.flatnonzero(~found & (held != EMPTY))
        while len(todo):
            slot = (slot if len(slot) == len(todo) else slot[todo]) + 1 & self.mask
            held, wanted = self.keys[slot], keys[todo]
            hit = held == wanted
            values[todo[hit]], found[todo[hit]] = self.values[slot[hit]], True
            more = ~hit & (held != EMPTY)
            todo, slot = todo[more], slot[more]
        return values, found
