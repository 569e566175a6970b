"""Minimal perfect hash functions over 64-bit keys, with the keys stored: what is no key is told apart."""

from __future__ import annotations

import numpy as np

from notewright.llm.vectext import mix

_STEP = np.uint64(0x9E3779B97F4A7C15)


class PerfectHash:
    """Slots 0 to n - 1 of n different keys. In each layer, keys alone at their place get a slot; the others go to the next."""

    def __init__(self, keys: np.ndarray, spread: float = 2.0):
        self.keys, self.layers = np.empty(len(keys), np.uint64), []
        rest, taken = keys.astype(np.uint64), 0
        while len(rest):
            size = max(int(spread * len(rest)), 8)
            at = self._place(rest, len(self.layers), size)
            count = np.bincount(at, minlength=size)
            slots = np.full(size, -1, np.int32)
            alone = count[at] == 1
            own = at[alone]
            slots[own] = np.arange(taken, taken + len(own), dtype=np.int32)
            self.keys[taken : taken + len(own)] = rest[alone]
            self.layers.append(slots)
            taken += len(own)
            rest = rest[~alone]

    @staticmethod
    def _place(keys: np.ndarray, layer: int, size: int) -> np.ndarray:
        return (mix(keys + _STEP * np.full(1, layer + 1, np.uint64)) % np.uint64(size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for what is none."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for i, slots in enumerate(self.layers):
            if not len(todo):
                break
            found = slots[self._place(keys[todo], i, len(slots))]
            hit = found >= 0
            out[todo[hit]] = found[hit]
            todo = todo[~hit]
        at = np.flatnonzero(out >= 0)
        out[at[self.keys[out[at]] != keys[at]]] = -1
        return out
