"""Look-up of 64-bit keys in bulk, for use in tasks."""

from __future__ import annotations

import numpy as np

U = np.uint64


class Table:
    """Numbers by key, in open addressing; at() gives each key's place, -1 where it is missing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.slots, self.owner = np.full(1 << self.bits, ~U(0)), np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys)), self.home(keys)
        while len(left):
            free = self.owner[at] < 0
            self.owner[at[free]] = left[free]  # of several that want a slot, one gets it
            self.slots[at[free]] = keys[left[free]]
            lost = self.owner[at] != left
            left, at = left[lost], at[lost] + 1 & self.mask

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def at(self, keys: np.ndarray) -> np.ndarray:
        out, at, left = np.full(len(keys), -1, np.int32), self.home(keys), None
        while len(at):
            owner, same = self.owner[at], self.slots[at] == keys
            hit, on = same & (owner >= 0), ~same & (owner >= 0)
            where = np.flatnonzero(hit)
            out[where if left is None else left[where]] = owner[where]
            go = np.flatnonzero(on)
            left = go if left is None else left[go]
            keys, at = keys[go], at[go] + 1 & self.mask
        return out
