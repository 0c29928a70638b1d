"""A minimal perfect hash of 128-bit digests in numpy: n keys to the slots 0 to n - 1."""

import numpy as np

from .textops import mix

# Places for each key of a level; more places end in fewer levels.
ROOM = 1.6


def digests(column) -> np.ndarray:
    """(rows, 2) words of a binary Arrow column of 16 bytes a row."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 2)


class Slots:
    """Keys that collide on a level move to the next; a key's slot is the rank of its place.

    The slot of an absent key is anybody's, so the digest kept at a slot verifies each lookup.
    """

    def __init__(self, keys: np.ndarray):
        self.levels, rest, before = [], keys, 0
        while len(rest):
            size = max(8, int(len(rest) * ROOM))
            place = self._place(rest, len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            self.levels.append((size, alone, before + np.cumsum(alone) - 1))
            before += int(alone.sum())
            rest = rest[~alone[place]]
        self.keys = np.zeros((before, 2), np.uint64)
        self.keys[self._slots(keys)] = keys

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        h = mix(keys[:, 0] + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) ^ keys[:, 1]
        return (mix(h) % np.uint64(size)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        slot, left = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for level, (size, alone, rank) in enumerate(self.levels):
            place = self._place(keys[left], level, size)
            hit = alone[place]
            slot[left[hit]] = rank[place[hit]]
            left = left[~hit]
        return slot

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where the digest at its slot is another one."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        slot = self._slots(keys)
        return np.where((self.keys[slot] == keys).all(axis=1), slot, -1)
