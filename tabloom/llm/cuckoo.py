"""A cuckoo filter over 128-bit keys: approximate membership with deletions."""

from __future__ import annotations

import numpy as np

SLOTS = 4
_MAX_KICKS = 500


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; two candidate buckets per key.

    The fingerprint and the first bucket come from different bytes of the key
    (a uniform digest), the second bucket from the first and the fingerprint
    alone, so an entry can move or be deleted without its key. There are no
    false negatives; about 1 key in 8,000 that was never added is reported.
    """

    def __init__(self, capacity: int, cells: np.ndarray | None = None):
        n = 1
        while n * SLOTS * 0.9 < max(capacity, 1):
            n *= 2
        self.cells = np.zeros((n, SLOTS), np.uint16) if cells is None else cells.copy()
        self.mask = len(self.cells) - 1

    @classmethod
    def of(cls, keys) -> "CuckooFilter":
        """A filter of all ``keys``, doubled until it holds them."""
        keys, capacity = list(keys), max(len(keys), 8)
        while True:
            f = cls(capacity)
            if all(f.add(k) for k in keys):
                return f
            capacity *= 2

    def _place(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[4:6], "little") or 1
        first = int.from_bytes(key[6:14], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def add(self, key: bytes) -> bool:
        """Add one reference of ``key``; False when no place was found (rebuild larger)."""
        mark, a, b = self._place(key)
        for bucket in (a, b):
            free = np.flatnonzero(self.cells[bucket] == 0)
            if len(free):
                self.cells[bucket, free[0]] = mark
                return True
        bucket = b
        for kick in range(_MAX_KICKS):
            slot = (kick * 7 + mark) % SLOTS
            mark, self.cells[bucket, slot] = int(self.cells[bucket, slot]), mark
            bucket = self._other(bucket, mark)
            free = np.flatnonzero(self.cells[bucket] == 0)
            if len(free):
                self.cells[bucket, free[0]] = mark
                return True
        return False

    def discard(self, key: bytes) -> bool:
        """Take one entry of ``key`` out; the key must have been added before."""
        mark, a, b = self._place(key)
        for bucket in (a, b):
            slots = np.flatnonzero(self.cells[bucket] == mark)
            if len(slots):
                self.cells[bucket, slots[0]] = 0
                return True
        return False

    def __contains__(self, key: bytes) -> bool:
        mark, a, b = self._place(key)
        return bool((self.cells[a] == mark).any() or (self.cells[b] == mark).any())

    def to_bytes(self) -> bytes:
        return self.cells.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "CuckooFilter":
        return cls(0, np.frombuffer(data, np.uint16).reshape(-1, SLOTS))
