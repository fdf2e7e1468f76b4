"""A cuckoo filter over 64-bit keys: buckets of four 16-bit fingerprints, insertion and deletion."""

from __future__ import annotations

import numpy as np

SLOTS = 4
KICKS = 500
_MASK = (1 << 64) - 1


def _scramble(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _MASK
    return x ^ (x >> 31)


class CuckooFilter:
    """No false negatives among inserted keys; a false positive has a chance of about 8 / 65536."""

    def __init__(self, capacity: int = 64):
        n = 1
        while n * SLOTS * 0.85 < max(capacity, 1):
            n *= 2
        self.buckets = [[] for _ in range(n)]
        self.size = 0

    def _place(self, key: int) -> tuple[int, int, int]:
        h = _scramble(key & _MASK)
        f = (h >> 48) or 1
        i = h & (len(self.buckets) - 1)
        return f, i, (i ^ _scramble(f)) & (len(self.buckets) - 1)

    def __contains__(self, key: int) -> bool:
        f, i, j = self._place(key)
        return f in self.buckets[i] or f in self.buckets[j]

    def insert(self, key: int) -> bool:
        """False if the filter is full; the caller then builds a larger one from its exact keys."""
        f, i, j = self._place(key)
        for k in (i, j):
            if len(self.buckets[k]) < SLOTS:
                self.buckets[k].append(f)
                self.size += 1
                return True
        k, undo = i, []
        for n in range(KICKS):
            b = self.buckets[k]
            f, b[n % SLOTS] = b[n % SLOTS], f
            undo.append((k, n % SLOTS))
            k = (k ^ _scramble(f)) & (len(self.buckets) - 1)
            if len(self.buckets[k]) < SLOTS:
                self.buckets[k].append(f)
                self.size += 1
                return True
        for k, slot in reversed(undo):
            b = self.buckets[k]
            f, b[slot] = b[slot], f
        return False

    def delete(self, key: int) -> bool:
        f, i, j = self._place(key)
        for k in (i, j):
            if f in self.buckets[k]:
                self.buckets[k].remove(f)
                self.size -= 1
                return True
        return False

    def to_bytes(self) -> bytes:
        out = np.zeros((len(self.buckets), SLOTS), "<u2")
        for i, b in enumerate(self.buckets):
            out[i, : len(b)] = b
        return out.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        out = cls.__new__(cls)
        table = np.frombuffer(data, "<u2").reshape(-1, SLOTS).tolist()
        out.buckets = [[f for f in b if f] for b in table]
        out.size = sum(map(len, out.buckets))
        return out

    @classmethod
    def of(cls, keys: list[int], room: float = 1.5) -> CuckooFilter:
        """A filter with all the keys, as large as that takes."""
        capacity = int(len(keys) * room) + 16
        while True:
            out = cls(capacity)
            if all(map(out.insert, keys)):
                return out
            capacity *= 2
