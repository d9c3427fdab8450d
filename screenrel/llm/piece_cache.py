"""What a worker keeps of byte strings that it has encoded: an open-addressing hash table, whose hits are compared byte by byte."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from screenrel.llm.textvec import same_bytes

MAX_KNOWN = 1 << 20
TABLE_BITS = 22
MAX_BYTES = 1 << 26


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of consecutive ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.room, self.size = np.zeros(1024, kind), 0

    def reserve(self, n: int) -> None:
        if self.size + n > len(self.room):
            room = np.zeros(max(2 * len(self.room), self.size + n), self.room.dtype)
            room[: self.size] = self.room[: self.size]
            self.room = room

    def add(self, values: np.ndarray) -> None:
        self.reserve(len(values))
        self.room[self.size : self.size + len(values)] = values
        self.size += len(values)


class PieceCache:
    """Distinct pieces with their ids (and the ids in decimal, if asked for); at most MAX_KNOWN pieces of MAX_BYTES in all, then it starts anew.

    A piece whose hash equals that of another piece is found out by comparing bytes and encoded by itself.
    """

    def __init__(self, digits: bool = False):
        self.with_digits = digits
        self.clear()

    def clear(self) -> None:
        self.table = np.zeros(1 << TABLE_BITS, np.int32)
        self.hash, self.length, self.raw_at = Grown(np.uint64), Grown(np.int64), Grown(np.int64)
        self.raw, self.ids, self.digits = Grown(np.uint8), Grown(np.int32), Grown(np.uint8)
        self.id_at, self.id_n, self.digit_at, self.digit_n = (Grown(np.int64) for _ in range(4))

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot with each hash, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        live, at = np.arange(len(hashes)), (hashes & np.uint64(len(self.table) - 1)).astype(np.int64)
        while len(live):
            slot = self.table[at].astype(np.int64) - 1
            hit = (slot >= 0) & (self.hash.room[slot] == hashes[live])
            out[live[hit]] = slot[hit]
            on = (slot >= 0) & ~hit
            live, at = live[on], (at[on] + 1) & (len(self.table) - 1)
        return out

    def _add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """New slots, not yet findable, of some pieces with their ids."""
        size = ends - starts
        slots = self.length.size + np.arange(len(size))
        self.length.add(size)
        self.raw_at.add(self.raw.size + np.cumsum(size) - size)
        self.raw.add(data[spread(starts, size)])
        self.id_at.add(self.ids.size + np.cumsum(n) - n)
        self.id_n.add(n)
        self.ids.add(ids)
        if self.with_digits:
            text = ",".join(map(str, ids.tolist())) + "," if len(ids) else ""
            letters = np.frombuffer(text.encode(), np.uint8)
            stops = np.concatenate([[0], np.flatnonzero(letters == 0x2C) + 1])[np.concatenate([[0], np.cumsum(n)])]
            self.digit_at.add(self.digits.size + stops[:-1])
            self.digit_n.add(np.diff(stops))
            self.digits.add(letters)
        return slots

    def _publish(self, slots: np.ndarray, hashes: np.ndarray) -> None:
        self.hash.add(hashes)
        at = (hashes & np.uint64(len(self.table) - 1)).astype(np.int64)
        while len(slots):
            free = self.table[at] == 0
            self.table[at[free]] = slots[free] + 1
            lost = self.table[at] != slots + 1
            slots, at = slots[lost], (at[lost] + 1) & (len(self.table) - 1)

    def _differ(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Whether each piece differs from the one in its slot, by their bytes."""
        size = ends - starts
        out = size != self.length.room[slots]
        self.raw.reserve(8)
        alike = np.flatnonzero(~out)
        out[alike] = ~same_bytes(data, starts[alike], size[alike], self.raw.room, self.raw_at.room[slots[alike]])
        return out

    def slots_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, encode: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The slot of each piece; new ones are encoded together: encode(indices) gives their ids, one after the other, and the number of each."""
        slots = self._find(hashes)
        unknown = np.flatnonzero(slots < 0)
        if len(unknown):
            fresh, first, inverse = np.unique(hashes[unknown], return_index=True, return_inverse=True)
            if self.length.size + len(fresh) > MAX_KNOWN or self.raw.size > MAX_BYTES:
                self.clear()
                unknown = np.arange(len(hashes))
                fresh, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            which = unknown[first]
            new = self._add(data, starts[which], ends[which], *encode(which))
            self._publish(new, fresh)
            slots[unknown] = new[inverse]
        other = np.flatnonzero(self._differ(data, starts, ends, slots))
        if len(other):
            slots[other] = self._add(data, starts[other], ends[other], *encode(other))
            self.hash.add(np.zeros(len(other), np.uint64))  # these slots are in no table
        return slots

    def ids_of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all slots, one after the other, and the number of each."""
        n = self.id_n.room[slots]
        return self.ids.room[spread(self.id_at.room[slots], n)], n

    def digits_of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same in decimal, each id with a comma after it."""
        n = self.digit_n.room[slots]
        return self.digits.room[spread(self.digit_at.room[slots], n)], n
