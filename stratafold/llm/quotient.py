"""A counting quotient filter in numpy: a multiset of fixed-length fingerprints in sorted order.

A fingerprint of ``bits`` bits is split into a quotient of q bits, which names a home slot,
and the remainder, which is what a slot stores. Remainders of one quotient form a run, in
order; a run that finds its home slot taken starts behind the run before it. Three bits tell
the slots apart: ``occupied`` (some run has this slot as its home), ``last`` (a run ends
here) and ``more`` (the slot goes on with the count of the remainder before it). A remainder
that occurs once takes one slot; other counts follow it as digits.

Nothing is rounded: ``items`` gives back every fingerprint with its exact count, in order, so
filters merge without loss by merging their sorted remainders, whatever their sizes.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

_HEAD = struct.Struct("<BBQ")


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All the places starts[i] .. starts[i] + lengths[i] - 1, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


@dataclass
class CountingQuotientFilter:
    bits: int
    q: int
    occupied: np.ndarray
    last: np.ndarray
    more: np.ndarray
    slots: np.ndarray

    @property
    def r(self) -> int:
        return self.bits - self.q

    @classmethod
    def build(cls, values: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """Of distinct ascending fingerprints (uint64, below 2 ** bits) and their counts, from 1 on."""
        # The quotient is as long as the number of slots asks for; digits have as many bits as remainders.
        q = max(1, min(bits - 16, int(len(values) + np.count_nonzero(counts > 1)).bit_length()))
        r = bits - q
        rest, digits, used = np.where(counts > 1, counts, 0).astype(np.uint64), [], np.zeros(len(values), dtype=np.int64)
        while rest.any():
            digits.append(rest & np.uint64((1 << r) - 1))
            used += rest > 0
            rest = rest >> np.uint64(r)
        heads = np.cumsum(used + 1) - (used + 1)
        n = int((used + 1).sum())
        content, more = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
        content[heads], more[heads] = values & np.uint64((1 << r) - 1), False
        for place, digit in enumerate(digits):
            has = used > place
            content[heads[has] + place + 1] = digit[has]
        home = np.repeat((values >> np.uint64(r)).astype(np.int64), used + 1)
        order = np.arange(n)
        at = order + np.maximum.accumulate(home - order) if n else order
        size = max(1 << q, int(at[-1]) + 1 if n else 0)
        self = cls(bits, q, np.zeros(size, dtype=bool), np.zeros(size, dtype=bool), np.zeros(size, dtype=bool), np.zeros(size, dtype=np.uint64))
        self.slots[at], self.more[at], self.occupied[home] = content, more, True
        self.last[at[np.append(home[1:] != home[:-1], True)[:n]]] = True
        return self

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """All fingerprints in ascending order and their counts."""
        homes, ends = np.flatnonzero(self.occupied), np.flatnonzero(self.last)
        starts = np.maximum(homes, np.append(-1, ends[:-1]) + 1)[: len(homes)]
        at = _ranges(starts, ends - starts + 1)
        home, content, more = np.repeat(homes, ends - starts + 1), self.slots[at], self.more[at]
        heads = np.flatnonzero(~more)
        values = (home[heads].astype(np.uint64) << np.uint64(self.r)) | content[heads]
        entry = np.cumsum(~more) - 1
        place = np.arange(len(at)) - heads[entry] - 1
        counts = np.zeros(len(heads), dtype=np.uint64)
        for k in range(int(place.max()) + 1 if more.any() else 0):
            digit = more & (place == k)
            counts[entry[digit]] |= content[digit] << np.uint64(k * self.r)
        return values, np.where(counts == 0, 1, counts).astype(np.int64)

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """One filter of all fingerprints; counts of the same fingerprint add up."""
        parts = [f.items() for f in filters]
        return cls.of(np.concatenate([v for v, _ in parts]), np.concatenate([c for _, c in parts]), filters[0].bits)

    @classmethod
    def of(cls, values: np.ndarray, counts: np.ndarray | None, bits: int) -> CountingQuotientFilter:
        """Of fingerprints in any order; without counts each occurs once."""
        order = np.argsort(values, kind="stable")  # merges what is sorted in runs
        values = values[order]
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, dtype=np.int64)
        ones = np.ones(len(values), dtype=np.int64) if counts is None else counts[order]
        return cls.build(values[first], np.add.reduceat(ones, first) if len(first) else ones, bits)

    def dumps(self) -> bytes:
        width = -(-self.r // 8)
        flags = b"".join(np.packbits(x).tobytes() for x in (self.occupied, self.last, self.more))
        return _HEAD.pack(self.bits, self.q, len(self.slots)) + flags + self.slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()

    @classmethod
    def loads(cls, data: bytes) -> CountingQuotientFilter:
        bits, q, size = _HEAD.unpack_from(data)
        row, at = -(-size // 8), _HEAD.size
        flags = [np.unpackbits(np.frombuffer(data, np.uint8, row, at + k * row), count=size).astype(bool) for k in range(3)]
        width = -(-(bits - q) // 8)
        slots = np.zeros((size, 8), dtype=np.uint8)
        slots[:, :width] = np.frombuffer(data, np.uint8, size * width, at + 3 * row).reshape(size, width)
        return cls(bits, q, *flags, slots.view("<u8").reshape(-1))
