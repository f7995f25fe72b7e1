"""Counting quotient filters: exact, compact counters of packed word-id n-grams.

An n-gram is a row of ``words`` ids of ``bits`` bits each. An invertible permutation spreads it over
its whole range; the leading bits of the result are the quotient, which is stored in unary by the run
of remainders that belongs to it, and all other bits are the remainder, stored in full. Nothing is
lost, so counts are exact and the ids come back by the inverse permutation (Bender et al. 2012;
Pandey et al. 2017). Filters are sorted by quotient and remainder, and merge like sorted lists.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

ROUNDS = 2
# a count from here on is stored apart in 8 bytes
ESCAPE = 255
_HEADER = struct.Struct("<BBBBIII")
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed invertible mixing of 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def gram_hash(limbs: Sequence[np.ndarray], seed: int) -> np.ndarray:
    found = np.full(len(limbs[0]), seed & (2 ** 64 - 1), _U)
    for limb in limbs:
        found = mix(found ^ limb)
    return found


def _shift(limbs: Sequence[np.ndarray], i: int, turn: int) -> np.ndarray:
    """What the permutation adds to limb i: a hash of all others."""
    return gram_hash([x for j, x in enumerate(limbs) if j != i], turn * len(limbs) + i + 1)


def permute(limbs: Sequence[np.ndarray], bits: int) -> list[np.ndarray]:
    """Each id in turn is moved by a hash of the others, which can be undone in reverse order."""
    limbs, mask = list(limbs), _U(2 ** bits - 1)
    for turn in range(ROUNDS):
        for i in range(len(limbs)):
            limbs[i] = (limbs[i] + _shift(limbs, i, turn)) & mask
    return limbs


def restore(limbs: Sequence[np.ndarray], bits: int) -> list[np.ndarray]:
    limbs, mask = list(limbs), _U(2 ** bits - 1)
    for turn in reversed(range(ROUNDS)):
        for i in reversed(range(len(limbs))):
            limbs[i] = (limbs[i] - _shift(limbs, i, turn)) & mask
    return limbs


def _leading(limbs: Sequence[np.ndarray], bits: int) -> np.ndarray:
    """The first 64 bits of the packed n-gram."""
    if bits == 64:
        return limbs[0]
    found = limbs[0] << _U(64 - bits)
    return found | (limbs[1] >> _U(2 * bits - 64)) if 2 * bits >= 64 else found


@dataclass(frozen=True)
class CountingFilter:
    """Permuted n-grams in ascending order, each once, and their counts."""

    bits: int
    limbs: tuple[np.ndarray, ...]
    counts: np.ndarray

    def __len__(self) -> int:
        return len(self.counts)

    @classmethod
    def of_ids(cls, ids: Sequence[np.ndarray], bits: int) -> "CountingFilter":
        """Count n-grams given as one array of ids per word."""
        if len(ids) < 2 or bits % 8 or not 32 <= bits <= 64:
            raise ValueError("two words or more, with ids of 32, 40, 48, 56 or 64 bits")
        return cls._counted(bits, permute([np.asarray(i, _U) for i in ids], bits),
                            np.ones(len(ids[0]), np.int64))

    @classmethod
    def merge(cls, filters: Sequence["CountingFilter"]) -> "CountingFilter":
        """The filter of all n-grams of all filters; counts of equal ones are added."""
        if len(filters) == 1:
            return filters[0]
        return cls._counted(filters[0].bits,
                            [np.concatenate(x) for x in zip(*[f.limbs for f in filters])],
                            np.concatenate([f.counts for f in filters]))

    @classmethod
    def _counted(cls, bits, limbs, counts) -> "CountingFilter":
        leading = _leading(limbs, bits)
        order = np.argsort(leading)
        found, first = cls._runs(limbs, order)
        same = leading[order][1:] == leading[order][:-1]
        if (same & first[1:]).any():  # different n-grams with equal leading bits
            found, first = cls._runs(limbs, np.lexsort(limbs[::-1]))
            order = np.lexsort(limbs[::-1])
        starts = np.flatnonzero(first)
        totals = np.add.reduceat(counts[order], starts) if len(starts) else counts[:0]
        return cls(bits, tuple(x[starts] for x in found), totals)

    @staticmethod
    def _runs(limbs, order) -> tuple[list[np.ndarray], np.ndarray]:
        found = [x[order] for x in limbs]
        first = np.ones(len(order), bool)
        if len(order) > 1:
            first[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in found])
        return found, first

    def ids(self) -> list[np.ndarray]:
        return restore(self.limbs, self.bits)

    def at_least(self, count: int) -> "CountingFilter":
        enough = self.counts >= count
        return CountingFilter(self.bits, tuple(x[enough] for x in self.limbs),
                              self.counts[enough])

    def count_of(self, ids: Sequence[int]) -> int:
        """The count of one n-gram: 0 if it is not in the filter."""
        key = [int(x[0]) for x in permute([np.array([i], _U) for i in ids], self.bits)]
        lo, hi = 0, len(self)
        for limb, value in zip(self.limbs, key):
            run = limb[lo:hi]
            lo, hi = (lo + int(np.searchsorted(run, _U(value), side))
                      for side in ("left", "right"))
        return int(self.counts[lo]) if lo < hi else 0

    def segments(self, bits: int) -> list[tuple[int, "CountingFilter"]]:
        """Cut by the first ``bits`` of the quotient into (number, part); empty parts are left out."""
        if not bits:
            return [(0, self)] if len(self) else []
        number = (self.limbs[0] >> _U(self.bits - bits)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(self) else []
        return [(int(number[a]), CountingFilter(self.bits, tuple(x[a:b] for x in self.limbs),
                                                self.counts[a:b]))
                for a, b in zip(starts, [*starts[1:], len(self)])]

    def to_bytes(self, segment_bits: int = 0, segment: int = 0) -> bytes:
        """As a table of runs; all n-grams begin with the bits of ``segment``."""
        n, bits = len(self), self.bits
        wide = min(bits - segment_bits, max(0, n - 1).bit_length(), 31)
        low = bits - segment_bits - wide  # bits of the first id that stay in the remainder
        quotient = ((self.limbs[0] >> _U(low) if low < 64 else self.limbs[0] * _U(0)).astype(np.int64)
                    - (segment << wide))
        runs = np.zeros(n + (1 << wide), np.uint8)
        runs[quotient + np.arange(n)] = 1
        first = self.limbs[0] & _U(2 ** low - 1)
        large = self.counts >= ESCAPE
        parts = [np.packbits(runs).tobytes(), _narrow(first, -(-low // 8)),
                 *[_narrow(x, bits // 8) for x in self.limbs[1:]],
                 np.where(large, ESCAPE, self.counts).astype(np.uint8).tobytes(),
                 self.counts[large].astype("<i8").tobytes()]
        return _HEADER.pack(len(self.limbs), bits, segment_bits, wide, segment, n,
                            int(large.sum())) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> "CountingFilter":
        words, bits, segment_bits, wide, segment, n, large = _HEADER.unpack_from(data)
        at, low = _HEADER.size, bits - segment_bits - wide

        def take(size):
            nonlocal at
            at += size
            return np.frombuffer(data, np.uint8, size, at - size)

        runs = np.unpackbits(take(-(-(n + (1 << wide)) // 8)), count=n + (1 << wide))
        quotient = np.flatnonzero(runs) - np.arange(n) + (segment << wide)
        first = _wide(take(n * -(-low // 8)), -(-low // 8), n)
        if low < 64:
            first = first | (quotient.astype(_U) << _U(low))
        rest = [_wide(take(n * bits // 8), bits // 8, n) for _ in range(words - 1)]
        counts = take(n).astype(np.int64)
        counts[counts == ESCAPE] = np.frombuffer(take(8 * large).tobytes(), "<i8")
        return cls(bits, (first, *rest), counts)


def _narrow(values: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(
        values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _wide(data: np.ndarray, size: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = data.reshape(n, size)
    return out.view("<u8").reshape(n).astype(_U)
