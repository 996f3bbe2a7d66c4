"""A counting quotient filter over 64-bit fingerprints, in numpy.

A fingerprint's high bits (the quotient) name a run, its low bits (the remainder) are kept in that run in ascending
order, each with its count. As quotient and remainder together are the whole fingerprint, nothing is lost: two filters
over the same bits merge by merging their runs' sorted remainders and adding counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class CountingQuotientFilter:
    """runs[q] is the number of remainders with quotient q; remainders and counts are run after run, ascending."""

    quotient_bits: int
    remainder_bits: int
    runs: np.ndarray
    remainders: np.ndarray
    counts: np.ndarray

    @classmethod
    def build(cls, prints: np.ndarray, quotient_bits: int, bits: int = 64, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        """Of fingerprints of `bits` bits; repeated ones are counted. An empty array gives an empty filter."""
        rest = bits - quotient_bits
        prints = np.asarray(prints, dtype=np.uint64)
        counts = np.ones(len(prints), np.int64) if counts is None else np.asarray(counts, np.int64)
        order = np.argsort(prints, kind="stable")
        prints, counts = prints[order], counts[order]
        first = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]]) if len(prints) else np.zeros(0, np.int64)
        counts = np.add.reduceat(counts, first) if len(prints) else counts
        prints = prints[first]
        quotients = (prints >> np.uint64(rest)).astype(np.int64) if quotient_bits else np.zeros(len(prints), np.int64)
        mask = np.uint64((1 << rest) - 1)
        return cls(quotient_bits, rest, np.bincount(quotients, minlength=1 << quotient_bits).astype(np.int64), prints & mask, counts)

    def prints(self) -> np.ndarray:
        """The distinct fingerprints, ascending."""
        quotients = np.repeat(np.arange(len(self.runs), dtype=np.uint64), self.runs)
        return (quotients << np.uint64(self.remainder_bits)) | self.remainders if self.quotient_bits else self.remainders

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Both filters' multiset."""
        both = np.concatenate([self.prints(), other.prints()]), np.concatenate([self.counts, other.counts])
        return self.build(both[0], self.quotient_bits, self.quotient_bits + self.remainder_bits, both[1])

    def count(self, prints: np.ndarray) -> np.ndarray:
        """How often each fingerprint was put in (0: never)."""
        own, prints = self.prints(), np.asarray(prints, np.uint64)
        at = np.searchsorted(own, prints)
        hit = at < len(own)
        hit[hit] = own[at[hit]] == prints[hit]
        out = np.zeros(len(prints), np.int64)
        out[hit] = self.counts[at[hit]]
        return out

    def to_bytes(self) -> bytes:
        """A header, one byte per run (occupied or not), run lengths of occupied runs, remainders, counts above one."""
        occupied = np.flatnonzero(self.runs).astype("<u4")
        many = np.flatnonzero(self.counts > 1).astype("<u4")
        head = np.array([self.quotient_bits, self.remainder_bits, len(occupied), len(self.remainders), len(many)], "<i8")
        return b"".join([head.tobytes(), occupied.tobytes(), self.runs[occupied].astype("<u4").tobytes(), self.remainders.astype("<u8").tobytes(), many.tobytes(), self.counts[many].astype("<i8").tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        q, r, n_runs, n, n_many = map(int, np.frombuffer(data, "<i8", 5))
        at = 40
        occupied = np.frombuffer(data, "<u4", n_runs, at)
        lengths = np.frombuffer(data, "<u4", n_runs, at := at + 4 * n_runs)
        remainders = np.frombuffer(data, "<u8", n, at := at + 4 * n_runs)
        many = np.frombuffer(data, "<u4", n_many, at := at + 8 * n)
        runs, counts = np.zeros(1 << q, np.int64), np.ones(n, np.int64)
        runs[occupied] = lengths
        counts[many] = np.frombuffer(data, "<i8", n_many, at + 4 * n_many)
        return cls(q, r, runs, remainders.astype(np.uint64), counts)
