"""Minimal perfect hash over distinct 128-bit keys, with a fingerprint and a count by slot.

Keys are placed in levels: a level is an array of bits about ``GAMMA`` times as long as the keys
still without a place, a key that alone hashes to a bit takes it, the others go on to the next
level. The slot of a key is the number of bits set before its own, so n keys have the slots
0 to n-1 and need some three bits each. A key that was never put in ends on an unset bit or on
the slot of another key, whose fingerprint (64 of its 128 bits) differs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from millrace.llm.hashing import mixed

GAMMA = 2.0
#: Bytes of one key in memory: fingerprint, count, bits and ranks.
KEY_BYTES = 13

SHARDS = "shard int, levels array<int>, bits binary, fingerprints binary, counts binary"
_KINDS = (pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary())


def _places(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    """Bit of each key in a level of ``size`` bits."""
    seed = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))
    spread = mixed(low ^ mixed(high + seed))
    return ((spread >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)


def shard_of(low: np.ndarray, shards: int) -> np.ndarray:
    return (((low >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int32)


class CountShard:
    """Counts by key for the keys of one shard."""

    def __init__(self, levels: list[int], bits: np.ndarray, fingerprints: np.ndarray, counts: np.ndarray):
        self.levels, self.bits, self.fingerprints, self.counts = levels, bits, fingerprints, counts
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.uint32)])[:-1].astype(np.uint32)

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> CountShard:
        levels, parts = [], []
        left = np.arange(len(high))
        while len(left):
            size = max(64, -(-int(GAMMA * len(left)) // 64) * 64)
            places = _places(high[left], low[left], len(levels), size)
            alone = np.bincount(places.astype(np.int64), minlength=size)[places] == 1
            taken = np.zeros(size, bool)
            taken[places[alone]] = True
            parts.append(np.packbits(taken, bitorder="little").view(np.uint64))
            levels.append(size)
            left = left[~alone]
        width = np.uint32 if counts.max(initial=0) < 1 << 32 else np.uint64
        bits = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        shard = cls(levels, bits, np.zeros(len(high), np.uint64), np.zeros(len(high), width))
        slots = shard.slots(high, low)
        shard.fingerprints[slots], shard.counts[slots] = high, counts
        return shard

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Slot of each key, or -1 where no level has its bit; other keys than those put in may get one."""
        slots, left, begin = np.full(len(high), -1, np.int64), np.arange(len(high)), 0
        for level, size in enumerate(self.levels):
            if not len(left):
                break
            places = _places(high[left], low[left], level, size) + np.uint64(begin)
            words, at = places >> np.uint64(6), places & np.uint64(63)
            word = self.bits[words]
            there = (word >> at) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << at) - np.uint64(1))
            slots[left[there]] = (self.ranks[words] + np.bitwise_count(below))[there]
            left, begin = left[~there], begin + size
        return slots

    def lookup(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Count of each key, 0 for keys that were not put in."""
        slots = self.slots(high, low)
        found = np.flatnonzero(slots >= 0)
        found = found[self.fingerprints[slots[found]] == high[found]]
        counts = np.zeros(len(high), np.int64)
        counts[found] = self.counts[slots[found]]
        return counts

    def row(self, number: int) -> pa.Table:
        """The shard as a row of ``SHARDS``."""
        values = (number, self.levels, self.bits.tobytes(), self.fingerprints.tobytes(), self.counts.tobytes())
        names = [part.split()[0] for part in SHARDS.split(", ")]
        return pa.table([pa.array([v], kind) for v, kind in zip(values, _KINDS)], names=names)

    @classmethod
    def of_row(cls, levels: list[int], bits: bytes, fingerprints: bytes, counts: bytes) -> CountShard:
        keys = len(fingerprints) // 8
        width = np.uint32 if len(counts) == 4 * keys else np.uint64
        return cls(
            list(levels), np.frombuffer(bits, np.uint64), np.frombuffer(fingerprints, np.uint64),
            np.frombuffer(counts, width),
        )


class CountIndex:
    """All shards, for one process."""

    def __init__(self, number: int, shards: dict[int, CountShard]):
        self.number, self.shards = number, shards

    def lookup(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        counts = np.zeros(len(high), np.int64)
        own = shard_of(low, self.number)
        for number in np.unique(own).tolist():
            if number in self.shards:
                at = np.flatnonzero(own == number)
                counts[at] = self.shards[number].lookup(high[at], low[at])
        return counts
