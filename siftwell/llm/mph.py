"""A minimal perfect hash over 64-bit keys, built and queried as numpy arrays.

Keys go through levels of bit arrays. A key that has a position of a level for itself stays there; the others go on to the
next level. A key's number is the rank of its bit. About three bits a key.
"""

from __future__ import annotations

import struct

import numpy as np

from .symbols import mix64

GAMMA = 1.6
LEVELS = 40


def _positions(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    """32 bits of a key that tell a foreign key from the one that has its slot (wrong for one in 2**32)."""
    return (mix64(keys ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def build(keys: np.ndarray) -> bytes:
    """The function for distinct keys."""
    left, arrays = keys.astype(np.uint64), []
    while len(left):
        if len(arrays) == LEVELS:
            raise ValueError("keys must be distinct")
        size = -(-max(64, int(GAMMA * len(left))) // 64) * 64
        at = _positions(left, len(arrays), size)
        alone = np.bincount(at, minlength=size) == 1
        arrays.append(np.packbits(alone, bitorder="little"))
        left = left[~alone[at]]
    head = struct.pack("<I", len(arrays)) + b"".join(struct.pack("<Q", len(a) * 8) for a in arrays)
    return head + b"".join(a.tobytes() for a in arrays)


class Mph:
    """The function read from its bytes. ``slots`` gives each key's number below the number of keys, or -1 for some foreign keys."""

    def __init__(self, data: bytes | memoryview):
        (n,) = struct.unpack_from("<I", data)
        self.sizes = struct.unpack_from(f"<{n}Q", data, 4)
        at, self.levels, total = 4 + 8 * n, [], 0
        for size in self.sizes:
            words = np.frombuffer(data, "<u8", size // 64, at)
            before = total + np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((words, before))
            at, total = at + size // 8, int(before[-1])
        self.n_bytes = at

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        found = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, (words, before) in enumerate(self.levels):
            at = _positions(keys[left], k, self.sizes[k])
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            found[left[hit]] = (before[at >> 6] + np.bitwise_count(below))[hit]
            left = left[~hit]
        return found
