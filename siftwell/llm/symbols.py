"""Texts as flat numpy arrays: words and bytes of many documents at once, and rolling 64-bit hashes of their windows.

Everything works on the buffers of an Arrow string array. A word's value is its XXH3 hash of 64 bits, by a seed. Rolling hashes are
polynomials modulo 2**64 over symbol values: they only deal windows out, since texts can be built that share them; what they bring
together is compared, or told apart by a hash of 128 bits under a seed that the job has drawn. All are the same in every process and
on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: A random value for each byte.
BYTE_VALUES = mix64((np.arange(256, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15))
_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


class Rolling:
    """Hashes of any ranges of a sequence of 64-bit symbol values."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all windows of ``size`` symbols, whatever documents they cross."""
        n = len(self.sums) - 1 - size + 1
        return mix64((self.sums[size:] - self.sums[: n]) * self.down[:n]) if n > 0 else np.zeros(0, U64)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after the other, and where each begins (one more entry than texts). Null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and len(texts) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text, one row at least: what is worked on at once stays small."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    ends = np.cumsum(lengths)
    begin = 0
    while begin < len(lengths):
        limit = (ends[begin - 1] if begin else 0) + most
        end = max(begin + 1, int(np.searchsorted(ends, limit, "right")))
        yield begin, end
        begin = end


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def spelled(dictionary: pa.Array) -> list[bytes]:
    """The entries of a large_binary array without nulls (slices of its buffer: several times faster than ``to_pylist``)."""
    _, offsets, data = dictionary.buffers()
    edges = np.frombuffer(offsets, np.int64)[: len(dictionary) + 1].tolist() if len(dictionary) else [0]
    data = data.to_pybytes() if data is not None else b""
    return [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def word_hashes(spellings: list[bytes], seed: int = 0) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter((xxh3_64_intdigest(x, seed) for x in spellings) if seed else map(xxh3_64_intdigest, spellings), np.uint64, len(spellings))


class Words:
    """The words (runs of anything but ASCII white space) of a run of documents, as positions in their bytes."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.data, self.offsets = text_buffers(texts)
        if lower:
            self.data = _LOWER[self.data]
        inside = self.inside = ~_SPACE[self.data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edge = self.offsets[1:-1]
        edge = edge[edge < len(inside)]
        first[edge] |= inside[edge]
        self.starts = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edge = self.offsets[1:-1]
        edge = edge[edge > 0] - 1
        last[edge] |= inside[edge]
        self.ends = np.flatnonzero(last) + 1
        #: Of each document: the number of its first word; one more entry than documents.
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.bounds)

    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """Of each word the number of its spelling, in order of first occurrence; and the spellings (see ``spelled``)."""
        offsets = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
        letters = pa.py_buffer(np.ascontiguousarray(self.data[self.inside]))
        found = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(offsets), letters]).dictionary_encode()
        return np.asarray(found.indices).astype(np.int64), found.dictionary

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; each spelling is hashed once."""
        codes, spellings = self.codes()
        return word_hashes(spelled(spellings), seed)[codes]

    def window_starts(self, size: int) -> np.ndarray:
        """For each word but the last ``size`` - 1 of all: whether a window of ``size`` words of one document starts at it."""
        n = len(self.starts) - size + 1
        if n <= 0:
            return np.zeros(0, bool)
        left = np.repeat(self.bounds[1:], self.counts) - np.arange(len(self.starts))
        return left[:n] >= size


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The minimum of each ``size`` neighbours: running minima from both ends of blocks, so the size costs nothing."""
    n = len(values) - size + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // size) * size, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, size)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[size - 1 : size - 1 + n])
