"""Array kernels over Arrow text batches.

Texts are handled as UTF-8 bytes in chunks of whole documents. Everything here works on
NumPy arrays of one chunk, so the memory of a task is bounded by the chunk (or by the
longest single document), not by the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21

#: Word separators: space and TAB, LF, VT, FF, CR.
IS_SEPARATOR = np.zeros(256, dtype=bool)
IS_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so invertible modulo 2**64
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(maxsize=1)
def _byte_codes() -> np.ndarray:
    """A fixed random 64-bit value for each byte."""
    return np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 64, 256, dtype=np.uint64)


@lru_cache(maxsize=2)
def _powers(log_size: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << log_size
    forward, backward = np.full(size, _BASE), np.full(size, _BASE_INVERSE)
    forward[0] = backward[0] = 1
    np.multiply.accumulate(forward, out=forward)
    np.multiply.accumulate(backward, out=backward)
    return forward, backward


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Rolling:
    """Hashes of any substrings of a symbol sequence, from one prefix sum."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        forward, self._backward = _powers(max(20, int(n + 1).bit_length()))
        self._prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(symbols * forward[:n], out=self._prefix[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._prefix[ends] - self._prefix[starts]) * self._backward[starts])

    def every(self, length: int) -> np.ndarray:
        """Of each substring of that length, by its start."""
        n = len(self._prefix) - length
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self._prefix[length:] - self._prefix[:n]) * self._backward[:n])


def text_chunks(texts: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return
    _, offsets_buffer, data = texts.buffers()
    offsets = np.frombuffer(offsets_buffer, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + chunk_bytes, side="right")) - 1)
        stop = min(stop, n)
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


class Words:
    """The words of the documents of a chunk: byte ranges, in order, and the document of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = ~IS_SEPARATOR[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = offsets[(offsets > 0) & (offsets < n)]
        begins[edges] = inside[edges]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        stops[edges - 1] = inside[edges - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        #: words[first[d]:first[d + 1]] are those of document d
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """64 bits for each word's bytes (A-Z lower-cased on request)."""
        codes = _byte_codes()[LOWER] if lower else _byte_codes()
        return Rolling(codes[self.data]).of(self.starts, self.ends) ^ (self.ends - self.starts).astype(np.uint64)


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _byte_codes()[data]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + n) for each start and length."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, dtype=np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total) + shift


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the ranges, concatenated, and their offsets."""
    lengths = ends - starts
    return data[ranges(starts, lengths)], np.concatenate(([0], np.cumsum(lengths)))


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the half-open ranges."""
    depth = np.zeros(n + 1, dtype=np.int64)
    np.add.at(depth, starts, 1)
    np.subtract.at(depth, ends, 1)
    return np.cumsum(depth[:n]) > 0


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[d]:first[d + 1]] for each d, empty ones included."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]
