"""Vectorised word splitting and hashing over Arrow string columns.

An Arrow batch is cut, without a copy, into runs of at most ``CHUNK_ROWS`` rows of about ``CHUNK_BYTES`` bytes, so
that the memory of a task follows the longest text and not the batch. All
hashes are plain 64-bit arithmetic on UTF-8 bytes: they are the same in every
process, on every executor, and when a lost task is run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES, CHUNK_ROWS = 1 << 18, 1 << 10

_R = np.uint64(0x9E3779B97F4A7C15)

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes of the closed ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Words are runs of bytes other than space and \t \n \v \f \r.
WORD = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words are runs of letters, digits and non-ASCII bytes.
ALNUM = ~byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def mix_int(value: int) -> int:
    """``mix`` of one Python integer."""
    return int(mix(np.array([value & (2**64 - 1)], np.uint64))[0])


#: Hashes of every byte at each of the first 64 places of a word; ``mix`` gives those of later places.
_BYTES = mix(np.arange(1, 64 * 256 + 1, dtype=np.uint64))


class Texts:
    """Some consecutive rows of a string column: bytes and where each row starts (nulls are empty)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, table: np.ndarray = WORD) -> Words:
        return Words(self, table)


class Words:
    """The words of ``Texts``: row, start and end byte; ``bounds[i]:bounds[i+1]`` are the words of row i."""

    def __init__(self, texts: Texts, table: np.ndarray):
        data, offsets = texts.data, texts.offsets
        self.texts = texts
        n = len(data)
        inside = np.empty(n + 2, bool)
        inside[0] = inside[n + 1] = False
        inside[1 : n + 1] = table[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        self.start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        self.end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        self.bounds = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, A-Z as a-z: the sum of mixed (place, byte) values, mixed with the length."""
        data = LOWER[self.texts.data]
        first = np.zeros(len(data), np.uint64)
        first[self.start] = self.start
        keys = ((np.arange(len(data), dtype=np.uint64) - np.maximum.accumulate(first)) << np.uint64(8)) + data
        values = _BYTES[keys] if len(keys) and keys.max() < len(_BYTES) else mix(keys + np.uint64(1))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values, out=total[1:])
        return mix(total[self.end] - total[self.start] + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def prefix_hashes(self, size: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words of at least ``least or size`` bytes, and hashes of their first ``size`` bytes."""
        data = LOWER[self.texts.data]
        which = np.flatnonzero(self.end - self.start >= max(size, least))
        h = np.zeros(len(which), np.uint64)
        for j in range(size):
            h = (h + data[self.start[which] + j].astype(np.uint64) + np.uint64(1)) * _R
        return which, mix(h + np.uint64(size))


def grams(hashes: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words of one row, and the index of each first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    total = np.zeros(len(at), np.uint64)
    for j in range(k):
        total = total * _R + hashes[at + j]
    return mix(total), at


def chunks(column: pa.Array | pa.ChunkedArray, budget: int = CHUNK_BYTES) -> Iterator[Texts]:
    """``Texts`` of about ``budget`` bytes, of one row at least and ``CHUNK_ROWS`` at most, that make up the column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_utf8())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    _, at, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(at, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    low = 0
    while low < len(column):
        high = int(np.searchsorted(offsets, offsets[low] + budget, side="right")) - 1
        high = min(max(high, low + 1), low + CHUNK_ROWS, len(column))
        yield Texts(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], low)
        low = high
