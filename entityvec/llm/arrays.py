"""Texts of Arrow batches as flat NumPy arrays: bytes, words and 64-bit hashes."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GOLDEN = 0x9E3779B97F4A7C15
CHUNK_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of the splitmix64 generator, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of len + 1, bytes) of a string column; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(len(offsets), np.int64), np.zeros(0, np.uint8)
    return offsets - offsets[0], np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes and ``rows`` rows each; a longer row is a range of its own."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(n, max(end, start + 1), start + (rows or n))
        yield start, end
        start = end


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word (run of bytes other than blanks), rows kept apart."""
    solid = ~_BLANK[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    first[inner] = solid[inner]
    inner = inner[inner > 0] - 1
    last[inner] = solid[inner]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


_BASE = 0xD1342543DE82EF95
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(GOLDEN))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, A-Z lower-cased."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers = np.full(len(data), _BASE, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * powers, out=sums[1:])
    back = np.full(len(data), _inverse(_BASE), np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    value = (sums[ends] - sums[starts]) * back[starts]
    return mix64(value + (ends - starts).astype(np.uint64) * np.uint64(GOLDEN))


def shingle_hashes(hashes: np.ndarray, row: np.ndarray, rows: int, size: int
                   ) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each distinct run of ``size`` words in a row, sorted by row and hash.

    A row with fewer words, but not none, has its whole sequence as one shingle. ``row``
    is the ascending row number of each word.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    counts = np.bincount(row, minlength=rows)
    firsts = np.cumsum(counts) - counts
    place = np.arange(n) - firsts[row]
    length = np.minimum(counts, size)[row]
    at = np.flatnonzero(place <= counts[row] - length)
    value = np.zeros(len(at), np.uint64)
    for i in range(size):
        part = hashes[np.minimum(at + i, n - 1)]
        value = np.where(length[at] > i, mix64(value + part + np.uint64(i + 1)), value)
    owner = row[at]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return owner[fresh], value[fresh]
