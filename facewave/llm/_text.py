"""NumPy kernels over whole Arrow string columns: words, word hashes, shingle sets.

They work on the UTF-8 bytes of a slice of rows at once, so the cost per word is a few array operations and not a
Python call. Slices are bounded by bytes (one row at least), so memory does not follow the size of a batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: 256-entry table that lower-cases A-Z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that part words for shingles: blank and 0x09 to 0x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

_BASE = U(0x9E3779B97F4A7C15)
_BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of text that are worked on at a time.
SLICE = 1 << 19
_powers: tuple[np.ndarray, np.ndarray] = (np.empty(0, U), np.empty(0, U))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def give_back() -> None:
    """Freed memory goes back to the machine: a Python worker lives on and serves later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def tidy(work: Callable) -> Callable:
    """``work`` for mapInArrow, which gives memory back when its task ends."""

    @wraps(work)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return tidied


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes, or of one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_spans(data: np.ndarray, rows: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in ``data``, and the n + 1 places where each row's words begin. ``rows`` are offsets from 0."""
    mask = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[rows] = True
    starts = np.flatnonzero(mask & (edge[:-1] | np.concatenate(([True], ~mask[:-1])))) if len(data) else np.empty(0, np.int64)
    ends = np.flatnonzero(mask & (edge[1:] | np.concatenate((~mask[1:], [True])))) + 1 if len(data) else np.empty(0, np.int64)
    return starts, ends, np.searchsorted(starts, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: One odd multiplier for each place in a shingle, without simple relations between them.
PLACES = mix(np.arange(1, 65, dtype=U) * _BASE) | U(1)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse. Those for one slice are kept; those for a longer word are not."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    steps = [np.full(max(n, SLICE + 1), b, U) for b in (_BASE, _BASE_INVERSE)]
    for s in steps:
        s[0] = U(1)
    found = tuple(np.multiply.accumulate(s) for s in steps)
    if len(found[0]) == SLICE + 1:
        _powers = found
    return found


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word from a running sum over the bytes of some words at a time. Words come in order."""
    out = np.empty(len(starts), U)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + SLICE, "right")))
        first = starts[a]
        n = int(ends[b - 1] - first)
        power, inverse = _powers_to(n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum((data[first : first + n].astype(U) + U(1)) * power[:n], out=total[1:])
        begin = starts[a:b] - first
        out[a:b] = mix((total[ends[a:b] - first] - total[begin]) * inverse[begin])
        a = b
    return out


def shingle_sets(column: pa.Array | pa.ChunkedArray, size: int = 5, limit: int = SLICE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit shingles) of each row, in order. Words are runs of bytes other than white space, A-Z in
    lower case. A text of fewer than ``size`` words is one shingle; a text without words has none."""
    data, offsets = utf8(column)
    for first, last in slices(offsets, limit):
        rows = offsets[first : last + 1] - offsets[first]
        part = LOWER[data[offsets[first] : offsets[last]]]
        starts, ends, bounds = word_spans(part, rows, NOT_SPACE)
        h = word_hashes(part, starts, ends)
        n = max(len(h) - size + 1, 0)
        every = np.zeros(n, U)
        for k in range(size):
            every += h[k : k + n] * PLACES[k]
        every = mix(every)
        for row in range(first, last):
            a, b = int(bounds[row - first]), int(bounds[row - first + 1])
            if b - a >= size:
                s = np.sort(every[a : b - size + 1])
                keep = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield row, s[keep]
            elif b > a:
                with np.errstate(over="ignore"):
                    yield row, mix((h[a:b] * PLACES[: b - a]).sum(dtype=U, keepdims=True) + U(b - a) * PLACES[63])
            else:
                yield row, np.empty(0, U)
