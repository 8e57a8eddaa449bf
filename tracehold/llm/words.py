"""Words and hashes of many texts at once, over the bytes of an Arrow column.

Words are `[^\\x20\\x09-\\x0D]+`. All delimiters are single bytes in UTF-8, so the bytes can be cut without decoding.
Hashes are 64 bits wide and the same in every process.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
SLICE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER_CODE = _BYTE_CODE.copy()
_LOWER_CODE[65:91] = _BYTE_CODE[97:123]
_DELIMITER = np.zeros(256, bool)
_DELIMITER[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[base] = have = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray) -> np.ndarray:
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(code[data] * powers(_BASE, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each piece data[starts[i]:ends[i]]; pieces are in order and do not overlap."""
    found = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + SLICE_BYTES)))
        first, last = starts[at], ends[to - 1]
        found[at:to] = _hashed(data[first:last], starts[at:to] - first, ends[at:to] - first, _BYTE_CODE)
        at = to
    return found


def find_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first byte, byte after the last, and hash of each word of the texts data[offsets[i]:offsets[i+1]]."""
    inside = ~_DELIMITER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    code = _LOWER_CODE if lower else _BYTE_CODE
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # blocks of whole words, so that a very long text needs no more memory
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + SLICE_BYTES)))
        first, last = starts[at], ends[to - 1]
        hashes[at:to] = _hashed(data[first:last], starts[at:to] - first, ends[at:to] - first, code)
        at = to
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends, hashes


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets of runs of rows with about SLICE_BYTES of text; null counts as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        first, last = offsets[row], offsets[to]
        yield row, data[first:last], offsets[row : to + 1] - first
        row = to


def bounds(doc: np.ndarray, n: int) -> np.ndarray:
    """Where the words of each of n texts begin, and the end, given each word's text number in order."""
    return np.searchsorted(doc, np.arange(n + 1))


def rolled(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of each run of width consecutive entries."""
    total = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        total += hashes[k : k + len(total)] * U(pow(base, k + 1, 1 << 64))
    return mix(total)


Batches = Iterator[pa.RecordBatch]


def trimmed(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, after which a worker gives its free memory back: workers outlive tasks and wait beside the next stages."""

    @wraps(run)
    def then_free(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return then_free
