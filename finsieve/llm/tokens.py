"""Vectorised views of Arrow text columns: bytes, words, word hashes and shingles.

Everything works on the UTF-8 bytes of a batch of texts at once, so that the cost per word is a few numpy passes instead of
a Python loop. A word's hash is a polynomial over its bytes modulo 2**64 read off prefix sums, then mixed; hashes are 64 bits
wide, so among n distinct words one clash is expected at about n**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 3
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20_111).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_FOLDED = np.arange(256)
_FOLDED[65:91] += 32
FOLD = _FOLDED.astype(np.uint8)
_FOLDED_VALUES = _BYTE_VALUES[FOLD]

#: Separators of the plain word definition: space and the control characters 09 to 0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Letters and digits; every byte of a non-ASCII character counts as a letter.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n + 1`` of each; kept per process up to a chunk's length."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        tables = []
        for base in (_BASE, _INVERSE):
            t = np.full(size, np.uint64(base), np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        if size > 2 * CHUNK_BYTES:
            return tables[0], tables[1]
        _powers[:] = tables
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA5CB9243F5A3E5AD)
    x ^= x >> np.uint64(32)
    return x


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, at least one row each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for consecutive rows of bounded size; a single longer text is a chunk of its own."""
    data, offsets = text_buffers(column)
    for lo, hi in chunks(offsets, limit):
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]


class Spans(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # position of each row's first span, and the total


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Spans:
    """Maximal runs of bytes for which ``inside`` holds, never across rows."""
    if len(data) == 0:
        return Spans(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    on = inside[data]
    before = np.empty_like(on)
    before[0], before[1:] = False, on[:-1]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[edge] = False
    starts = np.flatnonzero(on & ~before)
    after = np.empty_like(on)
    after[-1], after[:-1] = False, on[1:]
    after[edge[1:] - 1] = False
    ends = np.flatnonzero(on & ~after) + 1
    return Spans(starts, ends, np.searchsorted(starts, offsets))


class Prefix:
    """Hashes of byte ranges of one chunk, from prefix sums."""

    def __init__(self, data: np.ndarray, fold: bool = True):
        up, self.down = _power_tables(len(data))
        terms = (_FOLDED_VALUES if fold else _BYTE_VALUES)[data]
        terms *= up[:len(data)]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x = self.sums[ends]
        x -= self.sums[starts]
        x *= self.down[starts]
        return mix(x)


def row_index(first: np.ndarray) -> np.ndarray:
    """The row of every span."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


_STEPS = np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``width`` words, first position per row).

    A row of fewer words, but at least one, has a single shingle made of all of them.
    """
    counts = np.diff(first)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    begin = np.zeros(len(first), np.int64)
    np.cumsum(n, out=begin[1:])
    total = np.zeros(len(hashes) + width, np.uint64)
    for k in range(width):
        total[:max(0, len(hashes) - k)] += hashes[k:] * _STEPS[k]
    at = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], n)
    out = mix(total[at])
    for row in np.flatnonzero((counts > 0) & (counts < width)):
        words = hashes[first[row]:first[row + 1]]
        with np.errstate(over="ignore"):
            out[begin[row]] = mix((words * _STEPS[:len(words)]).sum(keepdims=True) + np.uint64(len(words)))[0]
    return out, begin


def distinct_per_row(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and their first positions."""
    rows = row_index(first)
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[new], rows[new]
    return values, np.searchsorted(rows, np.arange(len(first)))


def list_array(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and first positions."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))
