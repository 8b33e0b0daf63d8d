"""Exact quantiles of many columns at once, by narrowing ranks over ordered bit patterns.

A double's bits, with the sign handled, order like the double itself. All wanted ranks of all columns are narrowed together: a pass
counts, for each still open prefix of leading bits, how many values go on with which next bits, and every rank moves into the
prefix that holds it. Counts combine inside tasks and again before they reach the driver, which sees at most
``2**bits`` of them per open prefix, never the values of a column. A pass takes 16 bits, later ones 12; when few rows are left
under the open prefixes one pass takes all remaining bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsieve.session import compiled_methods, materialize

FIRST_BITS = 16
NEXT_BITS = 12
#: Rows under the open prefixes that one last pass may list by value.
FEW_ROWS = 100_000
#: Batches whose listed values a task keeps side by side; then it adds them up, so it holds distinct prefixes and never a column.
MERGED = 16
_SIGN = np.uint64(1 << 63)


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned longs that order like the doubles; both zeros are one."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def value_of(bits: int) -> float:
    x = np.array([bits], np.uint64)
    return float(np.where(x & _SIGN, x ^ _SIGN, ~x).view(np.float64)[0])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(values, counts) of several such pairs, values ascending."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found, at = np.unique(np.concatenate([f for f, _ in parts]), return_inverse=True)
    counts = np.zeros(len(found), np.int64)
    np.add.at(counts, at, np.concatenate([n for _, n in parts]))
    return found, counts


def _counted(df: DataFrame, columns: list[str], open_prefixes: dict[int, list[int]], known: int, bits: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Per (column, open prefix of ``known`` bits): the next ``bits`` bits that occur, ascending, and their counts."""
    shift = np.uint64(64 - known - bits)

    def values_of(b: pa.RecordBatch, c: int) -> np.ndarray:
        return ordered_bits(b.column(c).drop_null().to_numpy(zero_copy_only=False))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Few bits: an array of counts per open prefix, nothing is sorted."""
        tally = {(c, p): np.zeros(1 << bits, np.int64) for c, prefixes in open_prefixes.items() for p in prefixes}
        low = np.uint64((1 << bits) - 1)
        for b in batches:
            for c, prefixes in open_prefixes.items():
                x = values_of(b, c) >> shift
                above = x >> np.uint64(bits)
                for p in prefixes:
                    some = x[above == np.uint64(p)] if known else x
                    tally[c, p] += np.bincount((some & low).view(np.int64), minlength=1 << bits)
        for (c, p), counts in tally.items():
            found = np.flatnonzero(counts)
            yield c, found.astype(np.uint64) | np.uint64(p << bits), counts[found]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Many bits, few rows: the values themselves."""
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {c: [] for c in open_prefixes}
        for k, b in enumerate(batches, 1):
            for c, prefixes in open_prefixes.items():
                x = values_of(b, c)
                if known:
                    above = x >> np.uint64(64 - known)
                    x = x[np.logical_or.reduce([above == np.uint64(p) for p in prefixes])]
                held[c].append(np.unique(x >> shift, return_counts=True))
                if k % MERGED == 0:
                    held[c] = [_merged(held[c])]
        for c, parts in held.items():
            yield c, *_merged(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, found, counts in (counted if bits <= FIRST_BITS else listed)(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found), c, np.int32)), pa.array(found.view(np.int64)), pa.array(counts)], names=["c", "bits", "n"]
            )

    counts_of = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(
        run, "c int, bits long, n long"
    ).groupBy("c", "bits").agg(F.sum("n").alias("n"))
    with compiled_methods(df.sparkSession):
        got = counts_of.toArrow()
    column, found, counts = (got.column(k).to_numpy() for k in ("c", "bits", "n"))
    found = found.view(np.uint64)
    out = {}
    for c, prefixes in open_prefixes.items():
        mine = np.flatnonzero(column == c)
        mine = mine[np.argsort(found[mine])]
        above = found[mine] >> np.uint64(bits) if bits < 64 else np.zeros(len(mine), np.uint64)
        for p in prefixes:
            lo, hi = np.searchsorted(above, np.array([p, p], np.uint64), side="left")[0], np.searchsorted(above, np.uint64(p), side="right")
            out[c, p] = found[mine[lo:hi]], counts[mine[lo:hi]]
    return out


def order_statistics(df: DataFrame, columns: list[str], ranks_of) -> dict[str, dict[int, float]]:
    """Values at the ranks (from 0) that ``ranks_of(count)`` names, for every column with a value. ``df`` should be landed."""
    first = _counted(df, columns, {c: [0] for c in range(len(columns))}, 0, FIRST_BITS)
    sizes = {c: int(first[c, 0][1].sum()) for c in range(len(columns))}
    # per (column, rank): the prefix so far, and how many values lie below it
    place = {(c, rank): (0, 0) for c, n in sizes.items() if n for rank in ranks_of(n)}
    known, counted, bits = 0, first, FIRST_BITS
    while place:
        left = {}
        for (c, rank), (prefix, below) in place.items():
            found, counts = counted[c, prefix]
            upto = below + np.cumsum(counts)
            at = int(np.searchsorted(upto, rank, side="right"))
            place[c, rank] = int(found[at]), int(upto[at] - counts[at])
            left[c, int(found[at])] = int(counts[at])
        known += bits
        if known == 64:
            break
        bits = 64 - known if sum(left.values()) <= FEW_ROWS else min(NEXT_BITS, 64 - known)
        opened: dict[int, list[int]] = {}
        for c, prefix in left:
            opened.setdefault(c, []).append(prefix)
        counted = _counted(df, columns, opened, known, bits)
    out: dict[str, dict[int, float]] = {name: {} for name in columns}
    for (c, rank), (bits_of, _) in place.items():
        out[columns[c]][rank] = value_of(bits_of)
    return {name: {**ranks, -1: sizes[c]} if ranks else {} for c, (name, ranks) in enumerate(out.items())}


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], landed: bool = False) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles, exact, as driver scalars; None for a column without values.

    The columns are landed once for the passes over them, unless the caller says that ``df`` is a landed table.
    """
    def ranks_of(n: int) -> set[int]:
        return {r for p in probs for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))}

    table = df if landed else materialize(df.select(*[F.col(f"`{c}`") for c in columns]), "quantile-columns")
    values = order_statistics(table, columns, ranks_of)

    def quantile(name: str, p: float) -> float | None:
        ranks = values[name]
        if not ranks:
            return None
        position = (ranks[-1] - 1) * p
        low, high = ranks[math.floor(position)], ranks[math.ceil(position)]
        gap = 0.0 if high == low else high - low  # equal infinities have no gap
        return low + gap * (position - math.floor(position))

    return {c: [quantile(c, p) for p in probs] for c in columns}
