"""Periodic runs in texts: an online sparse diagonal DP over each word's earlier occurrences.

A run is a stretch of words with smallest period q (words q apart are identical) of at least ``max(SHORTEST, REPEATS * q)`` words
that no neighbouring word extends with the same period. On the diagonal of lag q it is a chain of matches: every word from the
(q+1)-th on equals the one q before it. The words of a text are taken in order; an earlier occurrence at lag q adds one to the
match length of diagonal q, a diagonal that is not met again ends, and if its match is long enough it emits its run there.

What keeps the diagonals sparse are bands of lags, [1, 3], [4, 12], [13, 39], ... A run with a lag of the band [l, 3l] holds
matches over more than 3l words, so a word takes part in the band only through the 3l words that begin with it: its earlier
occurrence is the latest place where the same 3l words begin. By the periodicity lemma that place is exactly q back in a run
with smallest period q, and never q back if a smaller period holds there. So each word has one active lag per band, multiples of a
period cost nothing, and the ends of the diagonal give the run's exact ends. Words whose 3l words occur once in their text take no
part in wider bands. A text of n words takes n log n steps in its first band and rarely much in the others, whatever it repeats.

Words are runs of bytes other than space and 09-0D, compared by a 64-bit hash as written. Texts are independent, so nothing is
shuffled; a task holds one chunk of texts, or one longer text. A missing text has no words. Ids may be missing or repeated; rows
stay rows. Columns other than ``doc_id`` and ``text`` are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsieve.llm import tokens
from finsieve.llm.sequences import Sequence, joined

SHORTEST = 6
REPEATS = 4
_CHUNK = 1 << 20
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUN_SQL = "struct<start: bigint, length: bigint, period: bigint>"

#: Puts other words in place of a chunk's own: takes (word starts, word ends, first word per row, the chunk's rows of ``given``)
#: and returns new starts and ends.
Rewrite = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


class Runs(NamedTuple):
    row: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def find_runs(words: np.ndarray, first: np.ndarray) -> Runs:
    """All runs in the rows of a chunk, by row, start and period; ``words`` are hashes, ``first`` each row's first word."""
    sequence = Sequence(words)
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    found: list[tuple] = []
    active, low = np.arange(len(words)), 1
    while True:
        gram = 3 * low
        fits = (active + gram <= first[1:][row[active]]) & (counts[row[active]] >= max(SHORTEST, REPEATS * low))
        active = active[fits]
        if len(active) == 0:
            break
        keys = tokens.mix(sequence.of(active, active + gram) + row[active].astype(np.uint64))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        met = np.flatnonzero(keys[1:] == keys[:-1])
        lag = np.zeros(len(active), np.int64)
        lag[order[met + 1]] = active[order[met + 1]] - active[order[met]]
        on = np.flatnonzero((lag >= low) & (lag <= gram))
        if len(on):
            at, q = active[on], lag[on]
            # a diagonal ends where the next word has no match at its lag
            ends = np.append((at[1:] != at[:-1] + 1) | (q[1:] != q[:-1]), True)
            last = np.flatnonzero(ends)
            begin = np.concatenate([[0], last[:-1] + 1])
            matched = at[last] - at[begin] + gram
            long_enough = matched + q[last] >= np.maximum(SHORTEST, REPEATS * q[last])
            begin, last, matched = begin[long_enough], last[long_enough], matched[long_enough]
            found.append((at[begin] - q[last], matched + q[last], q[last]))
        again = np.zeros(len(active), bool)
        again[order[met]] = again[order[met + 1]] = True
        active, low = active[again], gram + 1
    if not found:
        return Runs(*(np.zeros(0, np.int64) for _ in range(4)))
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    in_row = row[start]
    return Runs(in_row, start - first[in_row], length, period)


def strongest(runs: Runs) -> np.ndarray:
    """Position of each row's run with the greatest length / period; ties go to the smallest start, then period.

    The quotient of two numbers below 2**26 is exact enough as a double to order fractions, and equal fractions are equal.
    """
    order = np.lexsort((runs.period, runs.start, -(runs.length / runs.period), runs.row))
    ordered = runs.row[order]
    return order[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(order) else order


def repeated_words(runs: Runs, first: np.ndarray) -> np.ndarray:
    """Whether a run holds the word after its own first period."""
    edge = np.zeros(first[-1] + 1, np.int64)
    begin = first[runs.row] + runs.start
    np.add.at(edge, begin + runs.period, 1)
    np.add.at(edge, begin + runs.length, -1)
    return np.cumsum(edge[:-1]) > 0


def _structs(start: np.ndarray, length: np.ndarray, period: np.ndarray, missing: np.ndarray | None = None) -> pa.StructArray:
    return pa.StructArray.from_arrays(
        [pa.array(x) for x in (start, length, period)], fields=list(_RUN), mask=None if missing is None else pa.array(missing)
    )


def collapse(docs: DataFrame, rewrite: Rewrite | None = None, given: str = "doc_id") -> DataFrame:
    """(doc_id, runs, strongest, text), one row per document.

    ``runs`` holds (start, length, period) of every run by start, then period; ``strongest`` the one with the greatest
    length / period, null without runs; ``text`` the words that stay when each run is cut to its first period, one space between
    them. ``rewrite`` may replace words before they are searched; it sees the column ``given`` (no nulls then).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in tokens.text_chunks(b.column("text"), _CHUNK):
                starts, ends, first = tokens.spans(data, offsets, tokens.NOT_SPACE)
                if rewrite is not None:
                    starts, ends = rewrite(starts, ends, first, b.column("given").slice(lo, hi - lo).to_numpy(zero_copy_only=False))
                runs = find_runs(tokens.Prefix(data, fold=False).of(starts, ends), first)
                best, n = strongest(runs), hi - lo
                top = np.zeros((3, n), np.int64)
                top[:, runs.row[best]] = runs.start[best], runs.length[best], runs.period[best]
                none = np.ones(n, bool)
                none[runs.row[best]] = False
                stay = ~repeated_words(runs, first)
                kept = np.concatenate([[0], np.cumsum(stay)])[first]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(runs.row, np.arange(n + 1)).astype(np.int32)), _structs(runs.start, runs.length, runs.period)
                )
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, n), lists, _structs(*top, missing=none), joined(data, starts[stay], ends[stay], kept)],
                    names=["doc_id", "runs", "strongest", "text"],
                )

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if rewrite is not None:
        columns.append(F.col(given).alias("given"))
    return docs.select(*columns).mapInArrow(run, f"doc_id long, runs array<{_RUN_SQL}>, strongest {_RUN_SQL}, text string")
