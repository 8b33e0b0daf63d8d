"""Hashes of word sequences read off prefix sums, and texts rebuilt from chosen words."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsieve.llm import tokens
from finsieve.llm.marks import mark, marked

#: Stands for a missing id in keys; no document has it.
NO_ID = (1 << 63) - 1


class Sequence:
    """Hash of any run of the words whose hashes are given; a run's hash depends on its words alone, not on its place."""

    def __init__(self, words: np.ndarray):
        up, self.down = tokens._power_tables(len(words))
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[:len(words)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return tokens.mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> pa.Array:
    """One text per row: its words, given by byte ranges, with one space between them."""
    counts = np.diff(first)
    sizes = ends - starts
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes + 1, out=at[1:])
    out = np.full(at[-1], 0x20, np.uint8)
    inside = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=inside[1:])
    step = np.arange(inside[-1])
    out[step + np.repeat(at[:-1] - inside[:-1], sizes)] = data[step + np.repeat(starts - inside[:-1], sizes)]
    # the space after a row's last word goes
    last = at[first[1:][counts > 0]] - 1
    keep = np.ones(len(out), bool)
    keep[last] = False
    offsets = at[first] - np.concatenate([[0], np.cumsum(counts > 0)])
    return pa.LargeStringArray.from_buffers(
        len(counts), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(out[keep].tobytes())
    ).cast(pa.string())


def with_key(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text): the id as long, ``NO_ID`` if it is missing, and a hash of the text, so that rows that share an id stay apart."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), _mark(text).alias("mark"), text.alias("text"))


def _mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def may_hold(keys: DataFrame, count: int) -> Callable[[pa.RecordBatch], np.ndarray]:
    """For batches with the first two columns of ``keys`` (an id and a mark): which rows may be among them.

    The bitmap has 16 bits a key, up to 2**26 bits; a fuller one lets more pass.
    """
    def key(b: pa.RecordBatch, id_column: str, mark_column: str) -> np.ndarray:
        ids, marks = (b.column(c).to_numpy(zero_copy_only=False) for c in (id_column, mark_column))
        return (tokens.mix(ids.view(np.uint64)) ^ marks.view(np.uint64)).view(np.int64)

    names = keys.columns[:2]
    bitmap = mark(keys.select(*names), lambda b: key(b, *names), min(max((16 * count).bit_length(), 16), 26))
    return lambda b: marked(bitmap.value, key(b, *names))
