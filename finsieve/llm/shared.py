"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of the id written as text; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def folded(text: str = "text") -> Column:
    """Text with A-Z in lower case and nothing else changed; null counts as empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Shipped:
    """A broadcast object whose classes travel with it: workers need no copy of this package to read ``value``."""

    def __init__(self, spark: SparkSession, value: Any):
        self._packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._held: list[Any] = [value]

    def __getstate__(self) -> dict:
        return {"_packed": self._packed, "_held": []}

    @property
    def value(self) -> Any:
        if not self._held:
            self._held.append(pickle.loads(self._packed.value))
        return self._held[0]


def ranged(count: int, per: int, least: int = 1) -> int:
    """Number of parts so that each holds about ``per`` of ``count``."""
    return max(least, -(-count // per))


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys from a sorted stream of batches, one table per key."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), n]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[lo] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)
