"""A bitmap of fixed size that tells which keys are worth sending on; it may pass others, never loses one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsieve.llm.tokens import mix

_PROBES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _slots(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    keys = keys.view(np.uint64) if keys.dtype != np.uint64 else keys
    return [(mix(keys ^ p) >> np.uint64(64 - bits)).astype(np.int64) for p in _PROBES]


def mark(keys: DataFrame, key: str | Callable[[pa.RecordBatch], np.ndarray], bits: int = 23) -> Broadcast:
    """Broadcast bitmap over the longs of a column, or those that ``key`` finds for a batch: 2**bits bits whatever the number of keys.

    Set words are merged on the executors; at most 2**(bits - 6) of them come to the driver. With more keys it selects less,
    which costs time only: callers join exactly afterwards.
    """
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            longs = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64) if isinstance(key, str) else key(b)
            slots = np.unique(np.concatenate(_slots(longs, bits)))
            if len(slots) == 0:
                continue
            at, first = np.unique(slots >> 6, return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (slots & 63).astype(np.uint64), first)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(value.view(np.int64))], names=["at", "value"])

    found = (keys.select(F.col(key).cast("long")) if isinstance(key, str) else keys).mapInArrow(words, "at long, value long").groupBy("at").agg(
        F.bit_or("value").alias("value")
    ).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[found.column("at").to_numpy()] = found.column("value").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(bitmap)


def marked(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = len(bitmap).bit_length() - 1 + 6
    out = np.ones(len(keys), bool)
    for slots in _slots(keys, bits):
        out &= (bitmap[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) == 1
    return out
