"""Near-duplicate sets: MinHash signatures, banding, exact verification in blocks, classes and link counts.

The caller hashes its items into nodes (equal texts share one) and gives every node's bucket keys. A bucket never becomes a
list of pairs: its nodes are tied to its smallest node, components of these ties are the groups inside which partners can be,
and each group is verified on the full sets. A group of up to ``BLOCK`` nodes is one unit of work; a larger one is cut into blocks
and every pair of blocks is a unit, so all pairs are compared while a task holds two blocks and emits one row per node.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsieve.llm.components import connected
from finsieve.llm.shared import ranged, runs
from finsieve.llm.tokens import mix
from finsieve.session import drop, materialize

BLOCK = 512
Signer = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: Turns the elements as they travel into ascending uint64 sets.
SetsIn = Callable[[list[pa.Buffer]], list[np.ndarray]]
#: Bits of a node that tell it apart on its way to its buckets; nodes that share them only add ties, which verification undoes.
SHORT_BITS = 40
_SHORT = np.uint64((1 << SHORT_BITS) - 1)
_COLUMNS = 4096
_CACHE = 1 << 16
_PENDING = 1 << 20


def choose_banding(threshold: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most selective rows whose bands reach ``recall`` at ``threshold`` with at most ``max_hashes``."""
    best = None
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= max_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("max_hashes is too small for this recall")
    return best


def bucket_keys(values: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key per set and band; sets are runs of shingle hashes, and empty ones get no meaning (all zero)."""
    rng = np.random.default_rng(4_242)
    salt = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    factor = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
    n = len(first) - 1
    out = np.zeros((n, bands), np.uint64)
    full = np.flatnonzero(np.diff(first) > 0)
    short = (values >> np.uint64(32)).astype(np.uint32)
    # minima of all sets first: the keys are then mixed for all of them at once
    least = np.empty((bands * rows, len(full)), np.uint32)
    lo = 0
    while lo < len(full):
        hi = int(np.searchsorted(first[full], first[full[lo]] + _CACHE))
        hi = max(hi, lo + 1)
        block = full[lo:hi]
        begin, end = first[block[0]], first[block[-1] + 1]
        x = short[begin:end]
        at = first[block] - begin
        y = np.empty_like(x)
        for k in range(bands * rows):
            np.bitwise_xor(x, salt[k], out=y)
            np.multiply(y, factor[k], out=y)
            np.minimum.reduceat(y, at, out=least[k, lo:hi])
        lo = hi
    for band in range(bands):
        key = np.full(len(full), np.uint64(band + 1), np.uint64)
        for k in range(band * rows, band * rows + rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least[k])
        out[full, band] = key
    return out


def _overlaps(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of all intersections between sets of ``a`` and of ``b`` (``a`` itself when None)."""
    sets = a if b is None else a + b
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    same = np.zeros(len(values), bool)
    same[1:] = values[1:] == values[:-1]
    column = np.cumsum(~same) - 1
    shared = np.bincount(column)[column] > 1
    rows, column = rows[shared], column[shared]
    na, nb = len(a), len(sets) if b is None else len(b)
    out = np.zeros((na, nb), np.float32)
    if len(rows) == 0:
        return out
    column = np.cumsum(np.concatenate([[0], np.diff(column) != 0]))
    for lo in range(0, int(column[-1]) + 1, _COLUMNS):
        i, j = np.searchsorted(column, [lo, lo + _COLUMNS])
        m = np.zeros((len(sets), min(_COLUMNS, int(column[-1]) + 1 - lo)), np.float32)
        m[rows[i:j], column[i:j] - lo] = 1
        out += m[:na] @ (m if b is None else m[na:]).T
    return out


def _smallest_reachable(near: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Smallest node each row reaches over the links of a square matrix."""
    label = nodes.copy()
    while True:
        new = np.where(near, label[None, :], label[:, None]).min(axis=1)
        new = np.minimum(new, label)
        if (new == label).all():
            return label
        label = new


def _as_hashes(elements: list[pa.Buffer]) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in elements]


def _verifier(threshold: float, sets_in: SetsIn) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs(batches, ["root", "i", "j"]):
            node = unit.column("node").to_numpy()
            node, at = np.unique(node, return_index=True)
            block = unit.column("block").to_numpy()[at]
            copies = unit.column("copies").to_numpy()[at]
            column = unit.column("elements").combine_chunks()
            sets = sets_in([column[int(k)].as_buffer() for k in at])
            size = np.array([len(s) for s in sets], np.float32)
            i, j = unit.column("i")[0].as_py(), unit.column("j")[0].as_py()
            left = np.flatnonzero(block == i)
            right = left if i == j else np.flatnonzero(block == j)
            if len(left) == 0 or len(right) == 0:
                continue
            shared = _overlaps([sets[k] for k in left], None if i == j else [sets[k] for k in right])
            # in whole numbers: shared / union >= threshold with the threshold in thousandths
            union = size[left][:, None] + size[right][None, :] - shared
            near = shared.astype(np.int64) * 1000 >= np.int64(round(threshold * 1000)) * union.astype(np.int64)
            if i == j:
                np.fill_diagonal(near, False)
                links = near @ copies[left]
                parent = _smallest_reachable(near, node[left])
                yield _linked(node[left], parent, links)
            else:
                both = np.concatenate([left, right])
                square = np.zeros((len(both), len(both)), bool)
                square[:len(left), len(left):] = near
                square |= square.T
                yield _linked(node[both], _smallest_reachable(square, node[both]), square @ copies[both])

    return verify


def _linked(node: np.ndarray, parent: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(parent), pa.array(links.astype(np.int64))], names=["node", "parent", "links"])


def _distinct_pairs(pairs: np.ndarray) -> np.ndarray:
    """Rows of a two-column array, each once, ordered as signed longs."""
    order = np.lexsort((pairs[:, 1].view(np.int64), pairs[:, 0].view(np.int64)))
    pairs = pairs[order]
    fresh = np.ones(len(pairs), bool)
    fresh[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
    return pairs[fresh]


def _five_bytes(x: np.ndarray) -> bytes:
    """Numbers below 2**40 in five bytes each: all lower four, then all upper ones."""
    return x.astype(np.uint32).tobytes() + (x >> np.uint64(32)).astype(np.uint8).tobytes()


def _from_five_bytes(blob: pa.Buffer, n: int, offset: int = 0) -> np.ndarray:
    low, high = np.frombuffer(blob, np.uint32, n, offset), np.frombuffer(blob, np.uint8, n, offset + 4 * n)
    return low + (high.astype(np.uint64) << np.uint64(32))


def _packed(slots: int, pending: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(slot, entries, ties): bucket entries, and nodes tied to the smallest of their bucket seen here.

    Of the nodes that share a bucket within ``pending`` entries only the smallest travels on under the bucket's key; the others
    are tied to it at once and travel under their own. So a bucket with a large part of all nodes sends a few entries. An entry is the
    upper half of its key, which with the slot tells apart all keys of a partition but for a few in a million, and ``SHORT_BITS`` of the
    node, nine bytes together: two keys or nodes taken for one only add a tie, which verification undoes.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            pairs = np.concatenate(held)
            held.clear()
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
            fresh = np.ones(len(pairs), bool)
            fresh[1:] = pairs[1:, 0] != pairs[:-1, 0]
            head = pairs[fresh][np.cumsum(fresh) - 1, 1]
            tied = ~fresh & (pairs[:, 1] != head)
            blobs = []
            for x, narrow in ((pairs[fresh], True), (np.stack([pairs[tied, 1], head[tied]], axis=1), False)):
                slot = (x[:, 0] >> np.uint64(11)) % np.uint64(slots)
                order = np.argsort(slot, kind="stable")
                x, at = x[order], np.searchsorted(slot[order], np.arange(slots + 1))
                upper = (x[:, 0] >> np.uint64(32)).astype(np.uint32) if narrow else None
                blobs.append([
                    (upper[i:j].tobytes() if narrow else _five_bytes(x[i:j, 0])) + _five_bytes(x[i:j, 1])
                    for i, j in zip(at[:-1], at[1:], strict=True)
                ])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.arange(slots), pa.int32()), pa.array(blobs[0], pa.binary()), pa.array(blobs[1], pa.binary())],
                names=["slot", "entries", "ties"],
            )

        for b in batches:
            lists = b.column("buckets")
            keys = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            node = np.repeat(b.column("node").to_numpy(zero_copy_only=False).view(np.uint64) & _SHORT, np.diff(lists.offsets.to_numpy()))
            if len(keys):
                held.append(np.stack([keys, node], axis=1))
                size += len(keys)
            if size >= pending:
                yield flush()
                size = 0
        if size:
            yield flush()

    return pack


def _tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): every node of a bucket of this partition with the bucket's smallest node."""
    by_slot: dict[int, tuple[list, list]] = {}
    ties: list[np.ndarray] = []
    for b in batches:
        for slot, packed, tied in zip(b.column("slot").to_pylist(), b.column("entries"), b.column("ties"), strict=True):
            blob = packed.as_buffer()
            n = len(blob) // 9
            upper, node = by_slot.setdefault(slot, ([], []))
            upper.append(np.frombuffer(blob, np.uint32, n))
            node.append(_from_five_bytes(blob, n, 4 * n))
            blob = tied.as_buffer()
            n = len(blob) // 10
            ties.append(np.stack([_from_five_bytes(blob, n), _from_five_bytes(blob, n, 5 * n)], axis=1))
    while by_slot:
        _, (upper, node) = by_slot.popitem()
        keys, nodes = np.concatenate(upper), np.concatenate(node)
        del upper, node
        order = np.lexsort((nodes.view(np.int64), keys))
        keys, nodes = keys[order], nodes[order]
        del order
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        head = nodes[fresh][np.cumsum(fresh) - 1]
        other = nodes != head
        ties.append(np.stack([nodes[other], head[other]], axis=1))
    if not ties:
        return
    found = _distinct_pairs(np.concatenate(ties)).view(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, 0])), pa.array(np.ascontiguousarray(found[:, 1]))], names=["u", "v"])


def bucket_ties(items: DataFrame, sign: Signer, count: int, pending: int = _PENDING) -> DataFrame:
    """(u, v) so that nodes that share a bucket are connected, told by their ``SHORT_BITS``; ``count`` is about the number of bucket entries.

    A partition takes about ``_PENDING`` entries of 9 bytes, whatever the size of the input; a task that signs holds ``pending``.
    """
    slots = ranged(count, _PENDING, 4 * items.sparkSession.sparkContext.defaultParallelism)
    pack = _packed(slots, pending)
    packed = items.mapInArrow(lambda batches: pack(sign(batches)), "slot int, entries binary, ties binary")
    return packed.filter("length(entries) > 0 or length(ties) > 0").repartition(slots, "slot").mapInArrow(_tie, "u long, v long").distinct()


def near_classes(
    items: DataFrame, sign: Signer, bands: int, nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], threshold: float,
    sets_in: SetsIn = _as_hashes, pending: int = _PENDING,
) -> DataFrame:
    """(node, root, links) of every node that may have a partner.

    ``sign`` turns batches of ``items`` into (node int64, buckets list of ``bands`` int64 keys), repeats allowed, in the same
    task that packs them. ``nodes``: (node, copies) once per node. ``sets_of`` gives
    (node, elements binary) for the candidates it is handed, repeats allowed; ``sets_in`` makes sets of ascending uint64 of them, which
    by default they are. Links count the copies of the
    partners at ``threshold`` or above; root is the smallest node of the class. Nodes that never share a bucket are absent.
    """
    ties = bucket_ties(items, sign, bands * nodes.count(), pending)
    groups = connected(ties, "near-groups")
    sizes = materialize(groups.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "near-sizes")
    full = nodes.select(F.col("node").bitwiseAND(F.lit(int(_SHORT))).alias("short"), "node", "copies")
    found = groups.join(sizes, "root").withColumnRenamed("node", "short").join(full, "short").drop("short")
    found = found.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    )
    candidates = materialize(found, "near-candidates")
    drop(groups, sizes)
    placed = candidates.join(sets_of(candidates), "node").select(
        "root", "node", "copies", "block", "elements", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")
    ).select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "copies", "block", "elements")
    parts = ranged(candidates.count(), 4 * BLOCK, 4 * items.sparkSession.sparkContext.defaultParallelism)
    units = placed.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
    checked = materialize(units.mapInArrow(_verifier(threshold, sets_in), "node long, parent long, links long"), "near-checked")
    classes = connected(checked.select(F.col("node").alias("u"), F.col("parent").alias("v")))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    return links.join(classes, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "links")
