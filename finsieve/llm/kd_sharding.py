"""Shards of near equal bytes by recursive k-d splits over metadata, in DataFrame operations only.

A node that has to become k shards is cut in two parts that stand for ``k // 2`` and ``k - k // 2`` of them, at the matching
weighted quantile of its widest metadata dimension, until every leaf is one shard of the target size. Every level handles all
its nodes together: one aggregate gives each dimension's extent, then counting passes over byte sums per bin narrow the bin
that holds the cut, until it holds less than ``TOLERANCE`` of a shard. A value's lower 32 bits are a hash of the row's key, so
ties (a source with a third of all rows) are divisible and a cut is exact for any number of equal values.

Only bin sums and cuts reach the driver: at most ``BINS`` per open node and pass. A node's rows never meet in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from finsieve.llm.shared import ranged
from finsieve.session import materialize

BINS = 1024
TOLERANCE = 0.002
#: Rows numbered within one task when slots are given.
SLOT_ROWS = 20_000
_TIES = 1 << 32


@dataclass
class Node:
    """A part of the tree: how many shards it stands for, its first shard, its cut once found."""

    shards: int
    first: int
    dimension: str | None = None
    cut: int | None = None
    left: Node | None = None
    right: Node | None = None


def _frontier(node: Node) -> list[Node]:
    return [node] if node.cut is None else _frontier(node.left) + _frontier(node.right)


def with_keys(df: DataFrame, dimensions: list[str], tie: Column) -> DataFrame:
    """Dimensions as longs whose lower half is a hash of the row; values must fit in 31 bits without sign."""
    low = F.pmod(F.xxhash64(tie), F.lit(_TIES))
    return df.withColumns({
        d: F.greatest(F.lit(0), F.least(F.lit(2**31 - 1), F.coalesce(F.col(d).cast("long"), F.lit(0)))) * _TIES + low
        for d in dimensions
    })


def _by_node(values: dict[int, object], missing: object) -> Column:
    """The value of the row's node, read from a literal array."""
    return F.get(F.array(*[F.lit(values.get(i, missing)) for i in range(max(values) + 1)]), F.col("node"))


def _cuts(rows: DataFrame, dimension: dict[int, Column], targets: dict[int, float], extents: dict[int, tuple[int, int]], tolerance: float) -> dict[int, int]:
    """For every node the value below which ``target`` bytes lie, by narrowing bins."""
    lo = {i: e[0] for i, e in extents.items()}
    hi = {i: e[1] + 1 for i, e in extents.items()}
    below = dict.fromkeys(targets, 0)
    found: dict[int, int] = {}
    valued = rows.select("node", "size", F.coalesce(*[F.when(F.col("node") == i, c) for i, c in dimension.items()]).alias("value"))
    while open_ := [i for i in targets if i not in found]:
        width = {i: max(1, -(-(hi[i] - lo[i]) // BINS)) for i in open_}
        sums = (
            valued.withColumns({
                "__lo": _by_node({i: lo[i] for i in open_}, None), "__hi": _by_node({i: hi[i] for i in open_}, None),
                "__step": _by_node(width, None),
            })
            .filter("value >= __lo and value < __hi")
            .groupBy("node", F.expr("(value - __lo) div __step").alias("bin")).agg(F.sum("size").alias("bytes"))
        )
        by_node: dict[int, list[tuple[int, int]]] = {}
        for r in sums.collect():
            by_node.setdefault(r["node"], []).append((r["bin"], r["bytes"]))
        for i in open_:
            reached, chosen = below[i], None
            for b, size in sorted(by_node.get(i, [])):
                if reached + size > targets[i]:
                    chosen = (b, size)
                    break
                reached += size
            if chosen is None:
                found[i] = hi[i]
                continue
            b, size = chosen
            edge = lo[i] + b * width[i]
            if size <= tolerance or width[i] == 1:
                nearer_end = targets[i] - reached > reached + size - targets[i]
                found[i] = min(edge + width[i], hi[i]) if nearer_end else edge
            else:
                below[i], lo[i], hi[i] = reached, edge, min(edge + width[i], hi[i])
    return found


def build_tree(rows: DataFrame, dimensions: list[str], shards: int) -> tuple[Node, DataFrame]:
    """The splits that divide ``rows`` (keyed dimensions and ``size``) into ``shards`` leaves, and the rows with their ``shard``.

    ``node`` numbers the open nodes of a level. Every level lands the narrow table once with the new numbers, so a pass reads
    a column instead of following the tree again.
    """
    root = Node(shards, 0)
    rows = rows.withColumn("node", F.lit(0))
    world: dict | None = None
    while any(n.shards > 1 for n in _frontier(root)):
        open_ = {i: n for i, n in enumerate(_frontier(root)) if n.shards > 1}
        extents = {r["node"]: r.asDict() for r in rows.groupBy("node").agg(
            F.sum("size").alias("bytes"),
            *[f(d).alias(f"{k}_{d}") for d in dimensions for k, f in (("lo", F.min), ("hi", F.max))],
        ).collect()}
        empty = {"bytes": 0} | {f"{k}_{d}": 0 for d in dimensions for k in ("lo", "hi")}
        world = world or extents.get(0, empty)
        targets, ranges = {}, {}
        for i, n in open_.items():
            x = extents.get(i, empty)
            n.dimension = max(dimensions, key=lambda d, x=x: _extent(x, d) / max(1, _extent(world, d)))
            targets[i] = x["bytes"] * (n.shards // 2) / n.shards
            ranges[i] = (x[f"lo_{n.dimension}"], x[f"hi_{n.dimension}"])
        share = (world["bytes"] or 1) / shards
        cuts = _cuts(rows, {i: F.col(n.dimension) for i, n in open_.items()}, targets, ranges, TOLERANCE * share)
        numbered: dict[int, int] = {}
        for i, n in open_.items():
            n.cut = cuts[i]
            n.left = Node(n.shards // 2, n.first)
            n.right = Node(n.shards - n.shards // 2, n.first + n.shards // 2)
        for i, n in enumerate(_frontier(root)):
            numbered[n.first] = i
        before = _frontier_before(root, open_)
        moved = F.coalesce(*[
            F.when(F.col("node") == i, F.lit(numbered[n.first]) if n.cut is None or i not in open_ else F.when(
                F.col(n.dimension) < n.cut, numbered[n.left.first]).otherwise(numbered[n.right.first]))
            for i, n in before.items()
        ])
        rows = materialize(rows.withColumn("node", moved), "kd-level")
    first = {i: n.first for i, n in enumerate(_frontier(root))}
    return root, rows.withColumn("shard", _by_node(first, None)).drop("node")


def _extent(x: dict, d: str) -> int:
    return x[f"hi_{d}"] // _TIES - x[f"lo_{d}"] // _TIES


def _frontier_before(root: Node, open_: dict[int, Node]) -> dict[int, Node]:
    """The nodes as numbered before the open ones were cut."""
    cut = {id(n) for n in open_.values()}

    def walk(n: Node) -> list[Node]:
        return [n] if n.cut is None or id(n) in cut else walk(n.left) + walk(n.right)

    return dict(enumerate(walk(root)))


def number_slots(rows: DataFrame, key: Column, shards: int) -> DataFrame:
    """Adds ``slot``, gapless from 0 within each shard.

    Rows are numbered inside small parts of a shard and shifted by the sizes of the parts before, so no shard is one task.
    """
    parts = ranged(rows.count(), SLOT_ROWS * shards, 4)
    cut = rows.withColumn("__part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    sizes = cut.groupBy("shard", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("shard").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("shard", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = W.partitionBy("shard", "__part").orderBy(key, F.xxhash64(*rows.columns))
    return cut.withColumn("__rank", F.row_number().over(inside)).join(offsets, ["shard", "__part"]).withColumn(
        "slot", (F.col("__before") + F.col("__rank") - 1).cast("long")
    ).select(*rows.columns, "slot")


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    The target of a shard is the total size over ``shards``; a row's size is its text's UTF-8 bytes plus 16, a missing text
    having none. Dimensions: size, source, language and position in the id range. A missing value is 0, repeated rows are
    divided like any others, an empty table gives none. Columns beside ``doc_id``, ``text``, ``lang`` and ``source`` are ignored.
    """
    blob = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    code = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(1 << 16))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 16).cast("long").alias("size"),
        F.crc32(blob).alias("text_crc32"), code("source").alias("d_source"), code("lang").alias("d_lang"),
        F.pmod(F.col("doc_id").cast("long"), F.lit(2**31)).alias("d_id"),
    )
    rows = rows.withColumn("d_size", F.least(F.floor(F.log2(F.col("size").cast("double")) * 1024), F.lit(2**20)))
    dims = ["d_size", "d_source", "d_lang", "d_id"]
    # rows alike in all of this still differ by a number, landed once so that every later read sees the same one
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "kd-numbered")
    rows = materialize(with_keys(rows, dims, F.struct("doc_id", "text_crc32", "size", "row")), "kd-rows")
    _, placed = build_tree(rows, dims, shards)
    placed = placed.select("doc_id", "size", "text_crc32", "row", "shard")
    return number_slots(placed, F.struct("doc_id", "row"), shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
