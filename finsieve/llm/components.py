"""Connected components of a graph held as a table: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsieve.session import drop, materialize, scratch


def _checksum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def _lowest(pairs: DataFrame) -> DataFrame:
    """Smallest neighbour of every ``u``; landed so that the join after it exchanges both sides and may split a hub."""
    return materialize(pairs.groupBy("u").agg(F.min("v").alias("m")), "components-lowest")


def connected(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (u long, v long), landed: root is the smallest node of its component.

    Each round hangs neighbours under the smallest node they know; the number of rounds is logarithmic in the longest path.
    Edges are the only state, landed after every round; what a round has read goes when it ends. A node with a third of all edges is
    aggregated map-side, and its joins can be split. Loops are ignored; an empty graph gives no rows.
    """
    with scratch(edges.sparkSession) as keep:
        current = materialize(
            edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components"
        )
        state = _checksum(current)
        while state[0]:
            both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
            lowest = _lowest(both)
            large = materialize(both.join(lowest, "u").filter("v > u").select(
                F.col("v").alias("u"), F.least("u", "m").alias("v")
            ).distinct(), "components-large")
            drop(current, lowest)
            lowest = _lowest(large)
            joined = large.join(lowest, "u")
            small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                joined.select("u", F.col("m").alias("v"))
            ).filter("u <> v").distinct()
            current = materialize(small, "components")
            drop(large, lowest)
            before, state = state, _checksum(current)
            if state == before:
                break
        roots = current.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
        return keep(materialize(current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), label))
