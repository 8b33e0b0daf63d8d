"""Minority oversampling by interpolation between exact nearest neighbours.

Rows are (cik, year, y, features array<double>). Neighbours are found around
pivots: every row belongs to its nearest pivot, and rows in the order of
(pivot, distance to it, key) are cut into blocks of bounded size. A row first
searches its own block, which with the distances to the pivots bounds how far
its k-th neighbour can be; by the triangle inequality it then visits only
blocks that can hold something as near. Each visit is one pair of a row and a
block; pairs of rows never leave a task. Equal distances go to the smallest
key, and blocks keep their smallest key, so many equal rows are not a case of
their own. All draws are digests of the row key, so the result does not depend
on partitioning or on re-runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finsieve.session import materialize, scratch

BLOCK = 2000
#: Rows per pivot, and the most pivots and blocks; beyond them cells and blocks grow.
PER_PIVOT = 200
MOST_PIVOTS = 256
MOST_BLOCKS = 20_000
MIN_POSITIVES = 6
MAX_RATE = 0.3
_SLACK = 1e-9


def class_counts(df: DataFrame, label: str = "y") -> tuple[int, int]:
    """(rows, positives)."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(label), F.lit(0)).alias("pos")).first()
    return row["n"], int(row["pos"])


def positive_weight(n: int, pos: int) -> float:
    return (n - pos) / max(pos, 1)


def _squares(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances, summed feature by feature."""
    dist = np.zeros((len(rows), len(points)))
    for f in range(points.shape[1]):
        dist += (rows[:, f, None] - points[None, :, f]) ** 2
    return dist


def _nearest(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of a block per row, among equal distances those with the smallest key."""
    right = right.sort_values(["cik", "year"], kind="stable", ignore_index=True)
    points, rows = np.vstack(right["features"].to_numpy()), np.vstack(left["features"].to_numpy())
    place = {key: i for i, key in enumerate(zip(right["cik"], right["year"], strict=True))}
    own = np.array([place.get(key, -1) for key in zip(left["cik"], left["year"], strict=True)])
    take = min(k, len(right))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for lo in range(0, len(rows), 256):
        dist = _squares(rows[lo:lo + 256], points)
        mine = own[lo:lo + 256]
        dist[np.flatnonzero(mine >= 0), mine[mine >= 0]] = np.inf
        # rows come in key order, so a stable sort of what reaches the k-th distance breaks ties by key
        edge = np.partition(dist, take - 1, axis=1)[:, take - 1]
        for i in range(len(dist)):
            near = np.flatnonzero(dist[i] <= edge[i])
            near = near[np.argsort(dist[i][near], kind="stable")][:take]
            near = near[np.isfinite(dist[i][near])]
            out.append((np.full(len(near), lo + i), near, dist[i][near]))
    at, near, dist = (np.concatenate(x) for x in zip(*out, strict=True))
    return pd.DataFrame({
        "cik": left["cik"].to_numpy()[at], "year": left["year"].to_numpy()[at], "nb_cik": right["cik"].to_numpy()[near],
        "nb_year": right["year"].to_numpy()[near], "dist": dist,
    })


_NEAR = "cik string, year int, nb_cik string, nb_year int, dist double"


def _pivots(minority: DataFrame, pos: int, seed: int) -> np.ndarray:
    """Rows with the smallest hashes; at most ``MOST_PIVOTS`` come to the driver."""
    count = min(MOST_PIVOTS, max(1, pos // PER_PIVOT))
    drawn = minority.select("features", F.xxhash64("cik", "year", F.lit(seed)).alias("h"), "cik", "year").orderBy("h", "cik", "year").limit(count)
    return np.array([r["features"] for r in drawn.collect()], float)


def _placed(minority: DataFrame, pivots: np.ndarray, pos: int) -> DataFrame:
    """(cik, year, features, cell, radius, block), landed: rows in the order of (cell, radius, key), cut into blocks."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                dist = _squares(np.vstack(part["features"].to_numpy()), pivots)
                cell = dist.argmin(axis=1)
                yield part.assign(cell=cell.astype(np.int32), radius=np.sqrt(dist[np.arange(len(part)), cell]))

    assigned = minority.select("cik", "year", "features").mapInPandas(
        run, "cik string, year int, features array<double>, cell int, radius double"
    )
    blocks = min(MOST_BLOCKS, max(1, -(-pos // BLOCK)))
    ordered = assigned.repartitionByRange(blocks, "cell", "radius", "cik", "year") if blocks > 1 else assigned.coalesce(1)
    return materialize(ordered.withColumn("block", F.spark_partition_id()), "smote-blocks")


def _visits(placed: DataFrame, pivots: np.ndarray, k: int, own: DataFrame) -> DataFrame:
    """(cik, year, features, to_block, to_cell): the other blocks each row has to search.

    A block's part of a cell is known by its radii, its smallest key, and the k + 1 smallest radii, which bound the k-th distance of any row.
    """
    table = sorted(_units(placed, k).collect(), key=lambda r: (r["cell"], r["low"], r["block"]))  # at most MOST_BLOCKS + pivots rows
    block, cell = (np.array([r[c] for r in table]) for c in ("block", "cell"))
    low, high = (np.array([r[c] for r in table]) for c in ("low", "high"))
    first = [tuple(r["first"]) for r in table]
    radii = np.concatenate([r["least"] for r in table])
    radii_cell = np.repeat(cell, [len(r["least"]) for r in table])
    between = np.sqrt(_squares(pivots, pivots))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part) == 0:
                continue
            to_pivot = np.sqrt(_squares(np.vstack(part["features"].to_numpy()), pivots))
            rows, units_of = [], []
            for i, (c, b, kth, key) in enumerate(zip(part["cell"], part["block"], part["kth"], part["kth_key"], strict=True)):
                # the row itself is one of the k + 1 nearest
                reach = np.partition(to_pivot[i][radii_cell] + radii, k)[k] if len(radii) > k else np.inf
                bound = min(reach, np.inf if kth is None or np.isnan(kth) else np.sqrt(kth))
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = np.where(between[c] > 0, (to_pivot[i] ** 2 - to_pivot[i][c] ** 2) / (2 * between[c]), 0.0)[cell]
                least = np.maximum.reduce([plane, to_pivot[i][cell] - high, low - to_pivot[i][cell], np.zeros(len(cell))])
                slack = _SLACK * (1 + bound + to_pivot[i][cell])
                wanted = (least <= bound + slack) & ~((block == b) & (cell == c))
                if kth is not None and kth == 0:  # nothing is nearer; equal rows count by key only
                    wanted &= np.array([f < tuple(key) for f in first])
                hit = np.flatnonzero(wanted)
                rows.append(np.full(len(hit), i))
                units_of.append(hit)
            at, to = np.concatenate(rows), np.concatenate(units_of)
            yield pd.DataFrame({
                "cik": part["cik"].to_numpy()[at], "year": part["year"].to_numpy()[at], "features": part["features"].to_numpy()[at],
                "to_block": block[to].astype(np.int32), "to_cell": cell[to].astype(np.int32),
            })

    kth = own.groupBy("cik", "year").agg(
        F.when(F.count(F.lit(1)) == k, F.max("dist")).alias("kth"), F.max(F.struct("dist", "nb_cik", "nb_year")).alias("e")
    ).select("cik", "year", "kth", F.struct("e.nb_cik", "e.nb_year").alias("kth_key"))
    known = placed.join(kth, ["cik", "year"], "left").select("cik", "year", "features", "cell", "block", "kth", "kth_key")
    return known.mapInPandas(run, "cik string, year int, features array<double>, to_block int, to_cell int")


def _units(placed: DataFrame, k: int) -> DataFrame:
    """(block, cell, low, high, first, least) of every part of a cell that a block holds."""
    def least(part: pd.DataFrame) -> pd.DataFrame:
        radius = np.sort(part["radius"].to_numpy())
        first = min(zip(part["cik"], part["year"], strict=True))
        return pd.DataFrame([{
            "block": part["block"].iat[0], "cell": part["cell"].iat[0], "low": radius[0], "high": radius[-1], "first": first, "least": radius[:k + 1].tolist(),
        }])

    return placed.select("block", "cell", "radius", "cik", "year").groupBy("block", "cell").applyInPandas(
        least, "block int, cell int, low double, high double, first struct<cik: string, year: int>, least array<double>"
    )


def searched(minority: DataFrame, k: int, pos: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(candidates, visits): each row's nearest of every block it searched, and the visits to other blocks."""
    pivots = _pivots(minority, pos, seed)
    placed = _placed(minority, pivots, pos)
    unit = ["block", "cell"]

    def inside(part: pd.DataFrame) -> pd.DataFrame:
        return _nearest(part, part, k)

    def across(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _nearest(left, right, k) if len(left) and len(right) else pd.DataFrame(columns=["cik", "year", "nb_cik", "nb_year", "dist"])

    own = materialize(placed.groupBy(*unit).applyInPandas(inside, _NEAR), "smote-own")
    visits = materialize(_visits(placed, pivots, k, own), "smote-visits")
    # rows that visit a block come in groups of at most a block's size as well
    parts = visits.groupBy("to_block", "to_cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("cik", "year"), F.col("parts")).cast("int").alias("part")
    left = visits.join(parts, ["to_block", "to_cell"]).select(F.col("to_block").alias("block"), F.col("to_cell").alias("cell"), part, "cik", "year", "features")
    right = placed.join(parts.select(F.col("to_block").alias("block"), F.col("to_cell").alias("cell"), "parts"), unit).select(
        *unit, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "cik", "year", "features"
    )
    met = left.groupBy(*unit, "part").cogroup(right.groupBy(*unit, "part")).applyInPandas(across, _NEAR)
    return own.unionByName(met), visits


def neighbours(minority: DataFrame, k: int, pos: int, seed: int) -> DataFrame:
    """(cik, year, nb_cik, nb_year, dist, nb): the k nearest other minority rows."""
    near, _ = searched(minority, k, pos, seed)
    # at most k rows per key and searched block reach this window
    order = Window.partitionBy("cik", "year").orderBy("dist", "nb_cik", "nb_year")
    return near.withColumn("nb", F.row_number().over(order)).filter(F.col("nb") <= k)


def _numbered(minority: DataFrame, pos: int, seed: int) -> DataFrame:
    """Minority rows with a dense index 0..pos-1, ranked inside blocks only."""
    blocks = max(1, -(-pos // BLOCK))
    b = F.pmod(F.xxhash64("cik", "year", F.lit(seed)), F.lit(blocks)).alias("b")
    placed = minority.select("cik", "year", b)
    offsets = placed.groupBy("b").agg(F.count(F.lit(1)).alias("n")).select(
        "b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    inside = F.row_number().over(Window.partitionBy("b").orderBy("cik", "year")) - 1
    return placed.withColumn("i", inside).join(offsets, "b").select("cik", "year", (F.col("before") + F.col("i")).alias("i"))


def _draw(seed: int, *keys: str) -> Column:
    """Uniform number in [0, 1) from the digest of a row key, the same in any engine."""
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 10), 16, 10).cast("double") / F.lit(float(2**40))


def synthetic_rows(minority: DataFrame, n_new: int, pos: int, seed: int = 42) -> DataFrame:
    """``n_new`` rows (features, y=1) spread evenly over the minority rows,
    each a random point between a row and one of its k nearest.

    Features move with the pairs of neighbours, of which there are at most
    k per minority row, not with the new rows.
    """
    k = min(5, pos - 1)
    i = F.col("i").cast("decimal(38,0)")
    # row i makes floor((i+1)*n/pos) - floor(i*n/pos) copies, n_new in total
    share = (F.floor((i + 1) * n_new / pos) - F.floor(i * n_new / pos)).cast("int")
    plan = _numbered(minority, pos, seed).select("cik", "year", share.alias("copies")).filter("copies > 0").select(
        "cik", "year", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    ).select(
        "cik", "year", "copy", (F.floor(_draw(seed, "cik", "year", "copy") * k) + 1).cast("int").alias("nb"),
        _draw(seed + 1, "cik", "year", "copy").alias("gap"),
    )
    base = minority.select("cik", "year", F.col("features").alias("x"))
    other = minority.select(F.col("cik").alias("nb_cik"), F.col("year").alias("nb_year"), F.col("features").alias("z"))
    with scratch(minority.sparkSession) as keep:
        near = keep(materialize(neighbours(minority, k, pos, seed), "smote-near"))
    chosen = plan.join(near, ["cik", "year", "nb"]).groupBy("cik", "year", "nb", "nb_cik", "nb_year").agg(
        F.collect_list(F.struct("copy", "gap")).alias("made")
    )
    both = chosen.join(other, ["nb_cik", "nb_year"]).join(base, ["cik", "year"])
    return both.select("cik", "year", "nb", "x", "z", F.inline("made")).select(
        "cik", "year", "copy", "nb", "gap", F.lit(1).alias("y"),
        F.zip_with("x", "z", lambda a, b: a + F.col("gap") * (b - a)).alias("features"),
    )


def oversample(df: DataFrame, seed: int = 42) -> DataFrame:
    """(cik, year, copy, y, features): the rows, as copy 0, plus synthetic positives up to a 1:1 balance, which are landed; none
    with fewer than six positives or more than 30 % of them."""
    n, pos = class_counts(df)
    rows = df.select("cik", "year", F.lit(0).alias("copy"), "y", "features")
    if pos < MIN_POSITIVES or pos / n > MAX_RATE:
        return rows
    with scratch(df.sparkSession) as keep:
        made = synthetic_rows(df.filter("y = 1"), n - 2 * pos, pos, seed).select(*rows.columns)
        return rows.unionByName(keep(materialize(made, "smote-made")))
