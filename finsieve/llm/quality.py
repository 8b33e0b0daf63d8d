"""Quality by co-training: a text view and a page-metadata view teach each other, then their calibrated scores are combined.

The text view sees what is written: shares of byte kinds and signs, word shapes, words repeated at once, hashed words. The
metadata view sees what is known about the page: source, language, length. Both are logistic models. They start from labelled
rows; in every round each view labels the unlabelled rows it is surest of for the other one, provided such calls were right
often enough on rows kept aside. The kept-aside rows also calibrate both views and set how much each counts in the end.

The labelled rows are at most about ``MAX_LABELLED``, drawn by a hash of ``doc_id``, one row per id. Every round ranks all
unlabelled rows by both views in Spark; only the ``TAUGHT`` surest of a view and class, which the fit takes, reach the driver.
Every document is scored on its whole text. A missing text is empty, missing metadata is a value of its own. Repeated
labels of a document count as good only if all do. Without labels of both kinds every document gets the share of good ones
(1 without any label). Extra columns pass through, also those with names used here; ``score`` alone replaces the three it adds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finsieve.llm import tokens
from finsieve.llm.sequences import may_hold
from finsieve.llm.shared import Shipped
from finsieve.session import materialize

MAX_LABELLED = 12_000
ROUNDS = 4
#: Rows a view labels for the other per round and class, and how often such calls must be right.
TAUGHT = 400
TRUST = 0.97
SCORES = ("text_score", "page_score", "quality_score")
_NO_ID = -(1 << 63)
WORD_COLUMNS = 128
SOURCE_COLUMNS = 64
_SIGNS = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)
_UPPER = (np.arange(256) >= 65) & (np.arange(256) < 91)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) < 58)
_WIDE = np.arange(256) >= 128


def text_features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, features) of the text view."""
    kind = np.zeros(256, np.int64)
    kind[_SIGNS] = np.arange(1, len(_SIGNS) + 1)
    kind[_UPPER], kind[_DIGIT], kind[_WIDE], kind[10] = (len(_SIGNS) + k for k in (1, 2, 3, 4))
    kinds = len(_SIGNS) + 5
    for lo, hi, data, offsets in tokens.text_chunks(column, 1 << 19):
        n = hi - lo
        row = np.repeat(np.arange(n), np.diff(offsets))
        size = np.maximum(np.diff(offsets), 1)[:, None]
        byte = np.bincount(row * kinds + kind[data], minlength=n * kinds).reshape(n, kinds)[:, 1:] / size
        found = tokens.spans(data, offsets, tokens.NOT_SPACE)
        word = tokens.Prefix(data).of(found.starts, found.ends)
        owner = tokens.row_index(found.first)
        words = np.maximum(np.diff(found.first), 1)
        again = np.zeros(len(word), bool)
        again[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
        long = found.ends - found.starts
        last = data[found.ends - 1] if len(word) else data[:0]
        signed = ~tokens.ALNUM[last]
        double = signed & (long > 1) & (data[found.ends - 2] == last if len(word) else False)
        per = lambda flags: np.bincount(owner, flags, minlength=n) / words
        shape = np.stack([
            np.log1p(np.diff(found.first)), per(again), per(double), per(signed), per(long) / 10, per(long == 1),
            per(long > 20), np.bincount(owner, long.astype(float) ** 2, minlength=n) / words / 200,
        ], axis=1)
        hashed = np.bincount(owner * WORD_COLUMNS + (word >> np.uint64(57)).astype(np.int64), minlength=n * WORD_COLUMNS)
        yield lo, hi, np.concatenate([
            np.log1p(200 * byte), shape, np.log1p(20 * hashed.reshape(n, WORD_COLUMNS) / words[:, None])
        ], axis=1).astype(np.float32)


def metadata_features(source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """Features of the metadata view: hashed source, hashed language, length."""
    n = len(source)
    out = np.zeros((n, SOURCE_COLUMNS + 16 + 3), np.float32)
    for column, width, start in ((source, SOURCE_COLUMNS, 0), (lang, 16, SOURCE_COLUMNS)):
        data, offsets = tokens.text_buffers(column)
        hashes = tokens.Prefix(data, fold=False).of(offsets[:-1], offsets[1:])
        out[np.arange(n), start + (hashes % np.uint64(width)).astype(np.int64)] = 1
    size = np.maximum(np.nan_to_num(n_chars.cast(pa.float64()).to_numpy(zero_copy_only=False)), 0)
    level = np.log1p(size)
    out[:, -3:] = np.stack([level / 10, (level / 10) ** 2, size == 0], axis=1)
    return out


@dataclass
class Logistic:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.center) / self.scale) @ self.weights + self.bias


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 300) -> Logistic:
    """Logistic regression by accelerated gradient steps on standardised features."""
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = ((x - center) / scale).astype(np.float32)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w, b = np.zeros(z.shape[1], np.float32), float(np.log(share / (1 - share)))
    ahead, ahead_b = w.copy(), b
    # a bound of the curvature by a few power iterations
    v = np.ones(z.shape[1], np.float32)
    for _ in range(20):
        v = z.T @ (z @ v)
        norm = float(np.linalg.norm(v)) or 1.0
        v /= norm
    rate = 1 / (0.25 * (norm / len(z) + 1) + penalty)
    for k in range(steps):
        d = ((1 / (1 + np.exp(-np.clip(z @ ahead + ahead_b, -30, 30))) - y) / len(y)).astype(np.float32)
        new, new_b = ahead - rate * (z.T @ d + penalty * ahead), ahead_b - rate * float(d.sum())
        pull = k / (k + 3)
        ahead, ahead_b = new + pull * (new - w), new_b + pull * (new_b - b)
        w, b = new, new_b
    return Logistic(center, scale, w, b)


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


@dataclass
class Pair:
    """Two fitted views with their calibrations (slope, offset) and the weights of the final mix."""

    text: Logistic | None
    page: Logistic | None
    calibrations: list[tuple[float, float]]
    mix: np.ndarray
    constant: float = 1.0

    def scores(self, x_text: np.ndarray, x_page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None or self.page is None:
            same = np.full(len(x_text), self.constant)
            return same, same, same
        t, p = (
            slope * view.margin(x) + offset
            for view, x, (slope, offset) in zip((self.text, self.page), (x_text, x_page), self.calibrations, strict=True)
        )
        return _chance(t), _chance(p), _chance(self.mix[0] * t + self.mix[1] * p + self.mix[2])


def _line(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into calibrated log-odds."""
    m = fit_logistic(margins[:, None], y)
    slope = float(m.weights[0] / m.scale[0])
    return slope, float(m.bias - m.weights[0] * m.center[0] / m.scale[0])


class Surest(NamedTuple):
    """The rows a view is surest of for one label, surest first: row keys, calibrated margins, both views' features."""

    keys: list[tuple[int, int]]
    sure: np.ndarray
    x: dict[str, np.ndarray]


#: (models, calibrations, keys taught so far by view) to the surest rows per view and label.
Ranked = Callable[[dict[str, Logistic], dict[str, tuple[float, float]], dict[str, set]], dict[tuple[str, int], Surest]]


def co_train(x: dict[str, np.ndarray], y: np.ndarray, held: np.ndarray, ranked: Ranked) -> Pair:
    """Both views after ``ROUNDS`` of exchange; ``held`` rows calibrate, ``ranked`` finds what to teach among unlabelled rows."""
    views = ("text", "page")
    taught: dict[str, dict[tuple[int, int], tuple[int, np.ndarray]]] = {v: {} for v in views}
    calibrations = {v: (1.0, 0.0) for v in views}
    models: dict[str, Logistic] = {}

    def refit() -> None:
        for v in views:
            extra = [taught[v][k] for k in sorted(taught[v])]
            rows = np.concatenate([x[v][~held], *(f[None] for _, f in extra)])
            models[v] = fit_logistic(rows, np.concatenate([y[~held], np.array([label for label, _ in extra], float)]))
            calibrations[v] = _line(models[v].margin(x[v][held]), y[held])

    refit()
    for _ in range(ROUNDS):
        best = ranked(models, calibrations, {v: set(taught[v]) for v in views})
        for v, other in (views, views[::-1]):
            slope, offset = calibrations[v]
            checked = slope * models[v].margin(x[v][held]) + offset
            for label, sign in ((1, 1.0), (0, -1.0)):
                found = best.get((v, label))
                if found is None:
                    continue
                called = y[held][sign * checked >= sign * found.sure[-1]]
                if len(called) and (called == label).mean() >= TRUST:
                    for k, key in enumerate(found.keys):
                        taught[other].setdefault(key, (label, found.x[other][k]))
        refit()
    margins = np.stack([calibrations[v][0] * models[v].margin(x[v][held]) + calibrations[v][1] for v in views], axis=1)
    last = fit_logistic(margins, y[held])
    weights = last.weights / last.scale
    return Pair(models["text"], models["page"], [calibrations[v] for v in views],
                np.array([*weights, last.bias - float((weights * last.center).sum())]))


def _ranker(unlabelled: DataFrame, wanted: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> Ranked:
    """Ranks all rows of ``unlabelled`` (doc_id, mark, and the features' columns), or those ``wanted``, anew whenever it is asked.

    A task keeps the ``TAUGHT`` surest rows of its own per view and class, with their features; the surest of all are found among them.
    Rows are picked where they are ranked: a pass of its own for that would hold a second Python worker per task.
    """
    spark = unlabelled.sparkSession
    views = ("text", "page")

    def ranked(models: dict[str, Logistic], calibrations: dict[str, tuple[float, float]], taken: dict[str, set]) -> dict[tuple[str, int], Surest]:
        shipped = Shipped(spark, (models, calibrations, taken))  # a few KB, and at most ROUNDS x 4 x TAUGHT keys

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models, calibrations, taken = shipped.value
            held: dict[tuple[str, int], list[tuple]] = {(v, label): [] for v in views for label in (1, 0)}
            for b in batches:
                if wanted is not None:
                    b = b.filter(pa.array(wanted(b)))
                page = metadata_features(b.column("source"), b.column("lang"), b.column("n_chars"))
                ids, marks = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "mark"))
                for lo, hi, text in text_features(b.column("text")):
                    x = {"text": text, "page": page[lo:hi]}
                    for v, other in (views, views[::-1]):
                        slope, offset = calibrations[v]
                        sure = slope * models[v].margin(x[v]) + offset
                        for label, sign in ((1, 1.0), (0, -1.0)):
                            order = np.argsort(-sign * sure, kind="stable")[:TAUGHT + len(taken[other])]
                            new = [(-sign * float(sure[k]), int(ids[lo + k]), int(marks[lo + k]), x["text"][k].tobytes(), x["page"][k].tobytes()) for k in order
                                   if (int(ids[lo + k]), int(marks[lo + k])) not in taken[other]]
                            merged = {row[1:3]: row for row in sorted(held[v, label] + new, key=lambda r: r[:3])}
                            held[v, label] = sorted(merged.values(), key=lambda r: r[:3])[:TAUGHT]
            for (v, label), rows in held.items():
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v] * len(rows)), pa.array([label] * len(rows), pa.int32()), *(
                            pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.float64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())))],
                        names=["view", "label", "order", "doc_id", "mark", "text", "page"],
                    )

        rows = materialize(unlabelled.mapInArrow(
            run, "view string, label int, order double, doc_id long, mark long, text binary, page binary"
        ), "quality-surest")
        place = ["order", "doc_id", "mark"]
        out = {}
        for v in views:
            for label, sign in ((1, 1.0), (0, -1.0)):
                mine = rows.filter((F.col("view") == v) & (F.col("label") == label))
                keys = mine.select(*place).distinct().orderBy(*place).limit(TAUGHT).collect()
                if not keys:
                    continue
                best = mine.filter(F.col("order") <= keys[-1]["order"]).dropDuplicates(["doc_id", "mark"]).orderBy(*place).limit(TAUGHT).collect()
                out[v, label] = Surest(
                    [(r["doc_id"], r["mark"]) for r in best], np.array([-sign * r["order"] for r in best]),
                    {w: np.stack([np.frombuffer(r[w], np.float32) for r in best]) for w in views},
                )
        return out

    return ranked


def _read(docs: DataFrame) -> DataFrame:
    """The columns the features need; a missing id is no number of its own and never has a label."""
    text = F.col("text").cast("string")
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark"), text.alias("text"),
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"),
    )


def _features(rows: DataFrame) -> DataFrame:
    """(doc_id, good, text, page) with both views' features as binary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            page = metadata_features(b.column("source"), b.column("lang"), b.column("n_chars"))
            for lo, hi, text in text_features(b.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), b.column("good").slice(lo, hi - lo),
                     pa.array([r.tobytes() for r in text], pa.binary()), pa.array([r.tobytes() for r in page[lo:hi]], pa.binary())],
                    names=["doc_id", "good", "text", "page"],
                )

    return rows.select("doc_id", "good", "text", "source", "lang", "n_chars").mapInArrow(run, "doc_id long, good int, text binary, page binary")


def train(docs: DataFrame, labels: DataFrame) -> Pair:
    """Fits in the driver on the drawn labelled rows and what the rounds teach, about 1 KB of features a row."""
    usable = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("quality").cast("int").alias("good"))
    share = min(1.0, MAX_LABELLED / max(1, usable.count()))
    known = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    rows = _read(docs)
    # broadcast: bounded by MAX_LABELLED; of rows that share an id the one with the smallest hash of its text is learnt from
    one = rows.join(F.broadcast(known), "doc_id").groupBy("doc_id", "good").agg(F.min(F.struct("mark", "text", "source", "lang", "n_chars")).alias("r"))
    labelled = _features(one.select("doc_id", "good", "r.*")).toArrow().sort_by("doc_id")

    def matrix(column: str) -> np.ndarray:
        flat = b"".join(v.as_buffer() for v in labelled.column(column)) if labelled.num_rows else b""
        return np.frombuffer(flat, np.float32).reshape(labelled.num_rows, -1) if labelled.num_rows else np.zeros((0, 0), np.float32)

    y = (labelled.column("good").to_numpy() > 0).astype(np.float64)
    held = tokens.mix(labelled.column("doc_id").to_numpy().astype(np.uint64)) % np.uint64(4) == 0
    if len(y) == 0 or not 0 < y[held].sum() < held.sum() or not 0 < y[~held].sum() < (~held).sum():
        return Pair(None, None, [], np.zeros(3), float(y.mean()) if len(y) else 1.0)
    return co_train({v: matrix(v) for v in ("text", "page")}, y, held, _ranker(*_unlabelled(rows, usable)))


def _unlabelled(rows: DataFrame, labelled: DataFrame) -> tuple[DataFrame, Callable[[pa.RecordBatch], np.ndarray]]:
    """Rows read in place, and which of a batch of them have an id without a label.

    A bitmap over the labelled ids tells most of them. Of rows that may have a label the keys are joined, and only the texts of those
    that turn out to have none move, once.
    """
    named = rows.withColumn("zero", F.lit(0).cast("long"))
    chosen = may_hold(labelled.select("doc_id", F.lit(0).cast("long").alias("zero")), labelled.count())

    def keep(df: DataFrame, wanted: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(wanted(b)))

        return df.mapInArrow(run, df.schema)

    perhaps = keep(named.select("doc_id", "zero", "mark"), chosen).select("doc_id", "mark").distinct()
    spared = materialize(perhaps.join(labelled.select("doc_id"), "doc_id", "left_anti").select("doc_id", "mark"), "quality-spared")
    passed = may_hold(spared, spared.count())
    rest = keep(named, lambda b: chosen(b) & passed(b)).join(spared, ["doc_id", "mark"], "left_semi").select(*named.columns)
    every = named.withColumn("joined", F.lit(False)).unionByName(materialize(rest, "quality-rest").withColumn("joined", F.lit(True)))
    return every, lambda b: b.column("joined").to_numpy(zero_copy_only=False) | ~chosen(b)


def _scored(docs: DataFrame, labels: DataFrame, added: list[str]) -> DataFrame:
    """``docs`` with the three scores under the given names, which no column of it has."""
    shared = Shipped(docs.sparkSession, train(docs, labels))  # a few KB
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = shared.value
        for b in batches:
            get = lambda c, kind: b.column(names.index(c)).cast(kind)  # noqa: B023, E731
            page = metadata_features(get("source", pa.string()), get("lang", pa.string()), get("n_chars", pa.int64()))
            for lo, hi, text in text_features(get("text", pa.string())):
                scores = pair.scores(text, page[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [c.slice(lo, hi - lo) for c in b.columns] + [pa.array(s, pa.float64()) for s in scores], names=[*names, *added]
                )

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(c, T.DoubleType()) for c in added)]))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``text_score``, ``page_score`` and ``quality_score``, calibrated chances of being good; columns of these names are replaced."""
    return _scored(docs.drop(*SCORES), labels, list(SCORES))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose combined score reaches ``least``, with all their columns as they were."""
    own = [f"__finsieve_{c}" for c in SCORES]
    return _scored(docs, labels, own).filter(F.col(own[-1]) >= least).select(*docs.columns)
