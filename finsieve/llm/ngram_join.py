"""Jaccard self-join on word n-grams: MinHash banding, then verification on the full n-gram sets.

Words are runs of bytes other than space and 09-0D, with A-Z in lower case. A text's set holds its runs of ``width`` words; a
text of fewer words has one element made of all of them, an empty or missing text has none and is near to nothing but its
copies. Bands and rows are chosen so that a pair at the threshold is found with probability ``RECALL`` or more, a nearer pair more
surely. Texts with equal words are one node, so copies meet nowhere as pairs.

Repeated ids are separate documents; a missing id is one as well and never names a class that has another. Other columns are
ignored by ``classes`` and kept by ``keep_one_per_class``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsieve.llm import near, tokens
from finsieve.llm.marks import mark, marked
from finsieve.session import materialize

WIDTH = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 192
_NO_ID = (1 << 63) - 1


def _sequence_hash(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One hash for the words of each row, in their order."""
    place = (np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))).astype(np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(tokens.mix(hashes + place * np.uint64(0x9E3779B97F4A7C15)), out=sums[1:])
    return tokens.mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64))


def _word_rows(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, data, offsets in tokens.text_chunks(column, 1 << 19):
        found = tokens.spans(data, offsets, tokens.NOT_SPACE)
        yield lo, hi, tokens.Prefix(data).of(found.starts, found.ends), found.first


def hashed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, mark, node, buckets) of every document; ``mark`` hashes the text as written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, words, first in _word_rows(b.column("text")):
                grams, begin = tokens.shingles(words, first, width)
                keys = near.bucket_keys(grams, begin, bands, rows)
                some = np.diff(begin) > 0
                lists = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), b.column("mark").slice(lo, hi - lo), pa.array(_sequence_hash(words, first).view(np.int64)),
                     tokens.list_array(keys[some].ravel().view(np.int64), lists, pa.int64())],
                    names=["doc_id", "mark", "node", "buckets"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _mark().alias("mark")).mapInArrow(
        run, "doc_id long, mark long, node long, buckets array<long>"
    )


def _mark() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _sets(docs: DataFrame, candidates: DataFrame, width: int) -> DataFrame:
    """(node, elements) for the representative document of every candidate (node, rep)."""
    bitmap = mark(candidates, _picks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            for lo, hi, words, first in _word_rows(b.column("text")):
                node = _sequence_hash(words, first).view(np.int64)
                chosen = np.flatnonzero(marked(bitmap.value, pick_of(node, ids[lo:hi])))
                if len(chosen) == 0:
                    continue
                grams, begin = tokens.shingles(words, first, width)
                sets = [np.unique(grams[begin[k]:begin[k + 1]]).tobytes() for k in chosen]
                yield pa.RecordBatch.from_arrays([pa.array(node[chosen]), pa.array(sets, pa.binary())], names=["node", "elements"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "node long, elements binary")


def pick_of(node: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    """Key of a document among the copies of its node."""
    return (tokens.mix(doc_id.view(np.uint64)) ^ node.view(np.uint64)).view(np.int64)


def _picks(b: pa.RecordBatch) -> np.ndarray:
    return pick_of(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("node", "rep")))


def classes(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, mark, class_id, n_links, class_size, kept), one row per document.

    ``class_id`` is the smallest id in the document's class; ``n_links`` the number of other documents, copies included, whose
    similarity with it is ``threshold`` or more; ``class_size`` the number of documents of the class. ``kept`` holds for the
    documents of the smallest (id, mark) of the class: one, or rows alike in both.
    """
    bands, rows = near.choose_banding(threshold, recall, MAX_HASHES)
    items = materialize(hashed(docs, width, bands, rows), "ngram-items")
    place = F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "mark")
    nodes = materialize(
        items.groupBy("node").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")), "ngram-nodes"
    )

    def sets_of(candidates: DataFrame) -> DataFrame:
        reps = candidates.select("node").join(nodes.select("node", F.col("first.id").alias("rep")), "node")
        return _sets(docs, reps, width)

    linked = materialize(near.near_classes(items.select("node", "buckets"), iter, bands, nodes, sets_of, threshold), "ngram-linked")
    known = materialize(nodes.join(linked, "node", "left").select(
        "node", "first", "copies", F.coalesce("root", "node").alias("root"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    ), "ngram-known")
    named = materialize(
        known.groupBy("root").agg(F.min("first").alias("best"), F.sum("copies").alias("class_size")), "ngram-classes"
    )
    per_node = materialize(known.join(named, "root").select("node", "best", "n_links", "class_size"), "ngram-answers")
    return items.select("doc_id", "mark", "node").join(per_node, "node").select(
        "doc_id", "mark", F.expr(f"nullif(best.id, {_NO_ID})").alias("class_id"), "n_links", "class_size",
        ((F.coalesce("doc_id", F.lit(_NO_ID)) == F.col("best.id")) & (F.col("mark") == F.col("best.mark"))).alias("kept"),
    )


def keep_one_per_class(docs: DataFrame, **settings: float) -> DataFrame:
    """The rows of ``docs`` that stand for their class, with all their columns; one row of each class stays."""
    answers = materialize(classes(docs, **settings), "ngram-decided")
    key = [F.coalesce("doc_id", F.lit(_NO_ID)).alias("__id"), F.col("mark").alias("__mark")]
    drop = answers.filter("not kept").select(*key).distinct()
    twice = answers.filter("kept and class_size > 1").groupBy(*key).count().filter("count > 1").drop("count")
    keyed = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), "__mark": _mark()})
    kept = keyed.join(drop.withColumn("__drop", F.lit(1)).unionByName(twice.withColumn("__drop", F.lit(0))), ["__id", "__mark"], "left")
    return kept.filter("__drop is null").unionByName(
        kept.filter("__drop = 0").dropDuplicates(["__id", "__mark"])
    ).drop("__id", "__mark", "__drop")
