"""Repeated passages by seed and extend: winnowed anchors are joined, matches around them extended, maximal repeats cut out.

Every window of ``length`` words chooses one anchor, the leftmost of its runs of ``SEED`` words with the smallest hash. Equal
windows choose the same anchor at the same place, so a repeat of ``length`` words cannot miss the join on anchors. An anchor's
reach are the windows that chose it, at most ``length - SEED + 1``.

1. Anchors are counted by hash. One that occurs once is done, and its windows with it.
2. Where all occurrences of an anchor have the same reach, the match extends over all of it, for all of them: no further join.
3. Elsewhere occurrences with equal reach form classes, counted map-side. A class of two or more extends over its reach. What
   is left are the ends of repeats: single occurrences and one representative per class extend window by window, and a
   window met in two classes is a repeat.

Pairs are never listed: a passage in n documents costs n anchor rows and one count. Overlapping windows merge into maximal
repeats. Rows of the anchor tables hold hashes and places only; texts travel only for documents with open ends (3) and for
those that lose words. Which documents these are is told by a bitmap sized by their number; it may let others pass, which costs
time only.

Words are runs of bytes other than space and 09-0D, compared as written. A missing text has no words. Repeated ids and rows
are documents of their own, so two equal rows of ``length`` words are repeats of each other; a missing id stays missing. Empty
tables give empty results. Columns other than ``doc_id`` and ``text`` are ignored. Hashes have 64 bits, and two of them decide
that windows are equal (anchor and window), so among n windows a false repeat is expected n**2 / 2**129 times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsieve.llm import tokens
from finsieve.llm.marks import mark, marked
from finsieve.llm.sequences import NO_ID, Sequence, joined, with_key
from finsieve.session import materialize

LENGTH = 35
SEED = 12
#: Bitmaps have 16 bits a key, up to 2**26 bits; fuller ones select less.
_MOST_BITS = 26
_SLICE = 1 << 16
_CHUNK = 1 << 20


def _words(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, tokens.Spans]]:
    for lo, hi, data, offsets in tokens.text_chunks(text, _CHUNK):
        yield lo, hi, data, tokens.spans(data, offsets, tokens.NOT_SPACE)


class Anchors:
    """Anchors of a chunk of texts: hash, reach hash, row, first window of the reach (word of the row) and number of windows."""

    def __init__(self, data: np.ndarray, found: tokens.Spans, length: int, seed: int):
        words = tokens.Prefix(data, fold=False).of(found.starts, found.ends)
        counts, n = np.diff(found.first), len(words)
        self.sequence = Sequence(words)
        windows = np.flatnonzero(np.arange(n) + length <= np.repeat(found.first[1:], counts))
        if len(windows) == 0:
            self.hash = self.reach = np.zeros(0, np.uint64)
            self.row = self.start = self.count = self.begin = np.zeros(0, np.int64)
            return
        at = np.arange(n - seed + 1)
        hashes = self.sequence.of(at, at + seed)
        grams = sliding_window_view(hashes, length - seed + 1)
        chosen = np.concatenate([
            part + grams[part].argmin(axis=1) for part in (windows[k:k + _SLICE] for k in range(0, len(windows), _SLICE))
        ])
        new = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        place, self.begin = chosen[new], windows[new]
        self.count = np.diff(np.append(new, len(windows)))
        self.hash = hashes[place]
        shape = (place - self.begin) * length + self.count
        self.reach = tokens.mix(self.sequence.of(self.begin, self.begin + self.count + length - 1) + shape.astype(np.uint64))
        self.row = np.searchsorted(found.first, self.begin, side="right") - 1
        self.start = self.begin - found.first[self.row]


def _code(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """First window and number of windows as one long."""
    return start << 12 | count


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def _bits(count: int) -> int:
    return min(max((16 * count).bit_length(), 16), _MOST_BITS)


def _doc_key(doc_id: np.ndarray, text_mark: np.ndarray) -> np.ndarray:
    return (tokens.mix(doc_id.view(np.uint64)) ^ text_mark.view(np.uint64)).view(np.int64)


def _keys_of(table: DataFrame) -> DataFrame:
    """(key): one long per (doc_id, mark)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_doc_key(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "mark"))))], names=["key"])

    return table.select("doc_id", "mark").mapInArrow(run, "key long")


def _chosen(b: pa.RecordBatch, bitmap: Broadcast) -> np.ndarray:
    return marked(bitmap.value, _doc_key(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "mark"))))


def _anchor_hashes(docs: DataFrame, length: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, found in _words(b.column("text")):
                a = Anchors(data, found, length, seed)
                yield pa.RecordBatch.from_arrays([_signed(a.hash), _signed(a.reach)], names=["anchor", "reach"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "anchor long, reach long")


def _occurrences(keyed: DataFrame, repeated: Broadcast, length: int, seed: int) -> DataFrame:
    """(anchor, reach, doc_id, mark, code) of every occurrence of an anchor that may be repeated."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, marks = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "mark"))
            for lo, _, data, found in _words(b.column("text")):
                a = Anchors(data, found, length, seed)
                on = np.flatnonzero(marked(repeated.value, a.hash))
                row = a.row[on] + lo
                yield pa.RecordBatch.from_arrays(
                    [_signed(a.hash[on]), _signed(a.reach[on]), pa.array(ids[row]), pa.array(marks[row]), pa.array(_code(a.start[on], a.count[on]))],
                    names=["anchor", "reach", "doc_id", "mark", "code"],
                )

    return keyed.mapInArrow(run, "anchor long, reach long, doc_id long, mark long, code long")


def _touched(keyed: DataFrame, keys: DataFrame) -> tuple[DataFrame, Broadcast]:
    """The documents whose key may be in ``keys``, and the bitmap that says so."""
    bitmap = mark(_keys_of(keys), "key", _bits(keys.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_chosen(b, bitmap)))

    return keyed.mapInArrow(run, keyed.schema), bitmap


def _windows(keyed: DataFrame, picks: DataFrame, length: int, seed: int) -> DataFrame:
    """(anchor, window, doc_id, mark, code, open) of every window in the reach of the picked occurrences; the text is read
    again, so that picks are places only."""
    per_doc = materialize(picks.groupBy("doc_id", "mark").agg(
        F.collect_set(F.col("code") * 2 + F.col("open").cast("long")).alias("picks")
    ), "repeats-picks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, marks = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "mark"))
            lists = b.column("picks")
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            for lo, hi, data, found in _words(b.column("text")):
                a = Anchors(data, found, length, seed)
                wanted = flat[at[lo]:at[hi]]
                row = np.repeat(np.arange(hi - lo), np.diff(at[lo:hi + 1]))
                # both sides as (row, start): anchors of a row have different starts
                place = found.first[row] + (wanted >> 13)
                which = np.searchsorted(a.begin, place)
                counts = a.count[which]
                total = np.concatenate([[0], np.cumsum(counts)])
                step = np.arange(total[-1]) - np.repeat(total[:-1], counts)
                begin = np.repeat(a.begin[which], counts) + step
                row = np.repeat(row, counts)
                yield pa.RecordBatch.from_arrays(
                    [_signed(np.repeat(a.hash[which], counts)), _signed(a.sequence.of(begin, begin + length)), pa.array(ids[row + lo]),
                     pa.array(marks[row + lo]), pa.array(_code(begin - found.first[row], np.ones(len(begin), np.int64))),
                     pa.array(np.repeat(wanted & 1, counts).astype(bool))],
                    names=["anchor", "window", "doc_id", "mark", "code", "open"],
                )

    docs, _ = _touched(keyed, per_doc)
    return docs.join(per_doc, ["doc_id", "mark"]).select("doc_id", "mark", "text", "picks").mapInArrow(
        run, "anchor long, window long, doc_id long, mark long, code long, open boolean"
    )


def _extents(keyed: DataFrame, length: int, seed: int) -> DataFrame:
    """(doc_id, mark, codes): per document with repeats the reaches, or parts of them, over which matches extend."""
    anchors = _anchor_hashes(keyed, length, seed).groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.min("reach").alias("low"), F.max("reach").alias("high")
    ).filter("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("mixed"))
    anchors = materialize(anchors, "repeats-anchors")
    bitmap = mark(anchors, "anchor", _bits(anchors.count()))
    seen = materialize(_occurrences(keyed, bitmap, length, seed).join(anchors, "anchor"), "repeats-seen")
    place = ["doc_id", "mark", "code"]
    mixed = seen.filter("mixed")
    classes = materialize(mixed.groupBy("anchor", "reach").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*place)).alias("at")
    ), "repeats-classes")
    whole = mixed.join(classes.filter("n > 1").select("anchor", "reach"), ["anchor", "reach"]).select(*place)
    picks = classes.select("at.*", (F.col("n") == 1).alias("open"))
    windows = materialize(_windows(keyed, picks, length, seed), "repeats-windows")
    met = materialize(windows.groupBy("anchor", "window").count().filter("count > 1").select("anchor", "window"), "repeats-met")
    ends = windows.filter("open").join(met, ["anchor", "window"]).select(*place)
    found = seen.filter("not mixed").select(*place).unionByName(whole).unionByName(ends)
    return materialize(found.groupBy("doc_id", "mark").agg(F.collect_set("code").alias("codes")), "repeats-extents")


def _covered(codes: pa.ListArray, lo: int, hi: int, first: np.ndarray, length: int) -> np.ndarray:
    """Whether a repeat covers each word of the rows ``lo`` to ``hi``."""
    lists = codes.slice(lo, hi - lo)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(hi - lo), pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))
    edge = np.zeros(first[-1] + 1, np.int64)
    start = first[row] + (flat >> 12)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + (flat & 0xFFF) + length - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def maximal_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, mark, start, n_words): the longest stretches in which every word lies in a repeated window.

    ``start`` counts words from 0; ``mark`` is a hash of the text, which keeps rows with the same id apart. Rows alike in both
    give their stretches once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, ids, marks = b.column("codes"), b.column("doc_id"), b.column("mark")
            for k in range(b.num_rows):
                flat = codes[k].values.to_numpy(zero_copy_only=False)
                start, end = flat >> 12, (flat >> 12) + (flat & 0xFFF) + length - 1
                order = np.argsort(start, kind="stable")
                start, reach = start[order], np.maximum.accumulate(end[order])
                new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
                ends = reach[np.append(new[1:], len(start)) - 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if ids[k].as_py() == NO_ID else ids[k].as_py()] * len(new), pa.int64()), pa.array([marks[k].as_py()] * len(new), pa.int64()),
                     pa.array(start[new]), pa.array(ends - start[new])], names=["doc_id", "mark", "start", "n_words"],
                )

    return _extents(with_key(docs), length, seed).mapInArrow(run, "doc_id long, mark long, start long, n_words long")


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, text), one row per document: ``text`` holds the words outside all repeats, one space between them."""
    keyed = with_key(docs)
    extents = _extents(keyed, length, seed)
    some, bitmap = _touched(keyed, extents)

    def cut(b: pa.RecordBatch, codes: pa.ListArray | None) -> Iterator[pa.RecordBatch]:
        ids = b.column("doc_id").to_numpy(zero_copy_only=False)
        for lo, hi, data, found in _words(b.column("text")):
            starts, ends, first = found
            gone = np.zeros(len(starts), bool) if codes is None else _covered(codes, lo, hi, first, length)
            removed = np.concatenate([[0], np.cumsum(gone)])[first]
            text = joined(data, starts[~gone], ends[~gone], first - removed)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[lo:hi], mask=ids[lo:hi] == NO_ID), pa.array(np.diff(first)), pa.array(np.diff(removed)), text],
                names=["doc_id", "n_words", "n_removed", "text"],
            )

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from cut(b.filter(pa.array(~_chosen(b, bitmap))), None)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from cut(b, b.column("codes"))

    kind = "doc_id long, n_words long, n_removed long, text string"
    left = some.join(extents, ["doc_id", "mark"], "left").select("doc_id", "text", "codes")
    return keyed.mapInArrow(untouched, kind).unionByName(left.mapInArrow(touched, kind))
