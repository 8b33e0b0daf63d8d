"""Benchmark decontamination by spaced seeds.

A seed mask picks five of the tokens of a window and ignores the others, so a copy with substituted tokens still shares
hashes. Test and training positions are joined on these hashes; every common hash fixes an alignment of an item with a text,
and the alignment is verified token by token: the document is contaminated when some ``WINDOW`` aligned tokens in a row (the whole
item if it is shorter) agree in ``AGREE`` tenths or more. The masks meet every placing of the allowed substitutions.

Tokens are runs of bytes other than space and 09-0D, with A-Z in lower case. Items of fewer than ``SHORT`` tokens get masks of their
own length: each half of the item, and the whole. Items without tokens and missing or empty texts match nothing. Equal items are
searched as one and reported under the smallest id. Rows that share an id are reported as one document, items that share one as one
item; a missing id of either is reported as missing. Other columns are kept by ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsieve.llm import tokens
from finsieve.llm.marks import mark, marked
from finsieve.session import materialize

WINDOW = 16
AGREE = 8
SHORT = 8
#: Offsets of the tokens each mask looks at.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 4, 6, 7), (0, 1, 2, 3, 4))
#: Tokens carried on either side of a hit, and the most tokens in one carried stretch beside them.
PAD = 64
STRETCH = 1024
FILTER_BITS = 26
_NO_ID = (1 << 63) - 1


def short_masks(length: int) -> list[tuple[int, ...]]:
    """Masks for items of ``length`` tokens: with at most one substitution a half is untouched."""
    half = length // 2
    whole = tuple(range(length))
    return [whole] if length < 5 else [whole[:half], whole[half:]]


def _mask_id(mask: tuple[int, ...]) -> int:
    return sum(1 << o for o in mask)


def seeds(words: np.ndarray, first: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(position of each window's first token, hash of the tokens the mask picks); windows stay within their row."""
    reach = mask[-1]
    n = np.maximum(np.diff(first) - reach, 0)
    begin = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], n)
    total = np.full(len(at), np.uint64(_mask_id(mask)), np.uint64)
    for k, offset in enumerate(mask):
        total += words[at + offset] * tokens._STEPS[k + 8]
    return at, tokens.mix(total)


def _masks_for(length: int) -> list[tuple[int, ...]]:
    return list(MASKS) if length >= SHORT else [tuple(o - m[0] for o in m) for m in short_masks(length)]


def _starts_for(length: int) -> list[int]:
    """Offset of each mask's first token within a short item."""
    return [0] * len(MASKS) if length >= SHORT else [m[0] for m in short_masks(length)]


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, data, offsets in tokens.text_chunks(column, 1 << 20):
        found = tokens.spans(data, offsets, tokens.NOT_SPACE)
        yield lo, hi, tokens.Prefix(data).of(found.starts, found.ends), found.first


def item_table(benchmark: DataFrame) -> DataFrame:
    """(item_id, n_tokens, words, positions, seeds) per distinct item with at least one token."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, words, first in _tokens(b.column("text")):
                out: dict[str, list] = {"item_id": b.column("item_id").slice(lo, hi - lo).to_pylist(), "words": [], "positions": [], "seeds": []}
                for k in range(hi - lo):
                    own = words[first[k]:first[k + 1]]
                    edge = np.array([0, len(own)])
                    positions, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                    for mask, start in zip(_masks_for(len(own)), _starts_for(len(own)), strict=True) if len(own) else ():
                        at, h = seeds(own, edge, mask)
                        on = at == start if len(own) < SHORT else slice(None)
                        positions.append(at[on])
                        hashes.append(h[on])
                    out["words"].append(own.tobytes())
                    out["positions"].append(np.concatenate(positions).astype(np.int32))
                    out["seeds"].append(np.concatenate(hashes).view(np.int64))
                yield pa.RecordBatch.from_pydict(out, pa.schema([
                    ("item_id", pa.int64()), ("words", pa.binary()), ("positions", pa.list_(pa.int32())), ("seeds", pa.list_(pa.int64()))
                ]))

    found = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "item_id long, words binary, positions array<int>, seeds array<long>"
    ).filter("length(words) > 0")
    return found.groupBy("words").agg(F.min("item_id").alias("item_id"), F.first("positions").alias("positions"), F.first("seeds").alias("seeds"))


def _stretches(docs: DataFrame, seed_rows: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """(stretch, doc_id, mark, start, words, positions, seeds): the parts of texts around positions whose hash a test item may have."""
    bitmap = mark(seed_rows, "seed", FILTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, words, first in _tokens(b.column("text")):
                at, hashes = [], []
                for mask in masks:
                    pos, h = seeds(words, first, mask)
                    on = marked(bitmap.value, h.view(np.int64))
                    at.append(pos[on])
                    hashes.append(h[on])
                pos, h = np.concatenate(at), np.concatenate(hashes)
                if len(pos) == 0:
                    continue
                order = np.argsort(pos, kind="stable")
                pos, h = pos[order], h[order]
                row = np.searchsorted(first, pos, side="right") - 1
                out: dict[str, list] = {c: [] for c in ("row", "start", "words", "positions", "seeds")}
                begin = 0
                for k in range(1, len(pos) + 1):
                    if k < len(pos) and row[k] == row[begin] and pos[k] - pos[k - 1] <= PAD and pos[k] - pos[begin] <= STRETCH:
                        continue
                    r = row[begin]
                    left = max(first[r], pos[begin] - PAD)
                    right = min(first[r + 1], pos[k - 1] + 2 * PAD)
                    out["row"].append(lo + int(r))
                    out["start"].append(int(left - first[r]))
                    out["words"].append(words[left:right].tobytes())
                    out["positions"].append((pos[begin:k] - left).astype(np.int32))
                    out["seeds"].append(h[begin:k].view(np.int64))
                    begin = k
                rows = pa.array(out.pop("row"), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(rows), b.column("mark").take(rows), pa.array(out["start"], pa.int32()), pa.array(out["words"], pa.binary()),
                     pa.array(out["positions"], pa.list_(pa.int32())), pa.array(out["seeds"], pa.list_(pa.int64()))],
                    names=["doc_id", "mark", "start", "words", "positions", "seeds"],
                )

    named = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _mark().alias("mark"))
    return named.mapInArrow(
        run, "doc_id long, mark long, start int, words binary, positions array<int>, seeds array<long>"
    ).withColumn("stretch", F.monotonically_increasing_id())


def _mark() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def best_window(item: np.ndarray, text: np.ndarray, shift: int) -> tuple[int, int, int]:
    """(agreeing tokens, window length, first item token) of the best window of an alignment; text[shift] meets item[0]."""
    width = min(WINDOW, len(item))
    lo, hi = max(0, -shift), min(len(item), len(text) - shift)
    if hi - lo < width:
        return 0, width, 0
    same = np.concatenate([[0], np.cumsum(item[lo:hi] == text[lo + shift:hi + shift])])
    sums = same[width:] - same[:-width]
    k = int(sums.argmax())
    return int(sums[k]), width, lo + k


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: dict[str, list] = {c: [] for c in ("row", "agreeing", "width", "item_token", "doc_token")}
        items, texts, shifts, starts = (b.column(c) for c in ("item_words", "words", "shift", "start"))
        for k in range(b.num_rows):
            item = np.frombuffer(items[k].as_buffer(), np.uint64)
            shift = shifts[k].as_py()
            agreeing, width, token = best_window(item, np.frombuffer(texts[k].as_buffer(), np.uint64), shift)
            if agreeing * 10 >= AGREE * width:
                for c, v in zip(out, (k, agreeing, width, token, starts[k].as_py() + token + shift), strict=True):
                    out[c].append(v)
        rows = pa.array(out.pop("row"), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column(c).take(rows) for c in ("doc_id", "mark", "item_id")] + [pa.array(v, pa.int32()) for v in out.values()],
            names=["doc_id", "mark", "item_id", *out],
        )


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified alignments: (doc_id, mark, item_id, agreeing, width, item_token, doc_token).

    A bitmap of fixed size over the test hashes decides which training positions take part in the join; what passes wrongly
    finds no partner there. Only stretches around such positions travel.
    """
    # items meet by a number of their own, as ids may be missing or repeated
    items = materialize(item_table(benchmark).withColumn("item", F.monotonically_increasing_id()), "decontaminate-items")
    seed_rows = materialize(
        items.select("item", F.explode(F.arrays_zip("positions", "seeds")).alias("s")).select(
            "item", F.col("s.positions").alias("item_at"), F.col("s.seeds").alias("seed")
        ), "decontaminate-seeds",
    )
    lengths = [r[0] for r in items.select((F.length("words") / 8).cast("int").alias("n")).filter(F.col("n") < SHORT).distinct().collect()]
    masks = list(dict.fromkeys([*MASKS, *(m for n in lengths for m in _masks_for(n))]))
    found = materialize(_stretches(docs, seed_rows, masks), "decontaminate-stretches")
    hits = found.select("stretch", F.explode(F.arrays_zip("positions", "seeds")).alias("s")).select(
        "stretch", F.col("s.positions").alias("at"), F.col("s.seeds").alias("seed")
    )
    pairs = hits.join(seed_rows, "seed").select("stretch", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    pairs = materialize(pairs, "decontaminate-pairs")
    ready = pairs.join(found.select("stretch", "doc_id", "mark", "start", "words"), "stretch").join(
        items.select("item", "item_id", F.col("words").alias("item_words")), "item"
    )
    return ready.mapInArrow(
        _verify, "doc_id long, mark long, item_id long, agreeing int, width int, item_token int, doc_token int"
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, agreeing, width, item_token, doc_token): the best window of every contaminated document and item."""
    best = F.max(F.struct(
        (F.col("agreeing") / F.col("width")).alias("share"), "width", (-F.col("doc_token")).alias("d"), (-F.col("item_token")).alias("i"), "agreeing"
    )).alias("b")
    return overlaps(docs, benchmark).groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "b.agreeing", "b.width", (-F.col("b.i")).alias("item_token"), (-F.col("b.d")).alias("doc_token")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows; a clean row that shares its id with a contaminated one stays."""
    gone = overlaps(docs, benchmark).select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("__id"), F.col("mark").alias("__mark")).distinct()
    keyed = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), "__mark": _mark()})
    return keyed.join(gone, ["__id", "__mark"], "left_anti").drop("__id", "__mark")
