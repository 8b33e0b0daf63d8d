"""Language-model scoring of whole documents with the gated recurrent model of ``recurrent``.

Learning rows are those whose crc32 of the id as text leaves 7 with a remainder other than 2. Words are runs of bytes other than
space and 09-0D with A-Z in lower case, followed by one end. Word counts are gathered over all learning rows and joined exactly:
the most frequent words travel to the tasks as a table of fixed size, all other tokens meet their counts in a join.

Training is data-parallel: documents are dealt to ``ROUNDS`` rounds and to replicas by hashes of id and text. A replica takes the
round's parameters and runs over its documents; the parameters are averaged by tokens on the executors, chunk by chunk, in the
order of the replicas. The number of replicas follows from the tokens of the corpus (about ``REPLICA_TOKENS`` each a round), not from
the cluster, so training does not depend on it and a replica's task does not grow with the input. Words are known by 64-bit hashes;
among n distinct words one clash is expected at n**2 / 2**65.

A missing or empty text has the end as its only token. Rows that share an id are scored one by one. Without learning rows the
model stays as it starts and every count is 0. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsieve.llm import recurrent as rnn
from finsieve.llm import tokens
from finsieve.llm.shared import Shipped, crc_of_id
from finsieve.session import materialize

#: Words whose counts travel to every task; the table is bounded by it.
HEAD_WORDS = 1 << 19
#: Training rounds, tokens a replica sees in one of them, and the least number of replicas.
ROUNDS = 12
REPLICA_TOKENS = 500_000
LEAST_REPLICAS = 1
_PENDING = 1 << 22
_GROUP_BYTES = 1 << 24
_CHUNK = 4096


def is_learning() -> Column:
    return crc_of_id() % 7 != 2


@dataclass
class Words:
    """Tokens of a range of rows: hash and tail class per word, words per row."""

    hashes: np.ndarray
    tails: np.ndarray
    first: np.ndarray


def read_words(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    for lo, hi, data, offsets in tokens.text_chunks(column, 1 << 20):
        found = tokens.spans(data, offsets, tokens.NOT_SPACE)
        prefix = tokens.Prefix(data)
        ending = prefix.of(np.maximum(found.starts, found.ends - 2), found.ends)
        yield lo, hi, Words(prefix.of(found.starts, found.ends), (ending % np.uint64(rnn.TAIL)).astype(np.int16), found.first)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n, tail) over all documents, summed within a task before they move."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, tails, held = [], [], 0

        def flush() -> pa.RecordBatch:
            h, t = np.concatenate(hashes), np.concatenate(tails)
            word, at, n = np.unique(h, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(word.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(t[at].astype(np.int32))], names=["word", "n", "tail"]
            )

        for b in batches:
            for *_, w in read_words(b.column("text")):
                hashes.append(w.hashes)
                tails.append(w.tails)
                held += len(w.hashes)
                if held >= _PENDING:
                    yield flush()
                    hashes, tails, held = [], [], 0
        if held:
            yield flush()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word long, n long, tail int").groupBy("word").agg(
        F.sum("n").alias("n"), F.max("tail").alias("tail")
    )


@dataclass
class Vocabulary:
    """Fixed-size tables: shortlist, head words with their counts, mass of every tail class, totals."""

    shortlist: np.ndarray   # hashes; place k holds word k + 1 of the shortlist, as 0 is the end
    head: np.ndarray        # hashes, ascending
    head_counts: np.ndarray
    head_places: np.ndarray  # place in the shortlist, or -1
    tail_mass: np.ndarray    # sum of count + 1 over a tail class, plus one for all unseen words
    documents: int
    tokens: int
    distinct: int


def build_vocabulary(vocabulary: DataFrame, documents: int) -> Vocabulary:
    """Collects only what is bounded: the shortlist, at most ``HEAD_WORDS`` head words, one sum per tail class."""
    totals = vocabulary.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = vocabulary.orderBy(F.desc("n"), "word").limit(rnn.SHORTLIST - 1).select("word", "n", "tail").collect()
    level = F.floor(F.log2("n") * 16).cast("int")
    seen, least = 0, None
    for r in sorted(vocabulary.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        seen += r["count"]
        if seen > HEAD_WORDS:
            break
        least = r["level"]
    chosen = vocabulary.filter(level >= F.lit(least)) if least is not None else vocabulary.limit(0)
    head = chosen.select("word", "n").toArrow()
    hashes = np.concatenate([head.column("word").to_numpy(), np.array([r["word"] for r in top], np.int64)]).view(np.uint64)
    counts = np.concatenate([head.column("n").to_numpy(), np.array([r["n"] for r in top], np.int64)])
    hashes, at = np.unique(hashes, return_index=True)
    short = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    places = np.full(len(hashes), -1, np.int32)
    if len(short):
        places[np.searchsorted(hashes, short)] = np.arange(1, len(short) + 1)
    mass = np.ones(rnn.TAIL)
    for r in vocabulary.groupBy("tail").agg(F.sum(F.col("n") + 1).alias("mass")).collect():
        mass[r["tail"]] += r["mass"]
    for r in top:
        mass[r["tail"]] -= r["n"] + 1
    return Vocabulary(
        short, hashes, counts[at], places, mass, documents, int(totals["n"] or 0) + documents, int(totals["v"]) + (documents > 0)
    )


@dataclass
class Read:
    """A stream for the network with, per token, the log10 of its count plus one where it is known here."""

    stream: rnn.Stream
    hashes: np.ndarray   # 0 for ends
    known: np.ndarray    # the count is known here
    counts: np.ndarray
    rows: np.ndarray


def to_stream(v: Vocabulary, words: list[Words]) -> Read:
    """Tokens of consecutive rows, an end after each row's words."""
    sizes = np.concatenate([np.diff(w.first) for w in words]) if words else np.zeros(0, np.int64)
    hashes, tails = np.concatenate([w.hashes for w in words]), np.concatenate([w.tails for w in words])
    unique, inverse = np.unique(hashes, return_inverse=True)
    if len(v.head):
        at = np.minimum(np.searchsorted(v.head, unique), len(v.head) - 1)
        hit = v.head[at] == unique
        count, place = np.where(hit, v.head_counts[at], 0)[inverse], np.where(hit, v.head_places[at], -1)[inverse]
        hit = hit[inverse]
    else:
        count, place, hit = np.zeros(len(hashes), np.int64), np.full(len(hashes), -1), np.zeros(len(hashes), bool)
    total = len(hashes) + len(sizes)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    word_at = np.ones(total, bool)
    word_at[first[1:] - 1] = False
    listed = place >= 0
    inputs, classes = np.zeros(total, np.int16), np.zeros(total, np.int16)
    members, counts = np.zeros(total, np.int8), np.full(total, v.documents, np.int64)
    known, held = np.ones(total, bool), np.zeros(total, np.uint64)
    inputs[word_at] = np.where(listed, place, rnn.SHORTLIST + tails)
    classes[word_at] = np.where(listed, place // rnn.MEMBERS, rnn.HEAD_CLASSES + tails)
    members[word_at] = np.where(listed, place % rnn.MEMBERS, -1)
    counts[word_at], known[word_at], held[word_at] = count, hit, hashes
    return Read(rnn.Stream(inputs, classes, members, sizes + 1), held, known, counts, np.repeat(np.arange(len(sizes)), sizes + 1))


def _grouped(column: pa.Array) -> Iterator[tuple[int, int, list[Words]]]:
    """Consecutive rows in groups of about ``_GROUP_BYTES`` of text."""
    held: list[Words] = []
    begin, size = 0, 0
    for _, hi, w in read_words(column):
        held.append(w)
        size += 1 << 20
        if size >= _GROUP_BYTES or hi == len(column):
            yield begin, hi, held
            held, begin, size = [], hi, 0


def replicas(tokens_in_all: int) -> int:
    """Replicas per round: so many that each sees about ``REPLICA_TOKENS``, whatever the cluster."""
    return max(LEAST_REPLICAS, -(-tokens_in_all // (ROUNDS * REPLICA_TOKENS)))


def train_round(docs: DataFrame, vocabulary: Any, start: rnn.Parameters) -> rnn.Parameters:
    """Parameters after every replica has run over its documents (replica, place, text), averaged by tokens; ``start`` if there are none.

    A replica takes its documents in the order of ``place``, and replicas are added up in their own order, so the result is the
    same on any cluster. A task holds one batch at a time; parts of parameters are averaged on the executors.
    """
    given = Shipped(docs.sparkSession, start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, adam, seen, at = None, None, 0, None

        def done() -> pa.RecordBatch:
            flat = network.p.flat().astype(np.float32)
            parts = [flat[k:k + _CHUNK].tobytes() for k in range(0, len(flat), _CHUNK)]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(parts)), pa.int32()), pa.array([at] * len(parts), pa.int64()), pa.array([float(seen)] * len(parts)), pa.array(parts, pa.binary())],
                names=["chunk", "replica", "weight", "part"],
            )

        for piece in _replica_groups(batches):
            replica = piece.column("replica")[0].as_py()
            if replica != at:
                if seen:
                    yield done()
                network, adam, seen, at = rnn.Network(given.value.filled(given.value.flat().copy())), rnn.Adam(), 0, replica
            for *_, words in _grouped(piece.column("text")):
                read = to_stream(vocabulary.value, words)
                network.train(read.stream, adam)
                seen += len(read.rows)
        if seen:
            yield done()

    def average(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("replica", kind="stable")
        weight = pdf["weight"].to_numpy()
        parts = np.stack([np.frombuffer(x, np.float32) for x in pdf["part"]])
        mean = (weight[:, None] * parts).sum(axis=0) / weight.sum()
        return pd.DataFrame({"chunk": pdf["chunk"].to_numpy()[:1], "part": [mean.astype(np.float32).tobytes()]})

    dealt = docs.repartition("replica").sortWithinPartitions("replica", "place", "doc_id", "mark")
    trained = dealt.select("replica", "text").mapInArrow(run, "chunk int, replica long, weight double, part binary")
    rows = trained.groupBy("chunk").applyInPandas(average, "chunk int, part binary").collect()
    if not rows:
        return start
    flat = np.concatenate([np.frombuffer(r["part"], np.float32) for r in sorted(rows, key=lambda r: r["chunk"])])
    return start.filled(flat)


def _replica_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one replica at a time, cut where their texts pass ``_GROUP_BYTES``: the cuts depend on the texts alone, not on batches."""
    held: list[pa.RecordBatch] = []
    size, at = 0, None
    for b in batches:
        replica = b.column("replica").to_numpy(zero_copy_only=False)
        lengths = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
        lo = 0
        for k in range(b.num_rows):
            if held and replica[k] != at or k > lo and replica[k] != replica[k - 1] or size >= _GROUP_BYTES:
                if k > lo:
                    held.append(b.slice(lo, k - lo))
                if held:
                    yield pa.Table.from_batches(held).combine_chunks()
                held, size, lo = [], 0, k
            at = replica[k]
            size += int(lengths[k])
        if b.num_rows > lo:
            held.append(b.slice(lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _dealt(learning: DataFrame, count: int) -> DataFrame:
    """(round, replica, place, doc_id, mark, text): every document's place in training, a hash of its id and text."""
    text = F.col("text").cast("string")
    named = learning.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark"), text.alias("text"))
    return named.select(
        F.pmod(F.xxhash64("doc_id", "mark", F.lit("round")), F.lit(ROUNDS)).alias("round"),
        F.pmod(F.xxhash64("doc_id", "mark", F.lit("replica")), F.lit(count)).alias("replica"),
        F.xxhash64("doc_id", "mark", F.lit("place")).alias("place"), "doc_id", "mark", "text",
    )


def train(learning: DataFrame, vocabulary: Any) -> rnn.Parameters:
    """The model after all rounds, which together use every learning document once."""
    v = vocabulary.value
    counts = np.zeros(rnn.SHORTLIST)
    counts[0] = v.documents
    listed = v.head_places >= 0
    counts[v.head_places[listed]] = v.head_counts[listed]
    p = rnn.Parameters.start(counts, v.tail_mass)
    dealt = _dealt(learning, replicas(v.tokens))
    for k in range(ROUNDS):
        p = train_round(dealt.filter(F.col("round") == k), vocabulary, p)
    return p


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    learning = docs.filter(is_learning())
    counts = materialize(word_counts(learning), "lm-words")
    v = build_vocabulary(counts, learning.count())
    vocabulary = Shipped(spark, v)
    model = Shipped(spark, train(learning, vocabulary))
    ln10 = np.log(10)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, v = rnn.Network(model.value), vocabulary.value
        log_mass = np.concatenate([np.zeros(rnn.HEAD_CLASSES), np.log10(v.tail_mass)])
        for b in batches:
            for lo, hi, words in _grouped(b.column("text")):
                read = to_stream(v, words)
                n = hi - lo
                chance = network.log_chances(read.stream) / ln10 - log_mass[read.stream.classes]
                mass = np.where(read.known, np.log10(read.counts + 1.0), 0)
                tail = read.stream.classes >= rnn.HEAD_CLASSES
                add = lambda x, n=n, read=read: np.bincount(read.rows, x, minlength=n)
                far = np.flatnonzero(~read.known)
                first = np.searchsorted(read.rows[far], np.arange(n + 1))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, n), pa.array(read.stream.sizes, pa.int64()), pa.array(add(read.known & (read.counts > 0)).astype(np.int64)),
                     pa.array(add(mass)), pa.array(add(chance) + add(mass * tail)),
                     tokens.list_array(read.hashes[far].view(np.int64), first, pa.int64())],
                    names=["doc_id", "n_tokens", "n_known", "mass", "score", "far"],
                )

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, n_known long, mass double, score double, far array<long>"
    ).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(read, "lm-rows")
    # words outside the head meet their counts; repeats within a document travel once
    far = rows.select("row", F.explode("far").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("times"))
    met = materialize(far, "lm-far").join(counts.select("word", "n"), "word").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("far_mass"), F.sum("times").alias("far_known")
    )
    whole = rows.drop("far").join(met, "row", "left").na.fill({"far_mass": 0.0, "far_known": 0})
    # n + 1 * (v + 1) possible draws in the base model
    draws = float(np.log10(v.tokens + v.distinct + 1))
    return whole.select(
        "doc_id", (crc_of_id() % 7 == 2).alias("held_out"), "n_tokens", (F.col("n_known") + F.col("far_known")).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("mass") + F.col("far_mass") - F.col("n_tokens") * draws).alias("base_score"),
        (F.col("score") + F.col("far_mass")).alias("score"),
    )
