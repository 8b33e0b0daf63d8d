"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

A space is the piece marker, and one is put before a text that is not empty, as the format asks. Reading a byte moves the
automaton; its output links then name, longest first, every piece that ends there, and each relaxes the best score of that
position. Pieces score as in the model file. A character no piece stands for alone is spelled in byte pieces at ``UNKNOWN`` below the
lowest score. The best total wins, and of equal ones the longer last piece. Decoding joins the pieces' bytes and takes the first
space off, so every text comes back exactly, a literal marker sign (which is spelled in bytes) included.

Texts are cut where no piece can reach across: before runs of spaces and around bytes no piece contains. The parts that differ
within a batch are solved once, all at the same time, position by position. A missing text has no pieces (null) and decodes to
null; an empty text has none (empty). Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finsieve.llm import tokens
from finsieve.llm.shared import Shipped

MARKER = "▁"
UNKNOWN = 10.0
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 20
_LANES = 1 << 19


@dataclass
class Vocabulary:
    """Pieces by id: bytes with the marker as a space (empty if not for text), score, and the ids of the 256 byte pieces."""

    pieces: list[bytes]
    scores: list[float]
    byte_ids: list[int]


def read_vocabulary(path: str = DEFAULT_MODEL) -> Vocabulary:
    """The vocabulary of a SentencePiece model file; read once, by the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores, byte_ids = [], [], [-1] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        scores.append(model.get_score(i))
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            pieces.append(b"")
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            pieces.append(b"")
        else:
            pieces.append(piece.replace(MARKER, " ").encode())
    if -1 in byte_ids:
        raise ValueError("the model has no byte pieces, so not every text could come back")
    return Vocabulary(pieces, scores, byte_ids)


@dataclass
class Automaton:
    vocabulary: Vocabulary
    symbol: np.ndarray = field(init=False)  # byte -> column, 0 for bytes no piece contains
    goto: np.ndarray = field(init=False)    # state * width + column -> state
    piece: np.ndarray = field(init=False)   # piece that ends in this very state, or -1
    report: np.ndarray = field(init=False)  # nearest state, itself included, in which a piece ends; 0 for none
    follow: np.ndarray = field(init=False)  # output link: the next such state on the suffix path

    def __post_init__(self):
        pieces = self.vocabulary.pieces
        used = sorted({b for p in pieces for b in p})
        self.symbol = np.zeros(256, np.int64)
        self.symbol[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for i, p in enumerate(pieces):
            state = 0
            for b in p:
                nxt = children[state].get(b)
                if nxt is None:
                    nxt = children[state][b] = len(children)
                    children.append({})
                    ends.append(-1)
                state = nxt
            if p and ends[state] < 0:
                ends[state] = i
        n = len(children)
        self.piece = np.array(ends, np.int32)
        goto = np.zeros((n, width), np.int32)
        fail = np.zeros(n, np.int32)
        report = np.zeros(n, np.int32)
        follow = np.zeros(n, np.int32)
        level = [(0, int(self.symbol[b]), c) for b, c in children[0].items()]
        goto[0, [s for _, s, _ in level]] = [c for *_, c in level]
        while level:
            parent, column, child = (np.array(x) for x in zip(*level, strict=True))
            # states of one level only need the rows of the levels above
            fail[child] = np.where(parent == 0, 0, goto[fail[parent], column])
            follow[child] = report[fail[child]]
            report[child] = np.where(self.piece[child] >= 0, child, follow[child])
            below = [(c, int(self.symbol[b]), g) for c in child.tolist() for b, g in children[c].items()]
            goto[child] = goto[fail[child]]
            if below:
                goto[[p for p, _, _ in below], [s for _, s, _ in below]] = [g for *_, g in below]
            level = below
        self.goto, self.report, self.follow, self.width = goto.ravel(), report, follow, width
        self.length = np.array([len(p) for p in pieces], np.int32)
        self.score = np.array(self.vocabulary.scores, np.float64)
        self.unknown = min((s for p, s in zip(pieces, self.vocabulary.scores, strict=True) if p), default=0.0) - UNKNOWN
        singles = [p.decode() for p in pieces if p and len(p.decode(errors="ignore")) == 1]
        self.single = np.zeros(256, bool)
        self.single[[ord(c) for c in singles if ord(c) < 128]] = True
        self.single_wide = np.array(sorted(ord(c) for c in singles if ord(c) > 127), np.int64)
        self.cut_at_spaces = not any(b" " in p.lstrip(b" ") for p in pieces)
        texts = [bytes([self.vocabulary.byte_ids.index(i)]) if i in set(self.vocabulary.byte_ids) else p for i, p in enumerate(pieces)]
        self.bytes_of = np.frombuffer(b"".join(texts), np.uint8)
        self.bytes_at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])

    def parts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Start positions of the independent parts of all rows."""
        cut = np.zeros(len(data), bool)
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        if self.cut_at_spaces:
            space = data == 32
            cut[1:] |= space[1:] & ~space[:-1]
        alone = self.symbol[data] == 0
        cut |= alone
        cut[1:] |= alone[:-1]
        return np.flatnonzero(cut)

    def spelling_cost(self, data: np.ndarray) -> np.ndarray:
        """Score of each byte when its character has no piece of its own; 0 where spelling is not allowed."""
        cost = np.where((data < 128) & ~self.single[data], self.unknown, 0.0)
        lead = np.flatnonzero(data >= 192)
        if len(lead):
            first = data[lead].astype(np.int64)
            size = np.where(first >= 240, 4, np.where(first >= 224, 3, 2))
            point = np.where(size == 4, first & 7, np.where(size == 3, first & 15, first & 31))
            for k in (1, 2, 3):
                more = size > k
                point = np.where(more, (point << 6) | (data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) & 63), point)
            other = ~np.isin(point, self.single_wide)
            for k in range(4):
                on = other & (size > k)
                cost[lead[on] + k] = self.unknown / size[on]
        return cost

    def solve(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts one after the other, first position of each part), for parts in any order."""
        counts = np.zeros(len(starts), np.int64)
        order = np.argsort(-lengths, kind="stable")
        held = []
        lo = 0
        while lo < len(order):
            longest = int(lengths[order[lo]])
            hi = min(len(order), lo + max(1, _LANES // (longest + 1)))
            # a batch holds parts of similar length only
            hi = max(lo + 1, min(hi, int(np.searchsorted(-lengths[order], -(longest // 2), side="left")) if longest > 16 else hi))
            chosen = order[lo:hi]
            held.append((chosen, *self._viterbi(data, starts[chosen], lengths[chosen], cost)))
            counts[chosen] = held[-1][2]
            lo = hi
        first = np.concatenate([[0], np.cumsum(counts)])
        ids = np.zeros(first[-1], np.int32)
        for chosen, flat, n in held:
            at = np.repeat(first[chosen] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(flat))
            ids[at] = flat
        return ids, first

    def _viterbi(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts for parts in descending order of length; one lane per part, all lanes at one position."""
        m, longest = len(starts), int(lengths[0])
        best = np.full((longest + 1, m), -np.inf)
        best[0] = 0
        back = np.zeros((longest + 1, m), np.int32)
        byte_ids = np.array(self.vocabulary.byte_ids, np.int32)
        state = np.zeros(m, np.int64)
        active = np.searchsorted(-lengths, -np.arange(longest), side="left")
        flat = best.ravel()
        for j in range(longest):
            n = active[j]
            byte = data[starts[:n] + j]
            state = self.goto[state[:n] * self.width + self.symbol[byte]].astype(np.int64)
            here, link = best[j + 1], back[j + 1]
            spelled = cost[starts[:n] + j]
            allowed = np.flatnonzero(spelled < 0)
            if len(allowed):
                here[allowed] = best[j][allowed] + spelled[allowed]
                link[allowed] = byte_ids[byte[allowed]]
            lanes = np.flatnonzero(self.report[state])
            end = self.report[state[lanes]]
            while len(lanes):
                piece = self.piece[end]
                total = flat[(j + 1 - self.length[piece]) * m + lanes] + self.score[piece]
                better = total > here[lanes]
                here[lanes[better]] = total[better]
                link[lanes[better]] = piece[better]
                end = self.follow[end]
                more = end > 0
                lanes, end = lanes[more], end[more]
        steps = np.where(self.length > 0, self.length, 1)
        at, lanes, taken, owner = lengths.astype(np.int64).copy(), np.arange(m), [], []
        while len(lanes):
            piece = back[at[lanes], lanes]
            taken.append(piece)
            owner.append(lanes)
            at[lanes] -= steps[piece]
            lanes = lanes[at[lanes] > 0]
        taken, owner = np.concatenate(taken[::-1]), np.concatenate(owner[::-1])
        return taken[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=m)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, first id per row) for consecutive rows."""
        for lo, hi, raw, raw_offsets in tokens.text_chunks(column, CHUNK):
            some = (np.diff(raw_offsets) > 0).astype(np.int64)
            shift = np.concatenate([[0], np.cumsum(some)])
            offsets = raw_offsets + shift
            data = np.insert(raw, raw_offsets[:-1][some > 0], 32)
            starts = self.parts(data, offsets)
            if len(starts) == 0:
                yield lo, hi, np.zeros(0, np.int32), np.zeros(hi - lo + 1, np.int64)
                continue
            ends = np.append(starts[1:], len(data))
            key = tokens.Prefix(data, fold=False).of(starts, ends)
            _, at, inverse = np.unique(key, return_index=True, return_inverse=True)
            ids, first = self.solve(data, starts[at], (ends - starts)[at], self.spelling_cost(data))
            size = np.diff(first)[inverse]
            place = np.repeat(first[inverse] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            total = np.concatenate([[0], np.cumsum(size)])
            yield lo, hi, ids[place], total[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts of id runs."""
        size = np.diff(self.bytes_at)[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        data = self.bytes_of[np.repeat(self.bytes_at[ids] - total[:-1], size) + np.arange(total[-1])]
        offsets = total[first]
        some = offsets[:-1] < offsets[1:]
        data = np.delete(data, offsets[:-1][some])
        return data, offsets - np.concatenate([[0], np.cumsum(some)])


_held: dict[int, Automaton] = {}


def automaton(broadcast) -> Automaton:
    """Built once per worker process and vocabulary."""
    key = hash((tuple(broadcast.value.pieces[-64:]), len(broadcast.value.pieces), tuple(broadcast.value.scores[-64:])))
    if key not in _held:
        _held.clear()
        _held[key] = Automaton(broadcast.value)
    return _held[key]


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", restored: str | None = None) -> DataFrame:
    """``docs`` with a column of piece ids; a column of that name is replaced.

    ``restored`` names a further column: whether decoding the ids gives the text back. It is found in the same task.
    """
    shared = Shipped(docs.sparkSession, vocabulary)  # tens of thousands of short pieces, fixed by the model file
    added = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(restored, T.BooleanType())] if restored else [])
    docs = docs.drop(*[f.name for f in added])
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(shared)
        for b in batches:
            column = b.column(names.index(text))
            absent = column.is_null().to_numpy(zero_copy_only=False)
            for lo, hi, flat, first in machine.encode(column):
                new = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat), mask=pa.array(absent[lo:hi]))]
                if restored:
                    new.append(pa.array(_same(column.slice(lo, hi - lo), *machine.decode(flat, first))))
                yield pa.RecordBatch.from_arrays(
                    [c.slice(lo, hi - lo) for c in b.columns] + new, names=[*names, *(f.name for f in added)]
                )

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def _same(column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows of a text column equal the decoded bytes."""
    own, own_offsets = tokens.text_buffers(column)
    if np.array_equal(own_offsets, offsets) and np.array_equal(own, data):
        return np.ones(len(column), bool)
    return np.array([
        np.array_equal(own[a:b], data[c:d])
        for a, b, c, d in zip(own_offsets[:-1], own_offsets[1:], offsets[:-1], offsets[1:], strict=True)
    ], bool)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of every run of ids; a column of that name is replaced."""
    shared = Shipped(encoded.sparkSession, vocabulary)
    encoded = encoded.drop(out)
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(shared)
        for b in batches:
            column = b.column(names.index(ids))
            absent = column.is_null().to_numpy(zero_copy_only=False)
            size = np.where(absent, 0, np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(size)])
            flat = column.flatten().to_numpy(zero_copy_only=False)
            for lo, hi in tokens.chunks(first * 4, CHUNK):
                data, offsets = machine.decode(flat[first[lo]:first[hi]], first[lo:hi + 1] - first[lo])
                bits = pa.array(~absent[lo:hi])
                texts = pa.StringArray.from_buffers(
                    hi - lo, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()), bits.buffers()[1]
                )
                yield pa.RecordBatch.from_arrays([c.slice(lo, hi - lo) for c in b.columns] + [texts], names=[*names, out])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType())]))


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids, n_pieces, restored): piece ids and whether their decoding gives the text back."""
    both = encode(docs.select("doc_id", "text"), vocabulary, restored="restored")
    return both.select("doc_id", "ids", F.size("ids").alias("n_pieces"), "restored")
