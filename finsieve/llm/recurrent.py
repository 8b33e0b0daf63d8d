"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, lanes of whole documents.

The vocabulary is open. The ``SHORTLIST`` most frequent words (the text's end is the first of them) sit in classes of ``MEMBERS`` words
each with a softmax of its own; every other word, seen or not, is in one of ``TAIL`` classes by its last two bytes, where it has
its share of the class's smoothed training count. A token's probability is that of its class times that within the class, so the
probabilities of all possible words sum to one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

HIDDEN = 24
MEMBERS = 32
SHORTLIST = 1024
TAIL = 64
HEAD_CLASSES = SHORTLIST // MEMBERS
CLASSES = HEAD_CLASSES + TAIL
INPUTS = SHORTLIST + TAIL
END = 0
WINDOW = 24
SCORE_WINDOW = 96
TRAIN_LANES = 64
SCORE_LANES = 512
RATE = 0.004
#: Tokens of one class that go through a batched product together.
TRAIN_CHUNK = 16
#: Tokens whose classes are scored at once.
_ROWS = 1 << 12
_ONE = np.float32(1)
_NAMES = ("inputs", "recurrent", "classes", "class_bias", "members", "member_bias")


@dataclass
class Parameters:
    inputs: np.ndarray       # INPUTS x 3 HIDDEN: what a token adds to reset gate, update gate and candidate
    recurrent: np.ndarray    # HIDDEN x 3 HIDDEN
    classes: np.ndarray      # HIDDEN x CLASSES
    class_bias: np.ndarray
    members: np.ndarray      # HEAD_CLASSES x HIDDEN x MEMBERS
    member_bias: np.ndarray

    @classmethod
    def start(cls, counts: np.ndarray, tail: np.ndarray, seed: int = 3) -> Parameters:
        """Random weights; biases at the log shares of the classes and of the words within them."""
        rng = np.random.default_rng(seed)
        draw = lambda s, *shape: rng.normal(0, s, shape).astype(np.float32)
        words = counts.astype(np.float64) + 1
        classes = np.concatenate([words.reshape(HEAD_CLASSES, MEMBERS).sum(axis=1), tail])
        inputs = draw(0.1, INPUTS, 3 * HIDDEN)
        inputs[:, HIDDEN:2 * HIDDEN] += 1.0  # start with states that last
        within = np.log(words.reshape(HEAD_CLASSES, MEMBERS))
        within -= within.max(axis=1, keepdims=True)
        return cls(
            inputs, draw(0.2, HIDDEN, 3 * HIDDEN), draw(0.1, HIDDEN, CLASSES), np.log(classes / classes.sum()).astype(np.float32),
            draw(0.1, HEAD_CLASSES, HIDDEN, MEMBERS), within.astype(np.float32),
        )

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in _NAMES])

    def filled(self, flat: np.ndarray) -> Parameters:
        out, at = {}, 0
        for n in _NAMES:
            like = getattr(self, n)
            out[n] = flat[at:at + like.size].reshape(like.shape).astype(np.float32)
            at += like.size
        return Parameters(**out)


def lanes(sizes: np.ndarray, most: int) -> np.ndarray:
    """Token positions as (step, lane), -1 where a lane is over: whole documents dealt to lanes, the longest first.

    As many lanes as keep the longest document from standing alone, at most ``most``; lanes come in descending length.
    """
    count = int(max(1, min(most, sizes.sum() // max(1, sizes.max()) + 1, len(sizes))))
    loads = [(0, k) for k in range(count)]
    held: list[list[int]] = [[] for _ in range(count)]
    for d in np.argsort(-sizes, kind="stable").tolist():
        load, k = loads[0]
        held[k].append(d)
        heapq.heapreplace(loads, (load + int(sizes[d]), k))
    first = np.concatenate([[0], np.cumsum(sizes)])
    total = np.array([sizes[h].sum() for h in held])
    out = np.full((int(total.max()), count), -1, np.int64)
    for column, k in enumerate(np.argsort(-total, kind="stable")):
        out[:total[k], column] = np.concatenate([np.arange(first[d], first[d + 1]) for d in held[k]])
    return out


@dataclass
class Stream:
    """Tokens of some whole documents one after the other: input row, class, place in the class (-1 in a tail class)."""

    inputs: np.ndarray
    classes: np.ndarray
    members: np.ndarray
    sizes: np.ndarray


@dataclass
class _Window:
    """A stretch of steps over all lanes, step by step: token positions, inputs, where each step begins, and what the steps computed."""

    at: np.ndarray
    inputs: np.ndarray
    first: np.ndarray
    over: np.ndarray
    ended: np.ndarray    # whether a document ends in the step
    before: np.ndarray
    gates: np.ndarray
    candidates: np.ndarray
    proposed: np.ndarray


class _Members:
    """Tokens of classes with members, dealt to chunks of ``TRAIN_CHUNK`` tokens of one class: one batched product serves all classes."""

    def __init__(self, p: Parameters, h: np.ndarray, c: np.ndarray, m: np.ndarray):
        rows = TRAIN_CHUNK
        order = np.argsort(c, kind="stable")
        self.tokens = order[:np.searchsorted(c[order], HEAD_CLASSES)]
        own = c[self.tokens]
        sizes = np.bincount(own, minlength=HEAD_CLASSES)
        chunks = -(-sizes // rows)
        self.classes = np.flatnonzero(sizes)
        self.begin = (np.cumsum(chunks) - chunks)[self.classes]
        slot = (np.cumsum(chunks) - chunks) * rows - (np.cumsum(sizes) - sizes)
        self.slot = slot[own] + np.arange(len(own))
        of = np.repeat(np.arange(HEAD_CLASSES), chunks)
        self.weights = p.members[of]
        states = np.zeros((len(of) * rows, HIDDEN), np.float32)
        states[self.slot] = h[self.tokens]
        self.states = states.reshape(len(of), rows, HIDDEN)
        logits = np.matmul(self.states, self.weights)
        logits += p.member_bias[of][:, None, :]
        self.chances = logits.reshape(-1, MEMBERS)
        self.place = m[self.tokens]
        np.exp(self.chances, out=self.chances)

    def gradients(self, grads: dict[str, np.ndarray], dh: np.ndarray, share: np.float32) -> None:
        """Fills in what the members' parameters get, and adds to ``dh`` what the states get."""
        if len(self.tokens) == 0:
            return
        e = self.chances
        scale = np.zeros(len(e), np.float32)
        scale[self.slot] = _ONE / e.sum(axis=1)[self.slot]
        e *= scale[:, None]
        e[self.slot, self.place] -= 1
        e = e.reshape(len(self.states), -1, MEMBERS)
        weights = np.matmul(self.states.transpose(0, 2, 1), e).reshape(len(e), -1)
        grads["members"][self.classes] = np.add.reduceat(weights, self.begin, axis=0).reshape(-1, HIDDEN, MEMBERS) * share
        grads["member_bias"][self.classes] = np.add.reduceat(e.sum(axis=1), self.begin, axis=0) * share
        dh[self.tokens] += np.matmul(e, self.weights.transpose(0, 2, 1)).reshape(-1, HIDDEN)[self.slot]


class Network:
    def __init__(self, p: Parameters):
        self.p = p

    def _windows(self, s: Stream, most: int, length: int) -> Iterator[_Window]:
        """The stream window by window; states carry over."""
        places = lanes(s.sizes, most)
        running = (places >= 0).sum(axis=1)
        h = np.zeros((places.shape[1], HIDDEN), np.float32)
        for lo in range(0, len(places), length):
            block, counts = places[lo:lo + length], running[lo:lo + length]
            at = block[block >= 0]
            n = len(at)
            x = s.inputs[at]
            first = np.concatenate([[0], np.cumsum(counts)])
            over = x == END
            ended = np.logical_or.reduceat(over, first[:-1])
            given = self.p.inputs.take(x, axis=0)
            # gates are reciprocals of 1 + exp(-x)
            gates, offered = -given[:, :2 * HIDDEN], given[:, 2 * HIDDEN:].copy()
            recurrent = self.p.recurrent.copy()
            recurrent[:, :2 * HIDDEN] *= -1
            before = np.empty((n, HIDDEN), np.float32)
            candidates, products = np.empty((n, HIDDEN), np.float32), np.empty((n, 3 * HIDDEN), np.float32)
            with np.errstate(over="ignore"):  # infinity, whose reciprocal is the right 0
                for t, m in enumerate(counts.tolist()):
                    i, j = first[t], first[t + 1]
                    state, gate, new = h[:m], gates[i:j], candidates[i:j]
                    before[i:j] = state
                    g = np.matmul(state, recurrent, out=products[i:j])
                    gate += g[:, :2 * HIDDEN]
                    np.exp(gate, out=gate)
                    gate += _ONE
                    np.reciprocal(gate, out=gate)
                    np.multiply(gate[:, :HIDDEN], g[:, 2 * HIDDEN:], out=new)
                    new += offered[i:j]
                    np.tanh(new, out=new)
                    state -= new
                    state *= gate[:, HIDDEN:]
                    state += new
                    if ended[t]:
                        state[over[i:j]] = 0
            yield _Window(at, x, first, over, ended, before, gates, candidates, products[:, 2 * HIDDEN:])

    def _classes(self, h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unscaled chances of all classes, their sums, logits of ``c``); logits stay far below overflow."""
        return self._exponentials(h @ self.p.classes, self.p.class_bias, c)

    def _members(self, h: np.ndarray, k: int, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for the members of class ``k``."""
        return self._exponentials(h @ self.p.members[k], self.p.member_bias[k], m)

    @staticmethod
    def _exponentials(logits: np.ndarray, bias: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        logits += bias
        chosen = logits[np.arange(len(at)), at]
        np.exp(logits, out=logits)
        return logits, logits.sum(axis=1), chosen

    @staticmethod
    def _by_class(c: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(class, rows) for the classes with members of their own."""
        order = np.argsort(c, kind="stable")
        edges = np.searchsorted(c[order], np.arange(HEAD_CLASSES + 1))
        for k in range(HEAD_CLASSES):
            if edges[k] < edges[k + 1]:
                yield k, order[edges[k]:edges[k + 1]]

    def log_chances(self, s: Stream) -> np.ndarray:
        """Natural log probability per token: of its class, and within the class for shortlisted words."""
        out = np.zeros(len(s.inputs), np.float32)
        for w in self._windows(s, SCORE_LANES, SCORE_WINDOW):
            c = s.classes[w.at]
            found = np.empty(len(c), np.float32)
            for lo in range(0, len(c), _ROWS):
                _, total, chosen = self._classes(w.before[lo:lo + _ROWS], c[lo:lo + _ROWS])
                found[lo:lo + _ROWS] = chosen - np.log(total)
            for k, rows in self._by_class(c):
                _, total, chosen = self._members(w.before[rows], k, s.members[w.at[rows]])
                found[rows] += chosen - np.log(total)
            out[w.at] = found
        return out

    def train(self, s: Stream, adam: Adam) -> None:
        """One pass over the stream; a step per window, gradients cut at its start."""
        p = self.p
        for w in self._windows(s, TRAIN_LANES, WINDOW):
            n = len(w.at)
            h, c = w.before, s.classes[w.at]
            grads = {k: np.zeros_like(getattr(p, k)) for k in _NAMES}
            share = np.float32(1 / n)
            d, total, _ = self._classes(h, c)
            d /= total[:, None]
            d[np.arange(n), c] -= 1
            grads["classes"][:] = (h.T @ d) * share
            grads["class_bias"][:] = d.sum(axis=0) * share
            dh = d @ p.classes.T
            _Members(p, h, c, s.members[w.at]).gradients(grads, dh, share)
            dh *= share
            self._back(w, dh, grads)
            adam.step(p, grads)

    def _back(self, w: _Window, dh: np.ndarray, grads: dict[str, np.ndarray]) -> None:
        """Gradients of the recurrent part from those of the states before each token."""
        n = len(w.at)
        h, r, z = w.before, w.gates[:, :HIDDEN].copy(), w.gates[:, HIDDEN:].copy()
        # all that does not depend on later steps, for the whole window at once
        rest = _ONE - z
        to_n = rest * (_ONE - w.candidates * w.candidates)
        factors = np.stack([to_n * w.proposed * r * (_ONE - r), (h - w.candidates) * z * rest, to_n * r], axis=1)
        back = np.ascontiguousarray(self.p.recurrent.T)
        dg, reached = np.empty((n, 3, HIDDEN), np.float32), np.empty((n, HIDDEN), np.float32)
        # what reaches the states after a step: from the next step's states, unless a document ended here
        carried = np.zeros((w.first[1], HIDDEN), np.float32)
        for t in range(len(w.first) - 2, -1, -1):
            i, j = w.first[t], w.first[t + 1]
            after, part = carried[:j - i], dg[i:j]
            if w.ended[t]:
                after[w.over[i:j]] = 0
            reached[i:j] = after
            np.multiply(after[:, None, :], factors[i:j], out=part)
            after *= z[i:j]
            after += part.reshape(j - i, -1) @ back
            after += dh[i:j]
        dg = dg.reshape(n, -1)
        grads["recurrent"][:] = h.T @ dg
        order = np.argsort(w.inputs, kind="stable")
        rows, first = np.unique(w.inputs[order], return_index=True)
        np.multiply(reached, to_n, out=dg[:, 2 * HIDDEN:])
        grads["inputs"][rows] = np.add.reduceat(dg[order], first, axis=0)


class Adam:
    def __init__(self):
        self.m: dict[str, np.ndarray] = {}
        self.v: dict[str, np.ndarray] = {}
        self.t = 0

    def step(self, p: Parameters, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values())))
        clip = min(1.0, 1.0 / max(norm, 1e-9))
        scale = np.float32(RATE * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t))
        for k, g in grads.items():
            m = self.m.setdefault(k, np.zeros_like(g))
            v = self.v.setdefault(k, np.zeros_like(g))
            g *= np.float32(clip)
            m *= np.float32(0.9)
            v *= np.float32(0.999)
            part = g * np.float32(0.1)
            m += part
            part *= g
            part *= np.float32(0.01)
            v += part
            np.sqrt(v, out=part)
            part += np.float32(1e-8)
            np.divide(m, part, out=part)
            part *= scale
            values = getattr(p, k)
            values -= part
