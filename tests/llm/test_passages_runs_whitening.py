"""Repeated passages, periodic runs and whitening against brute force and other arithmetic."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from finsieve.llm import periodic_runs, queries, substring_dedup, tokens, whitening
from tests.llm import fixtures as fx


def split(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


# --- repeated passages --------------------------------------------------------------------------------------------------

def cut_by_hand(rows, length):
    met = Counter(tuple(w[i:i + length]) for w in (split(t) for _, t in rows) for i in range(len(w) - length + 1))
    out = []
    for i, t in rows:
        w = split(t)
        gone = {k for s in range(len(w) - length + 1) if met[tuple(w[s:s + length])] > 1 for k in range(s, s + length)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def passages():
    rng = random.Random(3)
    base = [fx.sentence(rng, n) for n in (35, 36, 50, 90, 200)]
    rows = list(fx.texts())
    rows += [(100 + k, f"{fx.sentence(rng, k % 7)} {base[k % 5]} {fx.sentence(rng, k % 11)}") for k in range(25)]
    # two shared passages that overlap in one text, one word apart from the length, and a text that repeats itself
    words = base[4].split()
    rows += [(200, " ".join(words[:34])), (201, " ".join(words[10:45])), (202, "A " + " ".join(words[40:120]) + " b"), (203, base[2].title())]
    rows += [(204, fx.sentence(rng, 60) + " x " * 50), (205, " ".join(words[60:100] + ["cut"] + words[60:100]))]
    rows += [(None, base[3]), (None, base[3]), (206, base[3].replace(" ", "\n\t"))]
    return rows


def test_repeats_equal_brute_force(spark):
    rows = passages()
    got = substring_dedup.remove_repeats(fx.documents(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == cut_by_hand(rows, 35)


def test_repeats_of_small_alphabets(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 30)))) for k in range(60)]
    got = substring_dedup.remove_repeats(fx.documents(spark, rows), length=9, seed=3).collect()
    assert sorted(map(tuple, got), key=repr) == cut_by_hand(rows, 9)


def test_maximal_repeats_are_whole_stretches(spark):
    rng = random.Random(4)
    shared = fx.sentence(rng, 70)
    rows = [(1, fx.sentence(rng, 5) + " " + shared), (2, shared + " end"), (None, "no " + shared), (4, fx.sentence(rng, 80))]
    got = {(r.doc_id, r.start, r.n_words) for r in substring_dedup.maximal_repeats(fx.documents(spark, rows)).collect()}
    assert got == {(1, 5, 70), (2, 0, 70), (None, 1, 70)}


def test_one_passage_in_most_documents(spark):
    """Ends of a passage that many documents share differ in each; copies of one row share their key."""
    rng = random.Random(6)
    shared = fx.sentence(rng, 45)
    rows = [(k, f"left{k} {shared} right{k} {fx.sentence(rng, 3)}") for k in range(300)] + [(None, shared)] * 200
    got = {(r.doc_id, r.n_removed, r.text.split()[:2] == [f"left{r.doc_id}", f"right{r.doc_id}"]) for r in substring_dedup.remove_repeats(fx.documents(spark, rows)).collect()}
    assert got == {(k, 45, True) for k in range(300)} | {(None, 45, False)}


def test_repeats_of_nothing(spark):
    assert substring_dedup.remove_repeats(fx.empty(spark)).count() == 0
    assert substring_dedup.maximal_repeats(fx.documents(spark, [(1, None), (2, "")])).count() == 0


# --- periodic runs ------------------------------------------------------------------------------------------------------

def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i - q] for i in range(q, len(w))))


def runs_by_hand(w):
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            stretch = w[i - q:j]
            if len(stretch) >= max(6, 4 * q) and smallest_period(stretch) == q:
                found.append((i - q, len(stretch), q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(doc_id, w):
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 or not w:
        return w
    a, n = h // 10 % len(w), len(w)
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def told(doc_id, w):
    runs = runs_by_hand(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest(),
    )


def test_runs_of_small_alphabets():
    rng = random.Random(2)
    rows = []
    for k in range(400):
        w = [rng.choice("ab" if k % 2 else "abc") for _ in range(rng.randint(0, 60))]
        unit = [rng.choice("abcd") for _ in range(rng.randint(1, 17))]
        rows.append(w + (unit * rng.randint(1, 7))[:rng.randint(1, 120)] + w[:5])
    rows += [[], ["x"] * 5, ["x"] * 6, ["x"] * 400, list("ab") * 2, list("ab") * 3 + ["a"], (list("aab") * 5 + ["c"]) * 9]
    words = np.array([ord(x) for r in rows for x in r], np.uint64)
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    found = periodic_runs.find_runs(tokens.mix(words), first)
    got = [[] for _ in rows]
    for row, *run in zip(*(x.tolist() for x in found), strict=True):
        got[row].append(tuple(run))
    assert got == [runs_by_hand(r) for r in rows]


def test_runs_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(12)
    rows = [r for r in fx.texts() if r[0] not in (41, 42)]
    rows += [(300 + k, fx.sentence(rng, rng.randint(1, 90)) + " tick tock" * (k % 9) + "\nagain " * (k % 5)) for k in range(120)]
    fx.documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((told(i, planted(i, split(t))) for i, t in rows), key=repr)


def test_runs_of_long_texts_and_nothing(spark):
    rows = [(41, "word " * 30_000), (2, None), (None, "a b " * 5)]
    got = {r.doc_id: r for r in periodic_runs.collapse(fx.documents(spark, rows)).collect()}
    assert [tuple(x) for x in got[41].runs] == [(0, 30_000, 1)] and got[41].text == "word"
    assert got[2].runs == [] and got[2].strongest is None and got[2].text == ""
    assert tuple(got[None].strongest) == (0, 10, 2) and got[None].text == "a b"
    assert periodic_runs.collapse(fx.empty(spark)).count() == 0


# --- whitening ----------------------------------------------------------------------------------------------------------

def leverrier(matrix):
    """Characteristic polynomial, lowest coefficient first, by exact fractions."""
    d = len(matrix)
    a = [[Fraction(int(v)) for v in row] for row in matrix]
    m, c = [[Fraction(0)] * d for _ in range(d)], [Fraction(0)] * d + [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(d)) + (c[d - k + 1] if i == j else 0) for j in range(d)] for i in range(d)]
        c[d - k] = -sum(a[i][t] * m[t][i] for i in range(d) for t in range(d)) / k
    return [int(v) for v in c]


def test_characteristic_polynomial_is_exact(spark):
    rng = np.random.default_rng(5)
    for d in (1, 2, 3, 7):
        x = rng.integers(-1000, 1000, (d + 3, d))
        matrix = (x.T @ x).astype(object) * 10**6
        assert whitening.characteristic_polynomial(spark, matrix, per_task=2) == leverrier(matrix)
    hollow = np.diag([5, 0, 5, 0, 9]).astype(object)
    assert whitening.characteristic_polynomial(spark, hollow) == leverrier(hollow)


def test_multiple_and_near_roots():
    one = 1 << 160
    def product(*roots):
        c = [1]
        for r in roots:
            c = [(c[k - 1] if k else 0) - r * (c[k] if k < len(c) else 0) for k in range(len(c) + 1)]
        return c
    assert [(r // one, m) for r, m in whitening.largest_roots(product(7, 7, 7, 3, 0, 0), 6)] == [(7, 3), (3, 1)]
    assert [r / one for r, _ in whitening.largest_roots(product(10**9, 10**9 + 1, 4), 2)] == [10**9 + 1, 10**9]
    assert whitening.largest_roots([0, 0, 1], 5) == []
    root = whitening.largest_roots([1, -10**6, 1], 2)
    assert root[1][0] / one == pytest.approx(1e-6, rel=1e-12)


def expected(vectors, count):
    x = np.floor(64 * vectors) + 1_000_000
    fit = np.unique(x, axis=0)
    n, mean = len(fit), fit.mean(axis=0)
    centred = fit - mean
    v = centred.T @ centred / n
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1][:count], basis[:, ::-1][:, :count]
    deviation = ((n * x.astype(object) - fit.astype(object).sum(axis=0)) ** 2).sum(axis=1)
    return n, deviation, (x - mean) @ basis / np.sqrt(values), values / np.trace(v)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, 6) for r in rows], "vec_id long, embedding array<float>, grid int, n int").repartition(3)


def test_whitening_equals_other_arithmetic(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(300, 20)) * np.linspace(1, 40, 20)).astype(np.float32)
    vectors = np.concatenate([vectors, vectors[:50], vectors[:1]])
    bad = [(900, None), (901, []), (902, [1.0] * 19 + [None]), (903, [float("nan")] * 20), (904, [float("-inf")] * 20), (905, [1.0] * 7), (None, vectors[3].tolist())]
    got = whitening.whiten(frame(spark, [(i, v.tolist()) for i, v in enumerate(vectors)] + bad)).collect()
    n, deviation, whitened, explained = expected(vectors.astype(float), 16)
    assert len(got) == 16 * (len(vectors) + 1)
    by = {(r.vec_id, r.component): r for r in got}
    z = np.array([[by[i, c].whitened for c in range(1, 17)] for i in range(len(vectors))])
    signs = np.sign((z * whitened).sum(axis=0))
    assert np.abs(z - whitened * signs).max() < 1e-8
    assert all(by[i, 1].deviation == deviation[i] and by[i, 5].n == n for i in range(len(vectors)))
    assert np.allclose([by[0, c].explained for c in range(1, 17)], explained, rtol=1e-10)
    assert by[0, 1].identity_error < 1e-9 and by[None, 4].whitened == by[3, 4].whitened


def test_whitening_of_equal_spreads_and_flat_directions(spark):
    """A multiple eigenvalue still gives orthonormal components; directions without variance give none."""
    rows = [(k, [0.0] * k + [1.0] + [0.0] * (4 - k) + [2.0]) for k in range(5)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2, 3, 4} and all(abs(r.explained - 0.25) < 1e-12 for r in got)
    assert max(r.identity_error for r in got) < 1e-9


def test_whitening_of_large_entries_and_few_rows(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    rows = [(1, [1e30, 0.0]), (2, [-3.0, 5.0]), (3, [0.0, 1.0])]
    got = {(r.vec_id, r.component): r for r in whitening.whiten(frame(spark, rows)).collect()}
    assert len(got) == 6 and got[1, 1].deviation is None and got[1, 1].identity_error < 1e-9


def test_moments_are_exact(spark):
    rng = np.random.default_rng(9)
    grid = rng.integers(-(1 << 61), 1 << 61, (7, 3))
    assert (whitening.products(grid) == grid.astype(object).T @ grid.astype(object)).all()
    packed = whitening._pack(np.concatenate([grid, grid >> 30, grid >> 50, grid >> 58]))
    assert (whitening._unpack(packed, 3) == np.concatenate([grid, grid >> 30, grid >> 50, grid >> 58])).all()
