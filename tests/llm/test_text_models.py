"""Decontamination, piece encoding, classifiers and the language model."""

import itertools
import math
import os
import random
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from finsieve.llm import decontaminate as dc
from finsieve.llm import lm_scoring, pieces, quality, recurrent, tokens, toxicity
from tests.llm import fixtures as fx


# decontamination -------------------------------------------------------------------------

def test_masks_meet_every_allowed_substitution():
    for n in range(dc.SHORT, dc.WINDOW + 1):
        wrong = n - math.ceil(n * dc.AGREE / 10)
        for bad in itertools.combinations(range(n), wrong):
            assert any(all(i + o not in bad for o in m) for m in dc.MASKS for i in range(n - m[-1]))
    for n in range(1, dc.SHORT):
        wrong = n - math.ceil(n * dc.AGREE / 10)
        for bad in itertools.combinations(range(n), wrong):
            assert any(all(o not in bad for o in m) for m in dc.short_masks(n))


def _plain_overlaps(docs, items):
    out = set()
    for d, t in docs:
        w = fx.words(t)
        for i, u in items:
            v = fx.words(u)
            width = min(dc.WINDOW, len(v))
            for shift in range(-len(v) + 1, len(w)):
                same = [0 <= k + shift < len(w) and w[k + shift] == x for k, x in enumerate(v)]
                inside = [k for k in range(len(v) - width + 1) if 0 <= k + shift and k + width + shift <= len(w)]
                if width and any(sum(same[k:k + width]) * 10 >= dc.AGREE * width for k in inside):
                    out.add((d, i))
    return out


def _bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_decontamination_against_brute_force(spark):
    rng = random.Random(4)
    items = [(k, fx.sentence(rng, n)) for k, n in enumerate((1, 2, 4, 5, 6, 7, 8, 9, 12, 16, 20, 40, 59))] + [(90, None), (91, ""), (92, "unique passage nobody has")]
    docs = []
    for k in range(60):
        words = fx.words(items[rng.randrange(13)][1])
        for _ in range(rng.randint(0, max(1, len(words) // 4))):
            words[rng.randrange(len(words))] = f"sub{k}"
        docs.append((k, " ".join([fx.sentence(rng, rng.randint(0, 20)), *words, fx.sentence(rng, rng.randint(0, 20))])))
    docs += [(70, None), (71, ""), (None, items[11][1]), (72, items[11][1][:120]), (73, "pad " * 20_000 + items[12][1])]
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(fx.documents(spark, docs), _bench(spark, items)).collect()}
    assert got == _plain_overlaps(docs, items)


def test_equal_items_are_reported_once_and_clean_rows_stay(spark):
    rng = random.Random(8)
    passage = fx.sentence(rng, 30)
    docs = fx.documents(spark, [(1, "x " + passage), (1, "clean row with the same id"), (2, passage.upper()), (3, "clean"), (None, passage), (None, "clean too")])
    bench = _bench(spark, [(5, passage), (4, passage.title()), (None, None)])
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(docs, bench).collect()} == {(1, 4), (2, 4), (None, 4)}
    kept = dc.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.text for r in kept.collect()) == ["clean", "clean row with the same id", "clean too"]


def test_items_without_an_id_are_searched(spark):
    rng = random.Random(12)
    nameless, other, named = (fx.sentence(rng, 24) for _ in range(3))
    docs = fx.documents(spark, [(1, f"before {nameless} after"), (2, f"{other} after"), (3, named), (4, fx.sentence(rng, 40)), (5, f"{named} {nameless}")])
    bench = _bench(spark, [(None, nameless), (None, other), (8, named)])
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(docs, bench).collect()} == {(1, None), (2, None), (3, 8), (5, 8), (5, None)}
    assert [r.doc_id for r in dc.drop_contaminated(docs, bench).collect()] == [4]


def test_decontamination_of_nothing(spark):
    assert dc.contaminated(fx.empty(spark), _bench(spark, [(1, "a b c")])).count() == 0
    assert dc.contaminated(fx.documents(spark), _bench(spark, [])).count() == 0
    assert dc.drop_contaminated(fx.documents(spark), _bench(spark, [])).count() == len(fx.texts())


# pieces ----------------------------------------------------------------------------------

def _vocabulary(words: dict[str, float]) -> pieces.Vocabulary:
    texts = [b"", *(w.replace(pieces.MARKER, " ").encode() for w in words)]
    return pieces.Vocabulary(texts + [b""] * 256, [0.0, *words.values()] + [0.0] * 256, list(range(len(texts), len(texts) + 256)))


def _plain_viterbi(v: pieces.Vocabulary, text: str) -> list[int]:
    if not text:
        return []
    known = {p: i for i, p in enumerate(v.pieces) if p}
    unknown = min(v.scores[i] for i in known.values()) - pieces.UNKNOWN
    data, spelled = b"", []
    for c in " " + text:
        b = c.encode()
        spelled += [None if b in known and c != pieces.MARKER else unknown / len(b)] * len(b)
        data += b
    best, back = [0.0] + [-1e300] * len(data), [(0, 0)] * (len(data) + 1)
    longest = max(map(len, known))
    for j in range(1, len(data) + 1):
        if spelled[j - 1] is not None:
            best[j], back[j] = best[j - 1] + spelled[j - 1], (j - 1, v.byte_ids[data[j - 1]])
        for i in range(max(0, j - longest), j):
            p = known.get(data[i:j])
            if p is not None and best[i] + v.scores[p] > best[j]:
                best[j], back[j] = best[i] + v.scores[p], (i, p)
    out, j = [], len(data)
    while j:
        j, p = back[j]
        out.append(p)
    return out[::-1]


SAMPLES = ["", " ", "a", "abab  ab\nab", "ünï▁x", "日本語テキスト 𝔘", "  lead", "trail  ", "\t\n", "b" * 300, "ab " * 50]


def _check_encoding(v: pieces.Vocabulary, texts: list[str]) -> None:
    machine = pieces.Automaton(v)
    for lo, hi, ids, first in machine.encode(pa.array(texts)):
        for k in range(lo, hi):
            assert ids[first[k - lo]:first[k - lo + 1]].tolist() == _plain_viterbi(v, texts[k]), texts[k]
        data, offsets = machine.decode(ids, first)
        assert [bytes(data[a:b]).decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == texts[lo:hi]


def test_viterbi_with_ties_and_gaps():
    rng = random.Random(2)
    pool = {p: -float(rng.randint(1, 4)) for p in ("a", "b", "ab", "ba", "aba", "▁", "▁a", "▁ab", "bb", "bbb", "▁▁", "ü", "日本", "語")}
    texts = SAMPLES + ["".join(rng.choice("ab ü日本\n") for _ in range(rng.randint(1, 40))) for _ in range(200)]
    _check_encoding(_vocabulary(pool), texts)


def test_pieces_that_reach_across_spaces():
    _check_encoding(_vocabulary({"a": -3.0, "b": -3.0, "▁": -3.0, "a▁b": -1.0, "▁a": -2.0}), ["a b a b", "b a  b", *SAMPLES])


def test_public_model_round_trip(spark):
    v = pieces.read_vocabulary()
    _check_encoding(v, [*SAMPLES, *(t[:400] for _, t in fx.texts() if t)])
    docs = fx.documents(spark)
    encoded = pieces.encode(docs, v)
    assert set(encoded.columns) == set(docs.columns)
    both = pieces.decode(encoded, v).collect()
    assert all(r.text == r.decoded for r in both) and len(both) == len(fx.texts())
    assert all((r.ids is None) == (r.text is None) for r in both)
    assert all(r.restored for r in pieces.round_trip(docs, v).collect())
    assert pieces.round_trip(fx.empty(spark), v).count() == 0


# classifiers -----------------------------------------------------------------------------

def _toxic_corpus(n: int):
    rng = random.Random(11)
    rows, labels = [], []
    for k in range(n):
        words = fx.sentence(rng, rng.randint(10, 60)).split()
        bad = k % 4 == 0
        if bad:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "vequ" + rng.choice(["ais", "no", "ance", "ur"])]))
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(bad)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_toxicity_on_held_out_rows(spark):
    rows, labels = _toxic_corpus(900)
    docs = fx.documents(spark, rows + [(5000, None), (5001, ""), (None, "no id"), (5002, "word " * 40_000)])
    got = toxicity.score(docs, spark.createDataFrame(labels + [(None, 1, 1), (4, None, None)], LABELS)).collect()
    truth = {i: t for i, _, t in labels}
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r in held)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_scores_ignore_language_source_and_id(spark):
    rows, labels = _toxic_corpus(200)
    marks = spark.createDataFrame(labels, LABELS)
    model = toxicity.train(fx.documents(spark, rows), marks)
    (_, _, batch), = toxicity.read_words(pa.array(["same text idiot", "same text idiot"]))
    a, b = model.score(batch)
    assert a == b


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], LABELS)
    got = toxicity.score(fx.documents(spark, [(1, "a b"), (2, None)]), none).collect()
    assert [r.predicted for r in got] == [0, 0]
    assert toxicity.score(fx.empty(spark), none).count() == 0


def test_threshold():
    raw, toxic = np.array([0.9, 0.8, 0.4, 0.3, 0.1]), np.array([1, 1, 1, 0, 0.0])
    assert 0.3 < toxicity.best_threshold(raw, toxic) < 0.4


def test_quality_keeps_good_and_drops_bad(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(1200):
        words = fx.sentence(rng, rng.randint(10, 60)).split()
        bad = k % 6 == 0
        if bad:
            words = [w + rng.choice(["$$$", "###"]) for w in words] if k % 12 else [w for w in words[:5] for _ in range(10)]
        rows.append((k, " ".join(words)))
        labels.append((k, int(not bad), 0))
    docs = fx.documents(spark, rows + [(5000, None), (None, "no id at all"), (5001, "")])
    marks = spark.createDataFrame(labels[:800] + [(None, 1, 0), (3, None, 0)], LABELS)
    kept = quality.keep_good(docs, marks)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    unseen = labels[800:]
    assert np.mean([(i in ids) == bool(q) for i, q, _ in unseen]) > 0.97
    assert quality.score(docs, marks).count() == len(rows) + 3


def test_quality_with_clashing_columns_and_a_hot_id(spark):
    """A caller's own quality and quality_score stay; a labelled id on a third of the rows brings one row to the fit."""
    rng = random.Random(3)
    rows = [(k, fx.sentence(rng, 30) if k % 4 else " ".join(["win$$$"] * 8)) for k in range(400)]
    docs = fx.documents(spark, rows + [(7, fx.sentence(rng, 5)) for _ in range(200)]).withColumn("quality", F.lit("mine")).withColumn("quality_score", F.lit(-5.0))
    marks = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(300)], LABELS)
    kept = quality.keep_good(docs, marks)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert {(r.quality, r.quality_score) for r in got} == {("mine", -5.0)} and 250 < len(got) < 550
    scored = quality.score(docs, marks)
    assert scored.columns.count("quality_score") == 1 and scored.filter("quality_score < 0").count() == 0
    one = quality._read(docs).join(marks.select("doc_id"), "doc_id")
    assert one.filter("doc_id = 7").count() == 201
    assert toxicity._labelled(docs, spark.createDataFrame([(k, 1, k % 2) for k in range(300)], LABELS)).filter("doc_id = 7").count() <= 1


def test_quality_ranks_every_unlabelled_row(spark):
    """What is taught are the surest of all unlabelled rows, found over any partitioning."""
    rng = random.Random(8)
    rows = [(k, fx.sentence(rng, 20 + k % 9) + ("!" * (k % 50))) for k in range(900)]

    class Marks:
        def margin(self, x):
            return x[:, 0].astype(float)

    unlabelled = quality._read(fx.documents(spark, rows).repartition(7))
    found = quality._ranker(unlabelled)({"text": Marks(), "page": Marks()}, {"text": (1.0, 0.0), "page": (1.0, 0.0)}, {"text": set(), "page": set()})
    texts = dict(rows)
    share = sorted((-next(quality.text_features(pa.array([texts[k]])))[2][0, 0], k) for k, _ in rows)
    best = found["text", 1]
    assert best.sure.tolist() == [-s for s, _ in share[:quality.TAUGHT]] and len({k for k, _ in best.keys}) == quality.TAUGHT


def test_workers_without_this_package(tmp_path):
    """Models travel with the job: the workers of this session cannot import the package."""
    code = f"""
import os, sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
from finsieve.session import build_session
from finsieve.llm import lm_scoring, quality, substring_dedup, toxicity, periodic_runs
from pyspark.sql import functions as F
os.chdir({str(tmp_path)!r})
os.environ["PYTHONPATH"] = ""
spark = build_session("apart", "local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.checkpoint.dir": {str(tmp_path)!r},
    "spark.executorEnv.PYTHONPATH": ""}})
def absent(batches):
    import importlib.util
    for b in batches:
        assert importlib.util.find_spec("finsieve") is None
        yield b
rows = [(k, f"some words {{k}} of a text {{'!' * (k % 3)}}", "en", f"s{{k % 2}}", 10) for k in range(60)]
docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
labels = spark.createDataFrame([(k, int(k % 3 > 0), int(k % 3 == 0)) for k in range(60)], "doc_id long, quality int, toxic int")
docs.select("doc_id").mapInArrow(absent, "doc_id long").count()
assert quality.score(docs, labels).filter("quality_score is not null").count() == 60
assert toxicity.score(docs, labels).filter("score is not null").count() == 60
assert lm_scoring.score(docs).filter("score is not null").count() == 60
assert substring_dedup.remove_repeats(docs).count() == periodic_runs.collapse(docs).count() == 60
print("all went")
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600, cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""})
    assert "all went" in done.stdout, done.stderr[-3000:]


def test_model_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "REPLICA_TOKENS", 200)
    rng = random.Random(17)
    rows = [(k, fx.sentence(rng, rng.randint(5, 80))) for k in range(120)] + [(None, "no id")] * 3
    a, b = ({(r.doc_id, r.n_tokens): r.score for r in lm_scoring.score(fx.documents(spark, rows).repartition(n)).collect()} for n in (2, 7))
    assert a == b and lm_scoring.replicas(10_000) > 1


def test_quality_picks_unlabelled_rows_where_they_are_ranked(spark):
    """Rows without a label are told in the task that ranks them, so a task holds one Python worker."""
    rows = [(k, f"text {k}") for k in range(400)] + [(None, "no id"), (9, "other text"), (10, "other text")]
    labelled = spark.createDataFrame([(k,) for k in range(0, 400, 2)], "doc_id long")
    every, wanted = quality._unlabelled(quality._read(fx.documents(spark, rows).repartition(5)), labelled)
    assert "MapInArrow" not in every._jdf.queryExecution().executedPlan().toString()
    found = [row for b in every.toArrow().to_batches() for row in b.filter(pa.array(wanted(b))).select(["doc_id", "text"]).to_pylist()]
    got = sorted((r["doc_id"], r["text"]) for r in found)
    assert got == sorted([(k, f"text {k}") for k in range(1, 400, 2)] + [(quality._NO_ID, "no id"), (9, "other text")])


def test_quality_without_both_labels(spark):
    docs = fx.documents(spark, [(1, "a"), (2, None)])
    assert quality.keep_good(docs, spark.createDataFrame([], LABELS)).count() == 2
    assert quality.keep_good(docs, spark.createDataFrame([(1, 1, 0)], LABELS)).count() == 2
    assert quality.score(fx.empty(spark), spark.createDataFrame([], LABELS)).count() == 0


def test_features_do_not_depend_on_neighbours():
    texts = ["One two two!!", None, "", "ünï $$$ ###", "x" * 700_000, "last words here"]
    together = np.concatenate([f for *_, f in quality.text_features(pa.array(texts))])
    alone = np.concatenate([f for t in texts for *_, f in quality.text_features(pa.array([t], pa.string()))])
    assert np.allclose(together, alone)


# language model --------------------------------------------------------------------------

def test_gradients(monkeypatch):
    monkeypatch.setattr(recurrent, "WINDOW", 500)
    rng = np.random.default_rng(0)
    n = 60
    s = recurrent.Stream(rng.integers(1, recurrent.INPUTS, n).astype(np.int16), rng.integers(0, recurrent.CLASSES, n).astype(np.int16),
                         rng.integers(0, recurrent.MEMBERS, n).astype(np.int8), np.array([7, 13, 20, 20]))
    ends = np.cumsum(s.sizes) - 1
    s.inputs[ends] = s.classes[ends] = s.members[ends] = 0
    p = recurrent.Parameters.start(rng.integers(1, 50, recurrent.SHORTLIST), rng.random(recurrent.TAIL) * 100 + 1)
    network, seen = recurrent.Network(p), {}

    class Keep:
        def step(self, _, grads):
            seen.update({k: g.copy() for k, g in grads.items()})

    network.train(s, Keep())
    for name, g in seen.items():
        values = getattr(p, name).reshape(-1)
        at = int(np.abs(g).argmax())
        old = values[at]
        loss = []
        for step in (0.01, -0.01):
            values[at] = old + step
            loss.append(-float(network.log_chances(s).astype(np.float64).sum()) / n)
        values[at] = old
        assert (loss[0] - loss[1]) / 0.02 == pytest.approx(g.reshape(-1)[at], rel=0.02)


def test_members_of_all_classes_at_once_equal_those_class_by_class():
    rng = np.random.default_rng(4)
    c = np.concatenate([rng.integers(0, 3, 70), [7], rng.integers(recurrent.HEAD_CLASSES, recurrent.CLASSES, 20)])
    h, m = rng.normal(size=(91, recurrent.HIDDEN)).astype(np.float32), rng.integers(0, recurrent.MEMBERS, 91)
    p = recurrent.Parameters.start(rng.integers(1, 50, recurrent.SHORTLIST), np.ones(recurrent.TAIL))
    grads, dh = {k: np.zeros_like(getattr(p, k)) for k in ("members", "member_bias")}, np.zeros_like(h)
    recurrent._Members(p, h, c, m).gradients(grads, dh, np.float32(0.5))
    network, plain, reached = recurrent.Network(p), {k: np.zeros_like(v) for k, v in grads.items()}, np.zeros_like(h)
    for k, rows in network._by_class(c):
        e, total, _ = network._members(h[rows], k, m[rows])
        e /= total[:, None]
        e[np.arange(len(rows)), m[rows]] -= 1
        plain["members"][k], plain["member_bias"][k] = h[rows].T @ e * 0.5, e.sum(axis=0) * 0.5
        reached[rows] = e @ p.members[k].T
    assert all(np.allclose(grads[k], plain[k], atol=1e-5) for k in plain) and np.allclose(dh, reached, atol=1e-5)


def test_windows_carry_the_state(monkeypatch):
    rng = np.random.default_rng(1)
    s = recurrent.Stream(rng.integers(1, 900, 100).astype(np.int16), rng.integers(0, recurrent.CLASSES, 100).astype(np.int16),
                         rng.integers(0, recurrent.MEMBERS, 100).astype(np.int8), np.array([100]))
    network = recurrent.Network(recurrent.Parameters.start(np.ones(recurrent.SHORTLIST), np.ones(recurrent.TAIL)))
    monkeypatch.setattr(recurrent, "SCORE_WINDOW", 8)
    short = network.log_chances(s)
    monkeypatch.setattr(recurrent, "SCORE_WINDOW", 1000)
    assert np.allclose(short, network.log_chances(s), atol=1e-5)


def test_lanes_hold_every_token_once():
    sizes = np.array([5, 1, 30, 2, 2, 9, 1])
    out = recurrent.lanes(sizes, 4)
    assert sorted(out[out >= 0].tolist()) == list(range(sizes.sum()))
    assert (np.diff((out >= 0).sum(axis=0)) <= 0).all()


def test_lm_counts_and_normalisation(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HEAD_WORDS", 40)  # most words meet their counts in the join
    rows = [(i, t) for i, t in fx.texts() if i not in (41, 42)]
    got = lm_scoring.score(fx.documents(spark, rows)).collect()
    learning = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    count = Counter(w for t in learning for w in [*fx.words(t), 0])
    total, distinct = sum(count.values()), len(count)
    base = lambda t: sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in [*fx.words(t), 0])
    expected = sorted((i is None, i or 0, len(fx.words(t)) + 1, sum(count[w] > 0 for w in [*fx.words(t), 0]), round(base(t), 6)) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == expected
    assert all(r.train_tokens == total and r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 2) for r in got)
    assert all(-1e9 < r.score < 0 for r in got)


def test_lm_chances_sum_to_one(spark):
    rows = [(i, t) for i, t in fx.texts() if i not in (41, 42)]
    learning = fx.documents(spark, rows).filter(lm_scoring.is_learning())
    counts = lm_scoring.word_counts(learning)
    v = lm_scoring.build_vocabulary(counts, learning.count())
    p = lm_scoring.train(learning, spark.sparkContext.broadcast(v))
    network = recurrent.Network(p)
    h = np.random.default_rng(0).normal(size=(3, recurrent.HIDDEN)).astype(np.float32)
    one = np.zeros(3, int)
    for parts, total, chosen in (network._classes(h, one), network._members(h, 2, one)):
        assert np.allclose(parts.sum(axis=1), total) and np.allclose(np.exp(chosen), parts[:, 0])
    # known words of a tail class and one place for all unseen ones share the class's mass
    listed = set(v.shortlist.view(np.int64).tolist())
    mass = np.ones(recurrent.TAIL)
    for r in counts.collect():
        if r.word not in listed:
            mass[r.tail] += r.n + 1
    assert np.allclose(mass, v.tail_mass)


def test_lm_beats_the_base_on_held_out_rows(spark):
    rng = random.Random(3)
    kinds = [[f"{c}{k}" for k in range(60)] for c in "abcd"]
    rows = [(i, " ".join(rng.choice(kinds[i % 4]) for _ in range(120))) for i in range(400)]
    got = lm_scoring.score(fx.documents(spark, rows)).filter("held_out").collect()
    assert len(got) > 20 and np.mean([r.score > r.base_score for r in got]) > 0.95


def test_lm_size_and_steps_are_not_cut():
    p = recurrent.Parameters.start(np.ones(recurrent.SHORTLIST), np.ones(recurrent.TAIL))
    assert p.recurrent.shape == (24, 72) and p.classes.shape == (24, 32 + 64) and recurrent.RATE == 0.004
    rng = np.random.default_rng(2)
    n = 64 * 96
    s = recurrent.Stream(rng.integers(1, 900, n).astype(np.int16), rng.integers(0, recurrent.CLASSES, n).astype(np.int16),
                         rng.integers(0, recurrent.MEMBERS, n).astype(np.int8), np.full(64, 96))
    adam = recurrent.Adam()
    recurrent.Network(p).train(s, adam)
    assert adam.t == 4  # a step per 64 x 24 tokens


def test_lm_without_rows(spark):
    assert lm_scoring.score(fx.empty(spark)).count() == 0


# shared reading of texts -----------------------------------------------------------------

def test_words_and_shingles_match_plain_python():
    texts = [t for _, t in fx.texts()][:20]
    for lo, hi, data, offsets in tokens.text_chunks(pa.array(texts), 200):
        found = tokens.spans(data, offsets, tokens.NOT_SPACE)
        hashes = tokens.Prefix(data).of(found.starts, found.ends)
        _, first = tokens.shingles(hashes, found.first, 5)
        for k in range(hi - lo):
            own = slice(found.first[k], found.first[k + 1])
            plain = fx.words(texts[lo + k])
            assert [fx.fold(bytes(data[a:b]).decode()) for a, b in zip(found.starts[own], found.ends[own], strict=True)] == plain
            assert first[k + 1] - first[k] == (len(plain) - 4 if len(plain) >= 5 else min(len(plain), 1))
