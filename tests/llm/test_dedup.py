"""Exact, n-gram and line deduplication against brute force."""

import hashlib
import os
import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from finsieve import session
from finsieve.llm import components, exact_dedup, line_dedup, marks, near, ngram_join
from tests.llm import fixtures as fx


def test_mphf_is_a_bijection():
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(700)]
    for n in (1, 2, 5, 300, 700):
        pilots, slots = exact_dedup.build_mphf(keys[:n])
        assert sorted(slots.tolist()) == list(range(n))
        assert (exact_dedup.lookup_mphf(pilots, keys[:n], n) == slots).all()
        assert (exact_dedup.lookup_mphf(pilots, keys, n) < n).all()


def _expected_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[fx.fold(t)].append(i)
    return groups


def test_exact_dedup(spark):
    rows = fx.texts()
    groups = _expected_exact(rows)
    got = exact_dedup.classes(fx.documents(spark)).collect()
    expected = []
    for i, t in rows:
        ids = [x for x in groups[fx.fold(t)] if x is not None]
        keep = max(ids) if ids else None
        expected.append((i, keep, len(groups[fx.fold(t)]), i == keep, hashlib.sha256(fx.fold(t).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


def test_exact_dedup_members_and_others(spark):
    history = fx.documents(spark, [(1, "One"), (2, "one"), (3, "two")])
    incoming = fx.documents(spark, [(4, "ONE"), (5, "three"), (6, "three"), (None, "two")])
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup_groups(history, incoming).collect()}
    assert got == {(1, 4, 3, False), (2, 4, 3, False), (4, 4, 3, True), (3, 3, 2, True), (None, 3, 2, False), (5, 6, 2, False), (6, 6, 2, True)}


def test_keep_unique_keeps_columns_and_one_row(spark):
    docs = fx.documents(spark)
    kept = exact_dedup.keep_unique(docs)
    assert kept.columns == docs.columns
    got = [fx.fold(r.text) for r in kept.collect()]
    assert len(got) == len(set(got)) == len(_expected_exact(fx.texts()))


def test_keep_unique_of_hot_rows(spark):
    """A third of the rows are one row, a third copies under ids of their own, some without an id; single rows stay in place."""
    rows = [(7, "the same row")] * 500 + [(k, "A Copy") for k in range(1000, 1500)] + [(None, "a copy"), (None, "nobody's"), (None, "NOBODY'S")]
    rows += [(k, f"text {k}") for k in range(2000, 2500)] + [(2000, None), (2001, "")]
    docs = fx.documents(spark, rows)
    got = sorted(((r.doc_id or 0, fx.fold(r.text)) for r in exact_dedup.keep_unique(docs).collect()))
    assert got == sorted([(7, "the same row"), (1499, "a copy"), (0, "nobody's"), (2001, "")] + [(k, f"text {k}") for k in range(2000, 2500)])
    assert exact_dedup.keep_unique(fx.empty(spark)).columns == docs.columns and exact_dedup.keep_unique(fx.empty(spark)).count() == 0



def test_banding():
    bands, rows = near.choose_banding(0.8, 0.9999, 192)
    assert bands * rows <= 192 and 1 - (1 - 0.8**rows) ** bands >= 0.9999
    with pytest.raises(ValueError):
        near.choose_banding(0.8, 0.9999, 1)


def _classes(rows, threshold=0.8):
    sets = [fx.grams(t) for _, t in rows]
    parent = {k: k for k in range(len(rows))}
    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            union = len(sets[a] | sets[b])
            if fx.words(rows[a][1]) == fx.words(rows[b][1]) or (union and shared >= threshold * union):
                links[a] += 1
                links[b] += 1
                x, y = fx.root(parent, a), fx.root(parent, b)
                parent[max(x, y)] = min(x, y)
    members = defaultdict(list)
    for k in range(len(rows)):
        members[fx.root(parent, k)].append(k)
    out = []
    for group in members.values():
        ids = [rows[k][0] for k in group if rows[k][0] is not None]
        out += [(rows[k][0], min(ids) if ids else None, links[k], len(group)) for k in group]
    return out


def test_ngram_classes_and_links(spark):
    got = ngram_join.classes(fx.documents(spark)).select("doc_id", "class_id", "n_links", "class_size").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, _classes(fx.texts())))


def test_blocks_lose_no_link(spark, monkeypatch):
    rng = random.Random(3)
    words = fx.sentence(rng, 90).split()
    rows = []
    for k in range(40):
        w = list(words)
        for at in rng.sample(range(90), 2):
            w[at] = f"v{k}x{at}"
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(near, "BLOCK", 7)
    got = ngram_join.classes(fx.documents(spark, rows)).select("doc_id", "class_id", "n_links", "class_size").collect()
    assert sorted(map(tuple, got)) == sorted(_classes(rows))


def test_one_per_class(spark):
    docs = fx.documents(spark)
    kept = ngram_join.keep_one_per_class(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    classes = _classes(fx.texts())
    assert len(rows) == len({(c, s) if c is not None else (c, s, "none") for _, c, _, s in classes})
    assert len([x for x in _classes(rows) if x[3] > 1]) == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(a, a + 1) for a in range(0, 60)] + [(100, 100 + k) for k in range(1, 50)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)] + [(7, 7)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        x, y = fx.root(parent, a), fx.root(parent, b)
        parent[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: fx.root(parent, x) for x in linked}
    assert components.connected(spark.createDataFrame([], "u long, v long")).count() == 0


def _plain_lines(rows):
    lines, seen = [], set()
    for i, t in rows:
        if (i, t) in seen:
            continue
        seen.add((i, t))
        for k, line in enumerate((t or "").split("\n")):
            b = fx.fold(line).strip(" \t\n\x0b\x0c\r")
            if b:
                lines.append((i if i is not None else 1 << 62, k, b))
    sets = {b: frozenset(b[x:x + line_dedup.WIDTH] for x in range(max(1, len(b) - line_dedup.WIDTH + 1))) for *_, b in lines}
    keys = list(sets)
    parent = {b: b for b in keys}
    for x in range(len(keys)):
        for y in range(x):
            a, b = sets[keys[x]], sets[keys[y]]
            if len(a & b) >= 0.8 * len(a | b):
                parent[fx.root(parent, keys[x])] = fx.root(parent, keys[y])
    best = {}
    for i, k, b in sorted(lines, key=lambda x: x[:2]):
        best.setdefault(fx.root(parent, b), (i, k))
    return {(i, k) for i, k, b in lines if best[fx.root(parent, b)] != (i, k)}


def test_line_dedup(spark):
    rng = random.Random(9)
    base = [fx.sentence(rng, 30) for _ in range(12)]
    rows = [(k, "\n".join([rng.choice(base), "", fx.sentence(rng, 12), rng.choice(base) + f" {k}", "ok"])) for k in range(25)]
    rows += [(30, None), (31, ""), (32, "\n \n"), (None, base[0] + "\nonly here without an id"), (40, base[1]), (40, base[1]), (41, "\n".join(["long"] * 2000))]
    got = line_dedup.dedup(fx.documents(spark, rows)).collect()
    gone = _plain_lines(rows)
    for r in got:
        i = r.doc_id if r.doc_id is not None else 1 << 62
        lines = (r.text or "").split("\n")
        own = {k for j, k in gone if j == i}
        assert r.n_dropped == len(own)
        original = dict(rows)[r.doc_id]
        if original is None:
            assert r.text is None and r.n_lines == 0
        else:
            assert lines == [x for k, x in enumerate(original.split("\n")) if k not in own] or (not lines[0] and len(own) == r.n_lines)
    assert len(got) == len(rows)


def test_short_lines_with_one_changed_character_are_linked(spark):
    """From 49 characters on a changed inner character leaves a Jaccard of 0.8, in any script; shorter lines stay apart."""
    rng = random.Random(21)
    letters = ["abcdefghijklmnopqrstuvwxyz", "äéöüñçßàèì", "日本語文字列処理中国漢字"]
    rows, expected = [], set()
    for k in range(180):
        n = rng.randint(40, 95)
        line = "".join(rng.choice(letters[k % 3]) for _ in range(n))
        at = rng.randint(5, n - 6)
        rows += [(2 * k, line), (2 * k + 1, line[:at] + "#" + line[at + 1:])]
        grams = [{x[i:i + 5] for i in range(n - 4)} for x in (rows[-2][1], rows[-1][1])]
        if len(grams[0] & grams[1]) * 10 >= 8 * len(grams[0] | grams[1]):
            expected.add(2 * k + 1)
    got = {r.doc_id for r in line_dedup.dedup(fx.documents(spark, rows)).filter("n_dropped = 1").collect()}
    assert got == expected and len(expected) > 130


def test_line_dedup_of_rows_without_or_with_the_same_id(spark):
    rows = [(None, "only here"), (None, "common\nsecond of its own"), (5, "common"), (7, "common\nmine"), (7, "first of seven\ncommon"),
            (None, "said twice"), (None, "x\nsaid twice")]
    got = {(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup(fx.documents(spark, rows)).collect()}
    assert got == {(None, "only here", 1, 0), (None, "second of its own", 2, 1), (5, "common", 1, 0), (7, "mine", 2, 1), (7, "first of seven", 2, 1),
                   (None, "said twice", 1, 0), (None, "x", 2, 1)}


def test_empty_tables(spark):
    none = fx.empty(spark)
    assert exact_dedup.classes(none).count() == 0
    assert exact_dedup.keep_unique(none).count() == 0
    assert ngram_join.classes(none).count() == 0
    assert ngram_join.keep_one_per_class(none).count() == 0
    assert line_dedup.dedup(none).count() == 0


def test_signatures_do_not_depend_on_neighbours():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    first = np.array([0, 100, 100, 350, 500])
    together = near.bucket_keys(values, first, 4, 3)
    alone = near.bucket_keys(values[100:350], np.array([0, 250]), 4, 3)
    assert (together[2] == alone[0]).all() and (together[1] == 0).all()


def test_bucket_keys_are_mixed_once_for_all_sets(monkeypatch):
    rng = np.random.default_rng(6)
    sizes = np.array([40, 0, 1, 300, 7, 90, 0])
    first = np.concatenate([[0], np.cumsum(sizes)])
    values = rng.integers(0, 1 << 63, first[-1]).astype(np.uint64)
    whole, calls, mix = near.bucket_keys(values, first, 4, 3), [], near.mix
    monkeypatch.setattr(near, "_CACHE", 50)
    monkeypatch.setattr(near, "mix", lambda x: calls.append(len(x)) or mix(x))
    assert (near.bucket_keys(values, first, 4, 3) == whole).all() and (whole[sizes == 0] == 0).all()
    assert calls == [5] * 12


def test_bitmap_keys_are_found_in_the_task_that_sets_them(spark):
    """A key made of several columns needs no Python step of its own: a task that fills a bitmap holds one Python worker."""
    plans = []

    class Watched:
        def __init__(self, df):
            self.df = df

        def mapInArrow(self, run, schema):
            out = self.df.mapInArrow(run, schema)
            plans.append(out._jdf.queryExecution().executedPlan().toString())
            return out

        def __getattr__(self, name):
            return getattr(self.df, name)

    keys = spark.range(500).selectExpr("id as node", "id * 7 as rep")
    bitmap = marks.mark(Watched(keys), ngram_join._picks)
    own = ngram_join.pick_of(np.arange(500), np.arange(500) * 7)
    assert marks.marked(bitmap.value, own).all() and marks.marked(bitmap.value, ngram_join.pick_of(np.arange(500), np.arange(500) * 7 + 1)).sum() < 5
    assert len(plans) == 1 and plans[0].count("MapInArrow") == 1


def test_line_dedup_leaves_only_what_it_returns(spark):
    docs = fx.documents(spark)
    before = set(session._landed)
    out = line_dedup.dedup(docs)
    left = [path for path in session._landed if path not in before]
    assert len(left) == 1 and "/line-gone-" in left[0] and os.path.isdir(left[0])
    assert out.count() == len(fx.texts())


def test_landing_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles().iterator()
        names = set()
        while files.hasNext():
            names.add(files.next().getName())
        return {name for name in names if name.startswith("shuffle_")}

    before = shuffled()
    table = session.materialize(spark.range(20_000).groupBy((F.col("id") % 500).alias("k")).agg(F.sum("id").alias("s")), "probe")
    for _ in range(50):  # removed in the background
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before and table.count() == 500


def test_scratch_keeps_what_is_wanted_and_what_an_outer_one_landed(spark):
    with session.scratch(spark) as keep:
        a = session.materialize(spark.range(3), "probe")
        with session.scratch(spark) as keep_inner:
            session.materialize(spark.range(4), "probe")
            b = keep_inner(session.materialize(spark.range(5), "probe"))
        assert a.count() == 3 and b.count() == 5
        keep(a)
    assert a.count() == 3 and not os.path.exists(b._landed_at)


def test_nodes_alike_in_their_short_bits_are_told_apart(spark):
    """Bucket entries carry 40 bits of a node; nodes that share them are verified like any others."""
    high = 1 << near.SHORT_BITS
    sets = {5: range(20), 5 + high: range(100, 120), 5 + 2 * high - (1 << 63): range(21), 9: range(100, 119), 11: range(500, 520)}
    keys = {5: [1, 2], 5 + high: [3, 4], 5 + 2 * high - (1 << 63): [1, 6], 9: [3, 7], 11: [8, 9]}
    items = spark.createDataFrame([(node, [k << 40 for k in own]) for node, own in keys.items()], "node long, buckets array<long>")
    nodes = spark.createDataFrame([(k, 1) for k in keys], "node long, copies long")

    def sets_of(candidates):
        rows = [(k, bytearray(np.array(list(v), np.uint64).tobytes())) for k, v in sets.items()]
        return spark.createDataFrame(rows, "node long, elements binary").join(candidates.select("node"), "node", "left_semi")

    got = {r.node: (r.root, r.links) for r in near.near_classes(items, iter, 2, nodes, sets_of, 0.8).collect()}
    least = 5 + 2 * high - (1 << 63)
    assert got == {5: (least, 1), least: (least, 1), 5 + high: (9, 1), 9: (9, 1)}
    x = np.array([0, 5, (1 << 40) - 1, 1 << 32], np.uint64)
    assert len(near._five_bytes(x)) == 20 and (near._from_five_bytes(near._five_bytes(x), 4) == x).all()
