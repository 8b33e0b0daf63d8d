"""The pipeline, the learned scorers and one query's SQL against plain versions that hold all rows at once."""

import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from finsieve.llm import decontaminate, quality, toxicity
from finsieve.llm.sql import SQL
from tests.llm import fixtures as fx

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=700, seed=21):
    """(documents, labels, benchmark): every sixth document is bad; copies, near copies and benchmark passages are planted among the good."""
    rng = random.Random(seed)
    bench = [(k, fx.sentence(rng, size)) for k, size in enumerate((9, 16, 30, 44))] + [(None, fx.sentence(rng, 25)), (None, fx.sentence(rng, 31))]
    rows, labels = [], []
    for k in range(n):
        words = fx.sentence(rng, rng.randint(25, 60)).split()
        bad = k % 6 == 0
        if bad:
            words = [w + rng.choice(["$$$", "###"]) for w in words]
        elif k % 7 == 1 and rows:
            words = rows[rng.randrange(len(rows))][1].split()
            words = [w.upper() for w in words] if k % 2 else words
        elif k % 7 == 2 and rows:
            words = rows[rng.randrange(len(rows))][1].split() + ["more"]
        elif k % 7 == 3 and k % 3 == 0:
            words[5:5] = rng.choice(bench)[1].split()
        rows.append((k, " ".join(words)))
        labels.append((k, int(not any("$" in w or "#" in w for w in words)), 0))
    return rows, labels, bench


def near_survivors(rows):
    """Of every class of rows linked at a five-word Jaccard of 0.8 the smallest id."""
    parents = {i: i for i, _ in rows}
    sets = {i: fx.grams(t) for i, t in rows}
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and len(x & y) * 10 >= 8 * len(x | y) > 0:
                p, q = fx.root(parents, a), fx.root(parents, b)
                parents[max(p, q)] = min(p, q)
    return [(i, t) for i, t in rows if fx.root(parents, i) == i]


def holds(text, items):
    """Whether a window of the text agrees with one of an item in eight tenths of its words."""
    w = fx.words(text)
    for _, u in items:
        v = fx.words(u)
        width = min(decontaminate.WINDOW, len(v))
        for at in range(len(w) - width + 1):
            for k in range(len(v) - width + 1):
                if sum(x == y for x, y in zip(w[at:at + width], v[k:k + width], strict=True)) * 10 >= decontaminate.AGREE * width:
                    return True
    return False


def test_pipeline_equals_plain_stages(spark, tmp_path):
    import corpus_pipeline

    rows, labels, bench = corpus()
    docs = fx.documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels[:450], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    good = [(r.doc_id, r.text) for r in corpus_pipeline.quality_stage(spark, docs, str(tmp_path)).collect()]
    ids = {i for i, _ in good}
    assert np.mean([(i in ids) == bool(q) for i, q, _ in labels[450:]]) > 0.97
    newest = defaultdict(int)
    for i, t in good:
        newest[fx.fold(t)] = max(newest[fx.fold(t)], i)
    distinct = [(i, t) for i, t in good if newest[fx.fold(t)] == i]
    single = near_survivors(distinct)
    clean = [(i, t) for i, t in single if not holds(t, bench)]
    assert len(good) > len(distinct) > len(single) > len(clean) > 0
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(clean)
    assert all(r.restored and r.n_pieces == len(r.ids) > 0 for r in got)


def test_co_training_equals_one_pass_over_all_rows(spark, monkeypatch):
    """The rounds with a plain ranking of all unlabelled rows give the scores that the tasks, bitmaps and joins give."""
    monkeypatch.setattr(quality, "TAUGHT", 30)
    rows, labels, _ = corpus(seed=22)
    docs = fx.documents(spark, rows + [(None, "no id"), (5000, None), (5001, ""), (699, rows[699][1])])
    marks = spark.createDataFrame(labels[:300] + [(None, 1, 0), (650, None, 0)], LABELS)
    known = {i: q for i, q, _ in labels[:300]}
    read = quality._read(docs).collect()

    def features(of):
        page = quality.metadata_features(pa.array([r.source for r in of], pa.string()), pa.array([r.lang for r in of], pa.string()), pa.array([r.n_chars for r in of], pa.int64()))
        text = np.concatenate([x for _, _, x in quality.text_features(pa.array([r.text for r in of], pa.string()))])
        return {"text": text.astype(np.float32), "page": page.astype(np.float32)}

    pool = sorted({(r.doc_id, r.mark): r for r in read if r.doc_id not in known}.items())
    keys, apart = [k for k, _ in pool], features([r for _, r in pool])

    def ranked(models, calibrations, taken):
        out = {}
        for v, other in (("text", "page"), ("page", "text")):
            sure = calibrations[v][0] * models[v].margin(apart[v]) + calibrations[v][1]
            for label, sign in ((1, 1.0), (0, -1.0)):
                best = sorted((-sign * sure[k], key, k) for k, key in enumerate(keys) if key not in taken[other])[:30]
                at = [k for _, _, k in best]
                out[v, label] = quality.Surest([keys[k] for k in at], sure[at], {w: apart[w][at] for w in apart})
        return out

    taught = sorted((r for r in read if r.doc_id in known), key=lambda r: r.doc_id)
    y = np.array([float(known[r.doc_id]) for r in taught])
    held = quality.tokens.mix(np.array([r.doc_id for r in taught]).astype(np.uint64)) % np.uint64(4) == 0
    pair = quality.co_train(features(taught), y, held, ranked)
    whole = features(read)
    expected = sorted(zip([(r.doc_id, r.mark) for r in read], *pair.scores(whole["text"], whole["page"]), strict=True))
    scored = quality.score(docs.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit("")))), marks).collect()
    got = sorted(((quality._NO_ID if r.doc_id is None else r.doc_id, r.mark), r.text_score, r.page_score, r.quality_score) for r in scored)
    assert [g[0] for g in got] == [e[0] for e in expected]
    assert np.allclose([g[1:] for g in got], [e[1:] for e in expected], atol=1e-6)


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(31)
    rows = []
    for k in range(400):
        words = fx.sentence(rng, rng.randint(4, 40)).split()
        if k % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "moron"])
        rows.append((k, " ".join(words)))
    rows += [(5000, None), (5001, ""), (None, "no id"), (5002, "word " * 3000), (5003, "one"), (5004, "der die und das idiot")]
    return rows, [(k, 1, int(k % 4 == 0)) for k in range(400)]


def test_toxicity_equals_plain_convolution(spark, toxic):
    rows, labels = toxic
    docs, marks = fx.documents(spark, rows), spark.createDataFrame(labels, LABELS)
    model = toxicity.train(docs, marks)

    def plain(text):
        (_, _, batch), = toxicity.read_words(pa.array([text], pa.string()))
        x = [sum(model.embedding[k].astype(float) for k in row) for row in batch.rows]
        pooled = []
        for g, kernel in enumerate(model.filters):
            for f in range(toxicity.FILTERS):
                values = [sum(x[i + k] @ kernel[k][:, f] for k in range(len(kernel))) for i in range(len(x) - toxicity.PAD + 1)]
                pooled.append(max(0.0, max(values) + model.offsets[g * toxicity.FILTERS + f]))
        raw = 1 / (1 + np.exp(-(np.dot(pooled, model.weights) + model.bias)))
        cut = model.thresholds[batch.language[0]]
        return 0.5 * raw / cut if raw < cut else 0.5 + 0.5 * (raw - cut) / (1 - cut)

    got = {r.doc_id: r.score for r in toxicity.score(docs, marks).collect()}
    assert len(got) == len(rows)
    for i, t in rows[::9] + rows[400:]:
        assert got[i] == pytest.approx(plain(t), abs=1e-4)


def test_toxicity_never_learns_from_held_out_rows(spark, toxic):
    rows, labels = toxic
    docs = fx.documents(spark, rows)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    assert turned != labels
    a, b = ({r.doc_id: r.score for r in toxicity.score(docs, spark.createDataFrame(x, LABELS)).collect()} for x in (labels, turned))
    assert a == b


def test_decontamination_sql_finds_items_without_an_id(spark):
    rng = random.Random(12)
    first, second, named = (fx.sentence(rng, 24) for _ in range(3))
    rows = [(1, f"before {first} after"), (2, f"{second} after"), (3, named), (4, fx.sentence(rng, 40)), (5, f"{named} {first} {second}"), (6, None)]
    bench = [(None, first), (None, second), (8, named), (9, named), (7, "")]
    db = duckdb.connect()
    db.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    db.register("benchmark", pd.DataFrame({"item_id": pd.array([i for i, _ in bench], "Int64"), "text": [t for _, t in bench]}))
    told = db.sql(SQL["op1_benchmark_decontamination"]).fetchall()
    got = decontaminate.contaminated(fx.documents(spark, rows), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(1, None), (2, None), (5, None), (3, 8), (5, 8)} == {r[:2] for r in told}
    assert sorted(map(str, told)) == sorted(str(tuple(r)) for r in got)
