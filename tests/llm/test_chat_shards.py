"""Chat formatting and sharding against brute force; the pipeline's contract."""

import random
from collections import defaultdict

from finsieve.llm import chat, kd_sharding
from tests.llm import fixtures as fx

TURNS = "conv_id long, turn int, role string, text string, part string, position int"


def _conversations(spark, rows):
    return spark.createDataFrame([(*r, "p", 1) for r in rows], TURNS).repartition(3)


def _rows():
    rng = random.Random(7)
    rows = []
    for k in range(30):
        seed = random.Random(k % 6)
        turns = [("user" if t % 2 == 0 else "assistant", fx.sentence(seed, 4)) for t in range(12)]
        rows += [(k, t, *turns[t]) for t in range(rng.randint(1, 12))]
    rows += [(40, 0, None, None), (41, 0, None, None), (42, 0, "", ""), (None, 0, "user", "nobody"), (None, 1, "user", "knows")]
    rows += [(50, None, "system", "first"), (50, 3, "user", "then <|im_end|> this"), (51, 0, "user", "tie"), (51, 0, "assistant", "tie"), (51, 0, "user", "tie")]
    rows += [(60, t, "user", f"turn {t}") for t in range(2500)] + [(61, t, "user", f"turn {t}") for t in range(1500)]
    return rows


def _maximal(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        turns[c].append((-1 if t is None else t, r or "", x or ""))
    said = {c: [x[1:] for x in sorted(v)] for c, v in turns.items()}
    kept = set()
    for c, s in said.items():
        order = lambda x: -(1 << 63) if x is None else x
        inner = any(len(o) > len(s) and o[:len(s)] == s for o in said.values())
        if not inner and order(c) == min(order(d) for d, o in said.items() if o == s):
            kept.add(c)
    return kept, said


def test_chat_keeps_maximal_conversations(spark):
    rows = _rows()
    kept, said = _maximal(rows)
    got = chat.render(_conversations(spark, rows)).collect()
    assert {r.conv_id for r in got} == kept
    parts = defaultdict(dict)
    for r in got:
        parts[r.conv_id][r.part] = r
    assert len(parts[60]) == 3 and max(r.n_turns for r in got) <= chat.STRETCH
    for c, held in parts.items():
        assert sum(r.n_turns for r in held.values()) == len(said[c])
        if c != 51:
            text = "".join(held[k].text for k in sorted(held))
            assert text == "".join(f"<|im_start|>{r}\n{x.replace('<|im_', '<| im_')}<|im_end|>\n" for r, x in said[c])
    assert chat.render(_conversations(spark, [])).count() == 0


def test_chat_of_many_turns_without_id_or_number(spark, monkeypatch):
    """A third of the rows share one missing id and one turn number; ranges cut among them."""
    monkeypatch.setattr(chat, "RANGE", 700)
    rows = [(None, 0, "user", f"line {k % 900}") for k in range(3000)] + [(k % 600, k // 600, "user", f"own {k % 600} {k // 600}") for k in range(6000)]
    rows += [(700, t, "user", f"own 3 {t}") for t in range(4)]
    placed = chat.positioned(_conversations(spark, rows))
    assert placed.filter("conv < 0").select("position").distinct().count() == 3000
    parts = placed.groupBy("conv", "part").count()
    assert parts.agg({"count": "max"}).first()[0] <= chat.STRETCH
    got = chat.render(_conversations(spark, rows)).collect()
    assert {r.conv_id for r in got} == {None, *range(600)} and max(r.n_turns for r in got) <= chat.STRETCH
    nobody = "".join(r.text for r in sorted((r for r in got if r.conv_id is None), key=lambda r: r.part))
    assert sorted(nobody.split("<|im_end|>\n")[:-1]) == sorted(f"<|im_start|>user\nline {k % 900}" for k in range(3000))


def test_equal_rows_are_divided(spark):
    rows, sizes = _shards(spark, fx.documents(spark, [(None, "the same row")] * 1000), 40)
    assert len(rows) == 1000 and max(sizes.values()) <= 1.3 * 1000 * 28 / 40 and len(sizes) == 40


def _shards(spark, docs, n):
    rows = kd_sharding.shard(docs, n).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for held in by.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
    return rows, {k: sum(r.size for r in v) for k, v in by.items()}


def test_shards_have_near_equal_bytes(spark):
    rng = random.Random(2)
    docs = [(k if k % 5 else 7, fx.sentence(rng, rng.randint(5, 60)) if k % 3 else "the same text for a third of all") for k in range(3000)]
    rows, sizes = _shards(spark, fx.documents(spark, docs), 40)
    assert sorted(r.size for r in rows) == sorted(len(t.encode()) + 16 for _, t in docs)
    mean = sum(sizes.values()) / 40
    assert set(sizes) == set(range(40)) and max(sizes.values()) < 1.1 * mean and min(sizes.values()) > 0.9 * mean
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_shards_of_awkward_rows(spark):
    rows, _ = _shards(spark, fx.documents(spark), 5)
    assert len(rows) == len(fx.texts()) and {r.shard for r in rows} <= set(range(5))
    assert kd_sharding.shard(fx.empty(spark), 5).count() == 0
    one, _ = _shards(spark, fx.documents(spark, [(1, None)] * 4), 3)
    assert [r.size for r in one] == [16] * 4


def test_pipeline_stages(spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    docs = fx.documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[1:3]:
        out = stage(spark, docs, "unused")
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "unused")
    assert last.filter("not restored").count() == 0 and last.count() == docs.count()
