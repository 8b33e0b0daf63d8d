"""Wide steps: each window once, methods the JVM compiles, forests drawn and walked batch by batch."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from finsieve.operators import boosting
from finsieve.operators import features as fea
from finsieve.operators import isolation as iso
from finsieve.session import compiled_methods, materialize
from tests.test_panel import long_rows, wide


def test_feature_windows_are_worked_out_once(spark):
    node = fea.feature_table(wide(spark, long_rows("1", "revenue", {2019: 1.0, 2020: 2.0})))._jdf.queryExecution().optimizedPlan()
    found = []
    while node.children().size():
        if node.nodeName() == "Window":
            found.append(node.windowExpressions().size())
        node = node.children().head()
    assert found == [30]


def test_landing_keeps_methods_short_and_restores_the_setting(spark, tmp_path):
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    with compiled_methods(spark):
        assert spark.conf.get(key) == "8000"
    assert spark.conf.get(key) == before
    rows = spark.range(50).select("id", *[F.expr(f"case when id % {k} = 0 then null else id / {k} end").alias(f"c{k}") for k in range(1, 61)])
    assert sorted(materialize(rows, "wide").collect(), key=str) == sorted(rows.collect(), key=str) and spark.conf.get(key) == before


def _rows(spark, n: int, seed: int):
    rng = np.random.default_rng(seed)
    data = [(f"{k % 97:010d}", 1990 + k // 97, [float(v) for v in np.round(rng.normal(size=4), 2)]) for k in range(n)]
    return data, spark.createDataFrame(data, "cik string, year int, features array<double>")


def test_samples_follow_tickets_and_are_drawn_without_exploding_rows(spark):
    from hashlib import md5

    data, df = _rows(spark, 900, 5)
    drawn = iso.draw_samples(df.repartition(5), len(data), trees=7, sample=32, seed=3)
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    got = {(r["tree"], r["rank"]): r["features"] for r in drawn.collect()}
    for t, (factor, offset) in enumerate(iso.ticket_numbers(7, 3)):
        tickets = sorted(((int(md5(f"{c}|{y}|3".encode()).hexdigest()[:7], 16) * factor + offset) % iso.PRIME, c, y, x) for c, y, x in data)
        assert [got[t, k] for k in range(1, 33)] == [x for *_, x in tickets[:32]]


def test_anomaly_equals_a_plain_walk(spark):
    data, df = _rows(spark, 600, 6)
    arrays = iso.forest_arrays(iso.grow_forest(df, len(data), trees=9, sample=64, seed=1))
    got = {(r["cik"], r["year"]): r["a"] for r in df.select("cik", "year", iso.anomaly(arrays, len(data), F.col("features"), 64).alias("a")).collect()}

    def depth(tree, x):
        feature, threshold, left, right, deep = tree
        at = 0
        while feature[at] >= 0:
            at = left[at] if x[feature[at]] <= threshold[at] else right[at]
        return deep[at]

    for c, y, x in data:
        assert got[c, y] == pytest.approx(math.exp2(-sum(depth(t, x) for t in arrays) / 9 / iso.mean_path(64)), abs=1e-15)
    # a leaf leads to itself, so extra levels change nothing
    feature, _, child, _, steps = iso._stepped(*arrays[0])
    leaves = np.flatnonzero(arrays[0][0] < 0)
    assert (child[2 * leaves] == leaves).all() and (child[2 * leaves + 1] == leaves).all() and 0 < steps <= 6


def test_bringing_margins_up_to_date_is_no_job_of_its_own(spark):
    rng = np.random.default_rng(8)
    data = [(0, int(k), float(rng.random() < 0.4), 1.0, [float(v) for v in rng.normal(size=3)]) for k in range(400)]
    rows = spark.createDataFrame(data, "grp int, key long, y double, w double, features array<double>").repartition(3)
    cuts, sc = boosting.quantile_cuts(rows, 3, 16), spark.sparkContext

    def jobs(trees: int) -> int:
        sc.setJobGroup(f"fit-{trees}", "")
        try:
            settings = boosting.Settings(trees=trees, depth=1, bins=16, min_child=1.0)
            assert len(boosting.fit(rows, 3, settings, cuts)[0]) == trees
            return len(sc.statusTracker().getJobIdsForGroup(f"fit-{trees}"))
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)

    assert jobs(boosting.REFRESH + 1) - jobs(boosting.REFRESH) == 1
