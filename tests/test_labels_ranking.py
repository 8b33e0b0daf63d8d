import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from finsieve.operators import labels as lab
from finsieve.operators import ranking as rk
from finsieve.plans import evaluation as ev
from finsieve.sources import masters


def years(spark, cik, *ys):
    return spark.createDataFrame([(cik, y) for y in ys], "cik string, year int")


def test_label_windows(spark):
    df = years(spark, "0000000007", *range(2014, 2021))
    fraud = spark.createDataFrame([("7", "2018-12-31"), ("7", "2018-12-31")], "cik string, fraud_date string").withColumn("fraud_date", F.to_date("fraud_date"))
    got = {r["year"]: r["is_fraud"] for r in lab.attach_fraud(df, fraud).collect()}
    assert [y for y, f in sorted(got.items()) if f] == [2015, 2016, 2017, 2018]
    bk = spark.createDataFrame([("7", "2018-06-15")], "cik string, d string").select("cik", F.to_date("d").alias("bankruptcy_date"))
    got = {r["year"]: r["is_bankrupt"] for r in lab.attach_bankruptcy(df, bk).collect()}
    assert [y for y, f in sorted(got.items()) if f] == [2016, 2017]


def test_unified_label_prefers_fraud(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (0, 0)], "is_fraud int, is_bankrupt int")
    assert [(r["label"], r["label_type"]) for r in lab.with_unified_label(df).collect()] == [(1, "fraud"), (2, "bankruptcy"), (0, "clean")]


def test_firm_years_do_not_fan_out(spark):
    raw = spark.createDataFrame([(7, 2019, 0.0), (7, 2019, 2.0), (8, 2019, None)], " CIK  long, fyear int, P_AAER double")
    firm = masters.normalise_firm_years(raw)
    got = lab.attach_firm_years(years(spark, "0000000007", 2019, 2020), firm).orderBy("year").collect()
    assert [r["is_fraud"] for r in got] == [1, 0]
    assert masters.normalise_firm_years(raw.drop("fyear")) is None


GONE = "cik string, year int, f_current_ratio double, f_debt_assets double, f_net_margin double, f_cfo_ni double, f_z_x1 double"


@pytest.mark.parametrize("last, values, hit", [
    (2017, (0.5, 0.9, None, None, None), True), (2018, (0.5, 0.9, None, None, None), False),
    (2017, (0.5, None, None, None, None), False), (2017, (0.5, 0.9, -1.0, -1.0, -1.0), True),
])
def test_gone_dark(spark, last, values, hit):
    rows = [("A", last, *values), ("A", last - 1, None, None, None, None, None), ("A", last - 2, 0.1, 0.99, -1.0, -1.0, -1.0)]
    rows += [("B", 2020, 2.0, 0.1, 0.1, 1.0, 0.1)]
    got = {(r["cik"].lstrip("0"), r["year"]) for r in lab.attach_gone_dark(spark.createDataFrame(rows, GONE)).filter("is_bankrupt = 1").collect()}
    assert got == ({("A", last), ("A", last - 1)} if hit else set())


def test_gone_dark_with_one_row(spark):
    rows = [("A", 2010, 0.5, 0.9, None, None, None), ("B", 2020, 2.0, 0.1, 0.1, 1.0, 0.1)]
    assert lab.attach_gone_dark(spark.createDataFrame(rows, GONE)).filter("is_bankrupt = 1").count() == 1


def test_holdout_drops_labelled_rows_of_seen_companies(spark):
    rows = [("A", 2015, 1, 0), ("A", 2016, 1, 0), ("A", 2017, 0, 0), ("B", 2016, 0, 1), ("C", 2014, 0, 0)]
    df = spark.createDataFrame(rows, "cik string, year int, is_fraud int, is_bankrupt int")
    train, test = lab.holdout_split(df, 2016)
    assert {(r["cik"], r["year"]) for r in train.collect()} == {("A", 2015), ("C", 2014)}
    assert {(r["cik"], r["year"]) for r in test.collect()} == {("A", 2017), ("B", 2016)}


def test_folds(spark):
    df = years(spark, "A", *range(2000, 2015))
    got = [(r["val_from"], r["val_to"], r["n_train"], r["n_val"]) for r in lab.walk_forward_folds(df).orderBy("fold").collect()]
    assert got == [(2008, 2010, 8, 3), (2011, 2013, 11, 3)]
    exact = [r["val_to"] for r in lab.walk_forward_folds(years(spark, "A", *range(2000, 2014))).orderBy("fold").collect()]
    assert exact == [2010, 2013]
    assert lab.walk_forward_folds(years(spark, "A", 2000, 2001)).count() == 0
    hole = years(spark, "A", *range(2000, 2008), 2011, 2012, 2013)
    assert [r["val_from"] for r in lab.walk_forward_folds(hole).collect()] == [2011]


def brute(scores, y):
    pos = [s for s, t in zip(scores, y) if t]
    neg = [s for s, t in zip(scores, y) if not t]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    order = sorted(set(scores), reverse=True)
    tp = n = 0
    ap = 0.0
    for s in order:
        here = [t for v, t in zip(scores, y) if v == s]
        tp, n = tp + sum(here), n + len(here)
        ap += sum(here) / len(pos) * tp / n
    return auc, ap


def ranked(spark, scores, y):
    return spark.createDataFrame([("m", s, t, f"{i:010d}", 2000) for i, (s, t) in enumerate(zip(scores, y))], "model string, score double, y int, cik string, year int")


@pytest.mark.parametrize("kind", ["smooth", "tied", "hot"])
def test_auc_ap_against_brute_force(spark, kind):
    rng = random.Random(3)
    n = 400
    scores = [rng.random() if kind == "smooth" else float(rng.randrange(8)) if kind == "tied" else (0.5 if rng.random() < 0.6 else rng.random()) for _ in range(n)]
    y = [int(rng.random() < 0.2) for _ in range(n)]
    df = ranked(spark, scores, y)
    cum = rk.cumulative(rk.score_groups(df), ranges=8)
    row = rk.auc_and_ap(cum).first()
    auc, ap = brute(scores, y)
    assert row["auc_roc"] == pytest.approx(auc) and row["auc_pr"] == pytest.approx(ap)
    mirrored = rk.auc_and_ap(rk.cumulative(rk.score_groups(ranked(spark, [-s for s in scores], y)), ranges=8)).first()
    assert mirrored["auc_roc"] == pytest.approx(1 - auc)
    recall = rk.recall_at_top(cum).first()["recall_at_5pct"]
    cut = np.quantile(scores, 0.95)
    assert recall == pytest.approx(sum(t for s, t in zip(scores, y) if s >= cut) / sum(y))


@pytest.mark.parametrize("kind", ["smooth", "hot", "constant", "missing"])
def test_lift_against_brute_force(spark, kind):
    rng = random.Random(5)
    n = 250
    scores = [{"smooth": rng.random(), "hot": 0.5 if rng.random() < 0.5 else rng.random(), "constant": 1.0,
               "missing": None if rng.random() < 0.4 else rng.random()}[kind] for _ in range(n)]
    y = [int(rng.random() < 0.2) for _ in range(n)]
    got = {r["pct_reviewed"]: r["recall"] for r in rk.lift_curve(ranked(spark, scores, y), ranges=8).collect()}
    order = sorted(range(n), key=lambda i: (-(scores[i] if scores[i] is not None else -1e300), i))
    caught = np.cumsum([y[i] for i in order])
    for i, pct in enumerate(np.arange(0.01, 1.01, 0.01)):
        k = max(1, int((0.01 + 0.01 * i) * n))
        assert got[round(1.0 + i, 1)] == pytest.approx(round(caught[k - 1] / sum(y), 4), abs=1e-4)
    assert got[100.0] == 1.0


def test_precision_divides_by_twenty_and_breaks_ties_by_key(spark):
    df = ranked(spark, [1.0] * 30, [1] * 5 + [0] * 25)
    assert rk.precision_at(df).first()["precision_at_20"] == 0.25
    assert rk.precision_at(ranked(spark, [1.0, 0.5], [1, 1])).first()["precision_at_20"] == 0.1


def test_benchmark_constant_and_no_positives(spark):
    rows = [(f"{i:010d}", 2000, int(i < 3), 0.5, float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "cik string, year int, y int, flat double, rising double")
    got = {r["model"]: r for r in ev.benchmark(df, {"rising": (0.4, 0.2)}).collect()}
    assert got["flat"]["auc_roc"] == 0.5 and got["flat"]["auc_pr"] == pytest.approx(0.3) and got["flat"]["n_test"] is None
    assert got["rising"]["auc_roc"] == 0.0 and got["rising"]["oof_recall_at_5pct"] == 0.4
    assert ev.benchmark(df.withColumn("y", F.lit(0))).count() == 0
