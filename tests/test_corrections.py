"""Growth after bare years, summaries, ties, bad cells, entities, anchors and loss-free ingestion."""

import json
import os

import pytest
from pyspark.sql import functions as F

from finsieve import session
from finsieve.functions import text as tx
from finsieve.operators import flags, labels as lab, panel as pan, ranking as rk, scores as sc, smote
from finsieve.plans import dataset, evaluation as ev
from finsieve.sources import masters, pages, sinks
from finsieve.streaming import refresh, store
from tests.test_panel import LONG, long_rows


def test_a_year_without_metrics_does_not_hide_growth(spark):
    rows = (long_rows("1", "revenue", {2018: 100.0, 2019: 150.0}) + long_rows("1", "cfo", {2018: 10.0, 2019: 5.0})
            + long_rows("1", "total_assets", {2018: 500.0, 2019: 500.0, 2020: 700.0}))
    wide = pan.company_year(spark.createDataFrame(rows, LONG))
    cap = spark.createDataFrame([], "cik string, market_cap double")
    signals = sc.company_signals(pan.history(wide), cap)
    row = signals.first()
    assert (row["last_revenue_growth"], row["last_cfo_growth"], row["last_total_assets"]) == (0.5, -0.5, 700.0)
    assert 17 in {r["rule_no"] for r in flags.detect_flags(signals).collect()}


def test_cross_validation_stands_beside_our_model_only(spark):
    schema = "model string, auc_roc double"
    tables = {t: spark.createDataFrame([("Altman Z-Score", 0.6), ("Our Model", 0.7)], schema) for t in ("fraud", "distress")}
    cv = {"fraud": spark.createDataFrame([(0.88, 0.5)], "oof_auc_roc double, oof_auc_pr double")}
    got = {(r["task"], r["model"]): r["oof_auc_roc"] for r in ev.summary(tables, cv).collect()}
    assert got == {("fraud", "Our Model"): 0.88, ("fraud", "Altman Z-Score"): None, ("distress", "Our Model"): None, ("distress", "Altman Z-Score"): None}


@pytest.mark.parametrize("ranges", [1, 2, 7, 700])
def test_every_range_is_reached(spark, ranges):
    df = spark.range(3000).select(F.lit("m").alias("model"), F.col("id").cast("double").alias("score"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    cum = rk.cumulative(rk.score_groups(df), ranges)
    assert cum.filter("above <> 2999 - score").count() == 0


def test_keys_of_any_kind_break_ties(spark):
    rows = [("m", 1.0, int(i % 2), f"K{i:03d}x", 2000 + i % 3) for i in range(40)]
    got = {r["pct_reviewed"]: r["recall"] for r in rk.lift_curve(spark.createDataFrame(rows, "model string, score double, y int, cik string, year int")).collect()}
    assert got[50.0] == 0.5 and got[5.0] == 0.05 and got[100.0] == 1.0


def test_equal_distances_go_to_the_smallest_key(spark):
    rows = [(f"{i:03d}", 2000, 1, [1.0, 2.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "cik string, year int, y int, features array<double>")
    for shuffled in (df, df.repartition(7).orderBy(F.rand(3))):
        near = smote.neighbours(shuffled, 3, 40, 1).collect()
        for r in near:
            others = [f"{i:03d}" for i in range(40) if f"{i:03d}" != r["cik"]]
            assert r["nb_cik"] == others[r["nb"] - 1]


def test_bad_cells_become_null_and_are_counted(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("cik,fraud_date,aaer_no,match_score\n12,2010-05-01,7,90\n12a,someday,x,y\n,2011-02-03,8,\n")
    got = masters.read_labels(spark, str(tmp_path / "labels.csv"))
    assert got.count() == 3 and got.filter("fraud_date is null").count() == 1
    assert masters.label_rejects(got).first()["no_date"] == 1
    raw = spark.createDataFrame([("12a", "2001", "1"), ("12", "year", "no"), ("13", "2002", "1")], "cik string, fyear string, p_aaer string")
    firm = masters.normalise_firm_years(raw).collect()
    assert len(firm) == 3 and {(r["cik"], r["year"], r["is_fraud"]) for r in firm if r["cik"] == "0000000013"} == {("0000000013", 2002, 1)}


@pytest.mark.parametrize("given, expected", [
    ("a &amp; b &lt;c&gt; &quot;d&quot;", 'a & b <c> "d"'), ("it&#8217;s &mdash; caf&eacute; &#x41;&#X2014;", "it’s — café A—"),
    ("&#128512;", "\U0001F600"), ("x&nbsp;y&#160;z", "x y z"), ("&amp;lt;", "&lt;"), ("AT&T &unknown; & &; &#xZZ;", "AT&T &unknown; & &; &#xZZ;"),
    ("&#0; &#1114112;", "&#0; &#1114112;"), ("", ""), (None, None), ("plain", "plain"),
])
def test_entities(spark, given, expected):
    df = spark.createDataFrame([(given,)], "t string")
    assert df.select(tx.unescape(F.col("t"))).first()[0] == expected


def test_anchors_in_any_quoting(spark):
    html = """<a href="/a?x=1&amp;y=2">One</a> <A class=k HREF='/b'>Two</A> <a href=/c>Three</a> <a name=x>none</a> <a data-href="no" href = "/d" >F&eacute;</a>"""
    got = pages.page_anchors(spark.createDataFrame([(1, html)], "page_id int, html string"), "https://s").orderBy("pos").collect()
    assert [(r["url"], r["raw_text"]) for r in got] == [("https://s/a?x=1&y=2", "One"), ("https://s/b", "Two"), ("https://s/c", "Three"), ("https://s/d", "Fé")]


def _document(cik, name):
    value = {"start": "2018-12-31", "end": "2019-12-31", "val": 5.0, "form": "10-K", "filed": "2020-02-01"}
    older = {**value, "start": "2017-12-31", "end": "2018-12-31", "filed": "2019-02-01"}
    return {"cik": cik, "entityName": name, "facts": {"us-gaap": {t: {"units": {"USD": [value, older]}} for t in ("Assets", "Revenues", "NetIncomeLoss")}}}


def test_build_counts_what_it_could_not_use_and_runs_twice(spark, tmp_path):
    folder = tmp_path / "facts"
    folder.mkdir()
    (folder / "0000000042.json").write_text(json.dumps(_document(42, "Acme")))
    (folder / "0000000044.json").write_text("{broken")
    (tmp_path / "master.json").write_text(json.dumps({str(i): {"cik_str": c, "ticker": t, "title": t} for i, (c, t) in enumerate([(42, "ACME"), (44, "BAD")])}))
    fraud = spark.createDataFrame([("42",)], "cik string").withColumn("fraud_date", F.to_date(F.lit("2019-12-31")))
    for _ in range(2):
        out = dataset.build(spark, str(folder), str(tmp_path / "master.json"), str(tmp_path / "out"), fraud=fraud, min_years=2)
    assert [r["file"] for r in out["rejects"].collect()] == ["0000000044.json"]
    assert {r["status"]: r["n"] for r in out["fetch_status"].collect()} == {"used": 1, "no_facts": 1}
    listed = dataset.raw_table(dataset.fx.read_facts(spark, str(folder)), masters.read_master(spark, str(tmp_path / "master.json")),
                               spark.createDataFrame([(" acme",)], "ticker string"), 2)
    assert {r["cik"] for r in listed.select("cik").distinct().collect()} == {"0000000042"}


def test_stream_keeps_rejects_and_reads_keys_from_file_names(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    unnamed = _document(7, "Acme")
    del unnamed["cik"]
    (folder / "0000000042.json").write_text(json.dumps(unnamed))
    (folder / "0000000043.json").write_text("{broken")
    store, reports = str(tmp_path / "store"), str(tmp_path / "reports")
    refresh.start(spark, str(folder), store, reports, str(tmp_path / "check"),
                  lambda s: s.createDataFrame([("0000000042", "ACME", "Acme")], "cik string, ticker string, title string"), once=True).awaitTermination()
    assert [r["cik"] for r in refresh.current_reports(spark, reports).collect()] == ["0000000042"]
    assert [r["file"] for r in spark.read.parquet(f"{store}-rejects").collect()] == ["0000000043.json"]


def test_label_joins_keep_the_company_partitioning(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = spark.range(100).select(F.lpad(F.col("id").cast("string"), 10, "0").alias("cik"), (F.lit(2000) + F.col("id") % 5).cast("int").alias("year"))
        by_company = wide.repartition("cik")
        fraud = spark.createDataFrame([("7",)], "cik string").withColumn("fraud_date", F.to_date(F.lit("2003-12-31")))
        plan = lab.attach_bankruptcy(lab.attach_fraud(by_company, fraud), fraud.withColumnRenamed("fraud_date", "bankruptcy_date"))
        text = plan._jdf.queryExecution().executedPlan().toString()
        # the wide side is exchanged once, for the repartition; each label side once
        assert text.count("Exchange hashpartitioning(cik") == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_results_are_written_and_read_back(spark, tmp_path):
    table = spark.createDataFrame([("a", 1.5), ("b", None)], "name string, value double")
    sinks.write_results({"scores": table}, str(tmp_path / "results"))
    back = spark.read.schema(table.schema).json(str(tmp_path / "results" / "scores"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, table.collect()))
    assert json.loads(sinks.as_json(table).first()[0]) == {"name": "a", "value": 1.5}
    parted = sinks.write_table(table, str(tmp_path / "parted"), "name")
    assert {(r["name"], r["value"]) for r in parted.collect()} == {("a", 1.5), ("b", None)}
    assert sinks.write_version(table, str(tmp_path / "v"), "1").count() == sinks.write_version(table, str(tmp_path / "v"), "2").count() == 2


def test_a_writer_that_dies_leaves_the_earlier_version(spark, tmp_path):
    path = str(tmp_path / "table")
    first = spark.range(5).toDF("x")
    sinks.write_table(first, path)
    broken = spark.range(1000, 1100).select(F.when(F.col("id") == 1090, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("x")).repartition(4)
    for write in (sinks.write_table, lambda df, p: sinks.write_labels(df, p + "-csv"), lambda df, p: sinks.write_results({"r": df}, p + "-json")):
        write(first, path)
        with pytest.raises(Exception, match="lost"):
            write(broken, path)
    assert sorted(r["x"] for r in sinks.read_table(spark, path).collect()) == list(range(5))
    assert spark.read.option("header", True).csv(path + "-csv").count() == spark.read.json(path + "-json/r").count() == 5
    # a table may be replaced by rows read from it
    again = sinks.write_table(sinks.read_table(spark, path).filter("x > 2"), path)
    assert sorted(r["x"] for r in again.collect()) == [3, 4] == sorted(r["x"] for r in sinks.read_table(spark, path).collect())
    with pytest.raises(FileNotFoundError):
        sinks.read_table(spark, str(tmp_path / "nothing"))


def test_store_folds_and_reads_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FOLD_AFTER", 3)
    monkeypatch.setattr(store, "PER_BUCKET", 1)
    kept = store.Store(spark, str(tmp_path / "store"), ("cik", "tag"), ("filed",))
    expected, files = {}, []
    for batch in range(11):
        rows = [(f"c{k % 40}", f"t{k % 3}", batch, float(batch * 100 + k)) for k in range(batch, batch + 30)]
        frame = spark.createDataFrame(rows, "cik string, tag string, filed int, val double")
        for _ in range(2 if batch % 4 == 1 else 1):  # some batches are replayed
            touched = kept.append(frame, batch)
        best = {}
        for cik, tag, filed, val in rows:
            best[cik, tag] = max(best.get((cik, tag), (-1, -1.0)), (filed, val))
        expected |= best
        files.append(len(kept.files_of(touched[:1])))
        assert {(r["cik"], r["tag"]): (r["filed"], r["val"]) for r in kept.read().collect()} == expected
        kept.fold()
        assert {(r["cik"], r["tag"]): (r["filed"], r["val"]) for r in kept.read().collect()} == expected
    assert max(files) <= 1 + 3 and kept.state()["buckets"] > store.LEAST_BUCKETS
    kept.append(spark.createDataFrame([("c1", "t1", 0, -1.0)], "cik string, tag string, filed int, val double"), 2)  # long since folded
    assert {(r["cik"], r["tag"]): (r["filed"], r["val"]) for r in kept.read().collect()} == expected


def test_build_takes_the_callers_concepts(spark, tmp_path):
    folder = tmp_path / "facts"
    folder.mkdir()
    (folder / "0000000042.json").write_text(json.dumps(_document(42, "Acme")))
    docs = dataset.fx.read_facts(spark, str(folder), {"size": ["Nothing", "Assets"], "sales": ["Revenues"]})
    got = dataset.long_facts(docs, concepts={"size": ["Nothing", "Assets"], "sales": ["Revenues"]})
    assert {(r["concept"], r["year"], r["value"]) for r in got.collect()} == {(c, y, 5.0) for c in ("size", "sales") for y in (2018, 2019)}


def test_landed_tables_can_be_dropped(spark):
    landed = session.materialize(spark.range(3).toDF("x"), "probe")
    folder = landed.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert landed.count() == 3 and os.path.isdir(folder)
    assert session.drop_landed(spark, "probe") == 1 and not os.path.exists(folder)
