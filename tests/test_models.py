import numpy as np
import pytest
from pyspark.sql import functions as F

from finsieve import session
from finsieve.operators import attribution, isolation, models, smote
from finsieve.plans import evaluation as ev
from finsieve.registry import queries

FEATURES = ("f_roa", "f_dso", "f_z_x1")


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(400):
        for year in range(2000, 2006):
            x = rng.normal(size=3)
            risky = int(x[0] - x[1] + 0.3 * rng.normal() > 2.0)
            rows.append((f"{i:010d}", year, float(x[0]), float(x[1]), None if rng.random() < 0.1 else float(x[2]), risky, int(rng.random() < 0.05)))
    df = spark.createDataFrame(rows, "cik string, year int, f_roa double, f_dso double, f_z_x1 double, is_fraud int, is_bankrupt int")
    return df.cache()


def small(**changes):
    return models.fraud_model(**{**dict(trees=8, learning_rate=0.3, forest_trees=20, features=FEATURES), **changes})


@pytest.fixture(scope="module")
def fitted(labelled):
    return small().fit(labelled.filter("year < 2004"))


def test_scores_separate_and_blend(labelled, fitted):
    out = fitted.predict(labelled.filter("year >= 2004")).cache()
    means = {r["is_fraud"]: r["m"] for r in out.groupBy("is_fraud").agg(F.avg("score").alias("m")).collect()}
    assert means[1] > means[0] + 0.2
    row = out.first()
    assert row["score"] == pytest.approx(0.65 * row["xgb_prob"] + 0.35 * row["iso_score"])
    assert len(row["top3"]) == 3 and row["top3"][0]["direction"] in ("increases_risk", "decreases_risk")


def test_attributions_sum_to_log_odds(labelled, fitted):
    sample = labelled.limit(50)
    out = fitted.predict(sample, fill="zero").select("xgb_prob").collect()
    phi = fitted.attributions(sample).collect()
    margins = [np.log(r["xgb_prob"] / (1 - r["xgb_prob"])) - sum(p["phi"]) for r, p in zip(out, phi)]
    assert np.std(margins) == pytest.approx(0, abs=1e-6)


def test_shapley_of_one_split():
    leaves = [(1.0, [(0, -np.inf, 0.0, 0.25)]), (5.0, [(0, 0.0, np.inf, 0.75)])]
    phi = attribution.shapley(leaves, np.array([[-1.0, 9.0], [1.0, 9.0]]))
    assert phi == pytest.approx(np.array([[1 - 4, 0.0], [5 - 4, 0.0]]))


def test_importance_and_record(spark, labelled, fitted):
    top = fitted.importance(labelled, 2).collect()
    assert [r["rank"] for r in top] == [1, 2] and {r["feature"] for r in top} == {"f_roa", "f_dso"}
    record = fitted.predict_record(spark, {"f_roa": 3.0, "f_dso": -3.0})
    assert record["score"] > 0.5 and record["top3"][0]["feature_key"] in FEATURES


def test_save_and_load(spark, labelled, fitted, tmp_path):
    fitted.save(str(tmp_path / "model"))
    again = models.FittedRiskModel.load(spark, str(tmp_path / "model"))
    sample = labelled.limit(20)
    a = [r["score"] for r in fitted.predict(sample, explain=False).collect()]
    assert a == pytest.approx([r["score"] for r in again.predict(sample, explain=False).collect()])


def test_smote_is_exact_and_repeatable(spark, monkeypatch):
    monkeypatch.setattr(smote, "BLOCK", 9)  # several blocks
    rng = np.random.default_rng(2)
    points = rng.normal(size=(30, 2))
    rows = [(f"{i:010d}", 2000, 1, [float(v) for v in p]) for i, p in enumerate(points)]
    minority = spark.createDataFrame(rows, "cik string, year int, y int, features array<double>")
    near = smote.neighbours(minority, 5, 30, 42).collect()
    for i in range(30):
        dist = ((points - points[i]) ** 2).sum(axis=1)
        dist[i] = np.inf
        expected = [f"{j:010d}" for j in np.argsort(dist)[:5]]
        assert [r["nb_cik"] for r in sorted((r for r in near if r["cik"] == f"{i:010d}"), key=lambda r: r["nb"])] == expected
    made = smote.synthetic_rows(minority, 101, 30).orderBy("cik", "copy").collect()
    assert len(made) == 101
    assert made == smote.synthetic_rows(minority.repartition(3), 101, 30).orderBy("cik", "copy").collect()


def test_neighbours_are_searched_near_by(spark, monkeypatch):
    """Exact on clusters with ties and many equal rows, at a small part of all pairs."""
    monkeypatch.setattr(smote, "BLOCK", 50)
    monkeypatch.setattr(smote, "PER_PIVOT", 20)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 6)) * 40
    points = np.concatenate([np.round(centres[k % 20] + rng.normal(size=6), 1) for k in range(900)]).reshape(900, 6)
    points = np.concatenate([points, np.repeat(points[:1], 300, axis=0)])
    rows = [(f"{(i * 7919) % 1200:010d}", 2000, 1, [float(v) for v in p]) for i, p in enumerate(points)]
    minority = spark.createDataFrame(rows, "cik string, year int, y int, features array<double>").repartition(5)
    got = {}
    for r in smote.neighbours(minority, 5, 1200, 42).collect():
        got.setdefault(r["cik"], []).append((r["nb"], r["nb_cik"]))
    for i in range(0, 1200, 7):
        dist = np.zeros(1200)
        for f in range(6):
            dist += (points[i, f] - points[:, f]) ** 2
        best = sorted((dist[j], rows[j][0]) for j in range(1200) if j != i)[:5]
        assert [c for _, c in sorted(got[rows[i][0]])] == [c for _, c in best]
    _, visits = smote.searched(minority, 5, 1200, 42)
    assert visits.count() < 4 * 1200  # of some sixty parts of blocks each


def test_smote_leaves_balanced_and_tiny_classes_alone(spark):
    few = spark.createDataFrame([(str(i), 2000, int(i < 5), [0.0]) for i in range(50)], "cik string, year int, y int, features array<double>")
    assert smote.oversample(few).count() == 50
    even = spark.createDataFrame([(str(i), 2000, i % 2, [0.0]) for i in range(50)], "cik string, year int, y int, features array<double>")
    assert smote.oversample(even).count() == 50
    rare = spark.createDataFrame([(str(i), 2000, int(i < 6), [float(i)]) for i in range(50)], "cik string, year int, y int, features array<double>")
    assert smote.oversample(rare).groupBy("y").count().filter("count = 44").count() == 2


def test_isolation_forest_finds_the_outlier(spark):
    rng = np.random.default_rng(4)
    rows = [(f"{i:010d}", 2000, [float(v) for v in rng.normal(size=2)]) for i in range(600)] + [("outlier", 2000, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "cik string, year int, features array<double>")
    sizes = {r["count"] for r in isolation.draw_samples(df, 601, 10).groupBy("tree").count().collect()}
    assert sizes == {256}
    arrays = isolation.forest_arrays(isolation.grow_forest(df, 601, 50))
    top = df.select("cik", isolation.anomaly(arrays, 601, F.col("features")).alias("a")).orderBy(F.desc("a")).first()
    assert top["cik"] == "outlier" and top["a"] > 0.6
    assert isolation.mean_path(1) == 0.0 and isolation.mean_path(2) == 1.0


def test_walk_forward_and_evaluation(spark, labelled):
    labels = labelled.withColumn("f_b_sgi", F.col("f_roa") + 1)
    out = ev.walk_forward(small(trees=3), labels, 2, 2, 2)
    folds = out["folds"].orderBy("fold").collect()
    assert [(f["train_years"], f["val_years"]) for f in folds] == [("2000–2001", "2002–2003"), ("2000–2003", "2004–2005")]
    assert all(f["auc_roc_xgb"] > 0.7 for f in folds) and out["oof"].count() == 1600
    assert ev.fold_statistics(out["folds"]).first()["auc_roc_std"] is not None
    assert ev.walk_forward(small(), labels, 9)["folds"] is None
    results = ev.run_evaluation(labels, {"fraud": small(trees=3)}, 2004, min_train_years=2, test_window=2, step=2)
    models_seen = {r["model"] for r in results["fraud_benchmark"].collect()}
    assert models_seen == {"Altman Z-Score", "Beneish M-Score", "Our Model"}
    assert results["summary"].count() == 3 and results["fraud_lift"].count() == 300


@pytest.mark.parametrize(("prefix", "model"), [("", models.fraud_model()), ("distress_", models.distress_model())])
def test_queries_fit_the_models_own_settings(monkeypatch, prefix, model):
    class Fitted(Exception):
        pass

    def fit(self, *_):
        raise Fitted(self)

    monkeypatch.setattr(queries, "_labelled", lambda *_: None)
    monkeypatch.setattr(queries, "materialize", lambda df, _: df)
    monkeypatch.setattr(queries.lab, "holdout_split", lambda *_: (None, None))
    monkeypatch.setattr(models.RiskModel, "fit", fit)
    monkeypatch.setattr(ev, "walk_forward", fit)
    for name in ("gbt_scores", "attribution_top3", "feature_importance", "oof_metrics"):
        with pytest.raises(Fitted) as seen:
            getattr(queries, prefix + name)(None, "")
        assert seen.value.args == (model,)
    assert (model.trees, model.learning_rate) == ((400, 0.05) if prefix else (500, 0.04))


def test_model_scores_work_the_labelled_table_out_once(spark, monkeypatch):
    calls = []
    labelled = queries._labelled
    monkeypatch.setattr(queries, "_labelled", lambda *given: calls.append(1) or labelled(*given))
    monkeypatch.setattr(queries, "_one_tree", lambda rows: [])
    monkeypatch.setattr(models.FittedRiskModel, "save", lambda self, path: None)
    monkeypatch.setattr(models.FittedRiskModel, "load", staticmethod(lambda session, path: Unscored()))
    assert queries.model_scores(spark, "/root/testdata/sf0.001").columns == ["cik", "year", "score", "xgb_prob", "iso_score"]
    assert len(calls) == 1


class Unscored:
    def predict(self, table, explain):
        return table.select("*", *[F.lit(0.0).alias(c) for c in ("score", "xgb_prob", "iso_score")])


def test_a_fit_leaves_its_forest_only(spark, labelled):
    before = set(session._landed)
    fitted = small().fit(labelled.filter("year < 2004"))
    left = [path for path in session._landed if path not in before]
    assert left == [fitted.forest._landed_at]


def test_features_move_with_pairs_not_with_new_rows(spark):
    rows = [(f"{i:04d}", 2000, 1, [float(i % 7), float(i), float(i * i % 11)]) for i in range(30)]
    minority = spark.createDataFrame(rows, "cik string, year int, y int, features array<double>")
    plan = smote.synthetic_rows(minority, 3000, 30)._jdf.queryExecution().optimizedPlan().toString()
    # both joins that bring features lie under the generator of new rows
    assert plan.index("Generate inline") < min(plan.index("AS x#"), plan.index("AS z#"))
