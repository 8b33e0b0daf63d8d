import pytest
from pyspark.sql import functions as F

from finsieve.operators import flags as flg
from finsieve.operators import panel as pan
from finsieve.operators import scores as sc
from finsieve.plans import report as rpt

from tests.test_panel import LONG, long_rows

FULL = {
    "total_assets": {2019: 100.0, 2020: 120.0}, "current_assets": {2019: 40.0, 2020: 50.0},
    "current_liabilities": {2019: 20.0, 2020: 25.0}, "retained_earnings": {2019: 10.0, 2020: 12.0},
    "operating_income": {2019: 15.0, 2020: 18.0}, "total_liabilities": {2019: 50.0, 2020: 55.0},
    "revenue": {2019: 80.0, 2020: 100.0}, "receivables": {2019: 10.0, 2020: 20.0},
    "gross_profit": {2019: 40.0, 2020: 45.0}, "net_income": {2019: 8.0, 2020: 9.0}, "cfo": {2019: 7.0, 2020: 3.0},
    "da": {2019: 4.0, 2020: 5.0}, "sga": {2019: 12.0, 2020: 14.0},
}


def signals(spark, facts, cap=None):
    rows = [r for c, v in facts.items() for r in long_rows("0000000001", c, v)]
    market = None if cap is None else spark.createDataFrame([("0000000001", cap)], "cik string, market_cap double")
    return sc.company_signals(pan.history(pan.company_year(spark.createDataFrame(rows, LONG))), market)


def test_altman_and_beneish_by_hand(spark):
    row = signals(spark, FULL, 110.0).first()
    z = 1.2 * 25 / 120 + 1.4 * 12 / 120 + 3.3 * 18 / 120 + 0.6 * 110 / 55 + 100 / 120
    assert row["altman_z"] == pytest.approx(z)
    dsri = (20 / 100) / (10 / 80)
    gmi = (40 / 80) / (45 / 100)
    aqi = (70 / 120) / (60 / 100)
    sgi = 100 / 80
    depi = (4 / 104) / (5 / 125)
    sgai = (14 / 100) / (12 / 80)
    lvgi = (55 / 120) / (50 / 100)
    tata = 6 / 120
    m = -4.84 + 0.920 * dsri + 0.528 * gmi + 0.404 * aqi + 0.892 * sgi + 0.115 * depi - 0.172 * sgai + 4.679 * tata - 0.327 * lvgi
    assert row["beneish_m"] == pytest.approx(m)


def test_missing_inputs(spark):
    no_assets = {k: v for k, v in FULL.items() if k != "total_assets"}
    row = signals(spark, no_assets).first()
    assert row["altman_z"] is None and row["beneish_m"] is None
    thin = {**FULL, "receivables": {2020: 20.0}}
    assert signals(spark, thin).first()["beneish_m"] is None
    no_sga_now = {**FULL, "sga": {2019: 12.0}}
    default = signals(spark, no_sga_now).first()["beneish_m"]
    without = signals(spark, {k: v for k, v in FULL.items() if k != "sga"}).first()["beneish_m"]
    assert default == pytest.approx(without)


def signal_row(spark, **values):
    names = [f"last_{n}" for n in dict.fromkeys(pan.RATIOS + pan.GROWTH)] + ["altman_z", "beneish_m"]
    columns = [F.lit("1").alias("cik")]
    columns += [F.lit(values.get(n)).cast("double").alias(n) for n in names]
    columns += [F.array(*[F.lit(float(v)) for v in values.get(f"last3_{n}", [])]).cast("array<double>").alias(f"last3_{n}") for n in sc.TRENDS]
    return spark.range(1).select(*columns)


EDGES = [
    (1, "last_current_ratio", 0.99, 1.0), (2, "last_current_ratio", 1.49, 1.5), (4, "last_quick_ratio", 0.69, 0.7),
    (5, "last_debt_equity", 3.01, 3.0), (6, "last_debt_equity", 3.0, 2.0), (8, "last_debt_assets", 0.71, 0.7),
    (9, "last_interest_coverage", 1.49, 1.5), (10, "last_interest_coverage", 2.99, 3.0), (12, "last_net_margin", -0.01, 0.0),
    (13, "last_roe", -0.01, 0.0), (14, "last_roa", 0.019, 0.02), (15, "last_cfo_ni_ratio", 0.49, 0.5),
    (16, "last_cfo_ni_ratio", 0.79, 0.8), (21, "altman_z", 1.80, 1.81), (22, "altman_z", 2.98, 2.99), (23, "beneish_m", -2.21, -2.22),
]


@pytest.mark.parametrize("no, signal, fires, stays", EDGES)
def test_rule_thresholds(spark, no, signal, fires, stays):
    assert no in [r["rule_no"] for r in flg.detect_flags(signal_row(spark, **{signal: fires})).collect()]
    assert no not in [r["rule_no"] for r in flg.detect_flags(signal_row(spark, **{signal: stays})).collect()]


@pytest.mark.parametrize("no, values, fires", [
    (3, {"last3_current_ratio": [2.0, 1.8, 1.6]}, True), (3, {"last3_current_ratio": [2.0]}, False),
    (7, {"last3_debt_equity": [1.0, 1.1, 1.2]}, True), (11, {"last3_gross_margin": [0.5, 0.4]}, True),
    (17, {"last_revenue_growth": 0.06, "last_cfo_growth": -0.06}, True),
    (18, {"last_revenue_growth": 0.06, "last_cfo_growth": -0.06}, False),
    (18, {"last_revenue_growth": 0.2, "last_cfo_growth": 0.04}, True),
    (19, {"last3_cfo_revenue": [0.3, 0.2]}, True), (20, {"last3_dso": [50.0, 60.0], "last_dso": 60.0}, True),
    (20, {"last3_dso": [40.0, 48.0], "last_dso": 48.0}, False),
])
def test_trend_and_pair_rules(spark, no, values, fires):
    assert (no in [r["rule_no"] for r in flg.detect_flags(signal_row(spark, **values)).collect()]) is fires


def test_missing_signals_fire_nothing(spark):
    assert flg.detect_flags(signal_row(spark)).count() == 0


def scores_of(spark, **values):
    return sc.company_scores(signal_row(spark, **values)).first()


def test_scores_neutral_and_clamped(spark):
    row = scores_of(spark)
    assert [row[n] for n in sc.WEIGHTS] == [50.0, 50.0, 40.0, 50.0, 50.0, 60.0]
    assert scores_of(spark, last_current_ratio=9.0)["liquidity"] == 100.0
    assert scores_of(spark, last_current_ratio=0.5)["liquidity"] == 0.0
    assert scores_of(spark, last_debt_equity=-1.0)["solvency"] == 100.0
    assert scores_of(spark, altman_z=3.0)["altman_score"] == 80.0
    assert scores_of(spark, altman_z=1.81)["altman_score"] == 50.0
    assert scores_of(spark, altman_z=-1.0)["altman_score"] == 0.0
    assert scores_of(spark, beneish_m=-2.22)["beneish_score"] == 55.0
    assert scores_of(spark, beneish_m=-4.0)["beneish_score"] == 100.0
    assert scores_of(spark, last_revenue_growth=0.3, last_cfo_growth=0.05)["cash_quality"] == 37.5


@pytest.mark.parametrize("value, label", [(75.0, "Healthy"), (74.9, "Caution"), (55.0, "Caution"), (54.9, "At Risk"), (35.0, "At Risk"), (34.9, "Critical")])
def test_labels(spark, value, label):
    assert spark.range(1).select(sc.score_label(F.lit(value))).first()[0] == label


def test_trend_penalty_only_for_worsening(spark):
    falling = {"last_current_ratio": 1.5, "last3_current_ratio": [2.0, 1.8, 1.5]}
    base = scores_of(spark, **falling)["liquidity"]
    row = sc.company_scores(signal_row(spark, **falling), "polarity").first()
    assert row["liquidity"] == pytest.approx(base * 0.85, abs=0.1)
    better = {"last_debt_equity": 1.0, "last3_debt_equity": [3.0, 2.0, 1.0]}
    assert sc.company_scores(signal_row(spark, **better), "polarity").first()["solvency"] == scores_of(spark, **better)["solvency"]


def test_report_tables(spark):
    rows = [r for c, v in FULL.items() for r in long_rows("0000000001", c, v)]
    tables = rpt.company_report(pan.company_year(spark.createDataFrame(rows, LONG)))
    head = tables["header"].first()
    assert head["current_ratio"] == "2.00x" and head["current_ratio_change"] == "▼ 0.0% YoY" and head["market_cap"] == "N/A"
    assert {r["series"]: r["value"] for r in tables["series"].filter("year = 2020").collect()}["revenue"] == 1.25
    assert tables["cash"].count() == 3 and tables["score_parts"].count() == 6
    assert tables["display"].filter("year = 2019").first()["revenue_growth"] == "—"
