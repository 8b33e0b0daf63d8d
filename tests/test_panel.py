import math

import pytest
from pyspark.sql import functions as F

from finsieve.functions import numeric as num
from finsieve.operators import features as fea
from finsieve.operators import panel as pan
from finsieve.operators.quantiles import exact_quantiles

LONG = "cik string, ticker string, company_name string, year int, concept string, value double"


def long_rows(cik, concept, values):
    return [(cik, f"T{cik}", f"Co {cik}", y, concept, v) for y, v in values.items()]


def test_pivot_has_fixed_columns_and_takes_first_ticker(spark):
    rows = [("1", "B", "Beta", 2020, "cash", 2.0), ("1", "A", "Alpha", 2020, "cash", 1.0), ("1", "B", "Beta", 2020, "revenue", 9.0)]
    row = pan.company_year(spark.createDataFrame(rows, LONG)).first()
    assert (row["ticker"], row["company_name"], row["cash"], row["revenue"], row["goodwill"]) == ("A", "Alpha", 1.0, 9.0, None)


def test_pivot_of_unpivot_is_identity(spark):
    rows = long_rows("1", "cash", {2019: 1.0, 2020: 2.5}) + long_rows("2", "revenue", {2020: 7.0})
    df = spark.createDataFrame(rows, LONG)
    wide = pan.company_year(df)
    back = pan.to_long(wide, ["cik", "ticker", "company_name", "year"], list(pan.CONCEPTS))
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_growth_pads_gaps_and_skips_missing_years(spark):
    df = spark.createDataFrame([("1", 2015, 100.0), ("1", 2016, None), ("1", 2019, 150.0), ("1", 2020, 0.0), ("1", 2021, 5.0)], "cik string, year int, v double")
    got = [r["g"] for r in df.select("year", num.growth("v").alias("g")).orderBy("year").collect()]
    assert got == [None, 0.0, 0.5, -1.0, None]
    ieee = [r["g"] for r in df.select("year", num.growth("v", inf_mode="ieee").alias("g")).orderBy("year").collect()]
    assert ieee[-1] == math.inf
    bare = [r["g"] for r in df.select("year", num.growth("v", pad=False).alias("g")).orderBy("year").collect()]
    assert bare == [None, None, None, -1.0, None]


@pytest.mark.parametrize("values, expected", [
    ([1.0], None), ([1.0, 3.0], 2.0 / 2.0), ([1.0, None, 3.0], 2.0 / 2.0), ([2.0, 4.0, 8.0], 3.0 / (14 / 3)), ([0.0, 0.0, 0.0], 0.0),
    ([None, None, 4.0], None),
])
def test_rolling_slope(spark, values, expected):
    df = spark.createDataFrame([("1", i, v) for i, v in enumerate(values)], "cik string, year int, v double")
    got = df.select("year", num.rolling_slope("v").alias("s")).orderBy("year").collect()[-1]["s"]
    assert got == (expected if expected is None else pytest.approx(expected))


def wide(spark, rows):
    return pan.company_year(spark.createDataFrame(rows, LONG))


def test_quick_ratio_without_any_inventory_subtracts_cash(spark):
    rows = long_rows("1", "current_assets", {2020: 10.0}) + long_rows("1", "current_liabilities", {2020: 4.0}) + long_rows("1", "cash", {2020: 2.0})
    assert pan.ratio_panel(wide(spark, rows)).first()["quick_ratio"] == 2.0
    rows += long_rows("1", "inventory", {2019: 1.0})
    assert pan.ratio_panel(wide(spark, rows)).filter("year = 2020").first()["quick_ratio"] is None


def test_debt_needs_short_term_debt_only_if_ever_reported(spark):
    rows = long_rows("1", "long_term_debt", {2019: 6.0, 2020: 8.0}) + long_rows("1", "equity", {2019: 2.0, 2020: 4.0})
    assert [r["debt_equity"] for r in pan.ratio_panel(wide(spark, rows)).orderBy("year").collect()] == [3.0, 2.0]
    rows += long_rows("1", "short_term_debt", {2020: 4.0})
    # 2019 then lacks an operand; with no other metric the year drops
    assert [(r["year"], r["debt_equity"], r["total_debt"]) for r in pan.ratio_panel(wide(spark, rows)).collect()] == [(2020, 3.0, 12.0)]


def test_zero_divisor_and_margin_change(spark):
    rows = long_rows("1", "revenue", {2018: 10.0, 2019: 0.0, 2020: 20.0}) + long_rows("1", "gross_profit", {2018: 5.0, 2019: 1.0, 2020: 4.0})
    got = pan.ratio_panel(wide(spark, rows)).orderBy("year").collect()
    assert [r["gross_margin"] for r in got] == [0.5, None, 0.2]
    assert [r["gm_delta"] for r in got] == [None, None, None]
    assert [r["revenue_growth"] for r in got] == [None, -1.0, None]


def test_features_of_empty_facts_and_prior_zero_revenue(spark):
    rows = long_rows("1", "receivables", {2019: 5.0, 2020: 5.0}) + long_rows("1", "revenue", {2019: 0.0, 2020: 10.0}) + long_rows("1", "equity", {2020: 2.0})
    got = fea.feature_table(wide(spark, rows)).orderBy("year").collect()
    assert got[1]["f_b_dsri"] == 0.0 and got[0]["f_b_dsri"] is None
    assert got[1]["f_debt_equity"] == 0.0
    assert got[1]["f_z_x4"] is None
    assert len(fea.FEATURES) == 53 and len(fea.TRAINED) == 52


@pytest.mark.parametrize("probs", [[0.01, 0.99], [0.0, 0.5, 1.0]])
def test_exact_quantiles_match_brute_force(spark, probs):
    import numpy as np

    rng = np.random.default_rng(1)
    tied = np.where(rng.random(5000) < 0.4, 7.0, rng.normal(size=5000))
    smooth = rng.normal(size=5000) * 1e6
    df = spark.createDataFrame([(float(a), float(b), None) for a, b in zip(tied, smooth)], "a double, b double, c double")
    got = exact_quantiles(df, ["a", "b", "c"], probs)
    assert got["a"] == pytest.approx(list(np.quantile(tied, probs)))
    assert got["b"] == pytest.approx(list(np.quantile(smooth, probs)))
    assert got["c"] == [None] * len(probs)


def test_quantiles_of_few_bits_a_pass_and_infinities(spark, monkeypatch):
    import numpy as np

    from finsieve.operators import quantiles

    monkeypatch.setattr(quantiles, "FEW_ROWS", 0)  # every pass takes its few bits
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=300), rng.normal(size=300) * 1e-300, [0.0, -0.0] * 40, [np.inf] * 90, [-np.inf] * 30, [5e-324, -5e-324]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 9, "a double").repartition(5)
    probs = [0.0, 0.03, 0.31, 0.5, 0.77, 0.95, 1.0]
    ordered = np.sort(values)
    expected = []
    for p in probs:
        at = (len(values) - 1) * p
        low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
        expected.append(low if low == high else low + (high - low) * (at - np.floor(at)))
    assert exact_quantiles(df, ["a"], probs)["a"] == expected


def test_winsor_keeps_nulls_and_is_idempotent(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(200)] + [(999, None)], "id int, f_roa double")
    bounds = fea.winsor_bounds(df, ("f_roa",))
    once = fea.winsorise(df, bounds)
    assert once.filter("f_roa is null").count() == 1
    lo, hi = bounds["f_roa"]
    assert once.agg(F.min("f_roa"), F.max("f_roa")).first() == (lo, hi)
    assert sorted(fea.winsorise(once, bounds).collect(), key=str) == sorted(once.collect(), key=str)


def test_plans_use_one_exchange_by_company(spark):
    rows = long_rows("1", "revenue", {2019: 1.0, 2020: 2.0})
    plan = fea.feature_table(wide(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(cik") == 2  # pivot by (cik, year, ..), then cik once
    assert "Python" not in plan and "BroadcastNestedLoop" not in plan
