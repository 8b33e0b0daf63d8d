"""Feature table: 53 model inputs per company-year and their winsorisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsieve.functions.numeric import clip, div, growth, previous, ratio, reported_before, rolling_slope
from finsieve.operators.panel import with_columns_or_null
from finsieve.operators.quantiles import exact_quantiles
from finsieve.sources.sample import CONCEPTS

IDS = ("cik", "ticker", "company_name", "year")

RATIO = (
    "f_current_ratio", "f_quick_ratio", "f_cash_ratio", "f_debt_equity", "f_debt_assets",
    "f_interest_coverage", "f_gross_margin", "f_ebit_margin", "f_net_margin", "f_roa", "f_roe",
    "f_asset_turnover", "f_dso", "f_dio", "f_cfo_ni", "f_cfo_revenue", "f_capex_revenue",
    "f_goodwill_assets",
)
YOY = (
    "f_yoy_revenue", "f_yoy_cfo", "f_yoy_receivables", "f_yoy_assets", "f_yoy_net_income",
    "f_yoy_debt", "f_rev_cfo_divergence",
)
TREND = (
    "f_trend_current_ratio", "f_trend_gross_margin", "f_trend_net_margin", "f_trend_cfo_ni",
    "f_trend_debt_equity", "f_trend_roa", "f_trend_dso", "f_trend_cfo_rev",
)
INTERACTION = (
    "f_interact_rev_up_cfo_dn", "f_interact_dso_rev", "f_interact_ni_pos_cfo_neg", "f_interact_lev_cov",
)
ACCRUAL = ("f_sloan_accrual", "f_total_accruals", "f_cash_roa_gap")
BENEISH = ("f_b_dsri", "f_b_gmi", "f_b_aqi", "f_b_sgi", "f_b_depi", "f_b_sgai", "f_b_lvgi", "f_b_tata")
ALTMAN = ("f_z_x1", "f_z_x2", "f_z_x3", "f_z_x4", "f_z_x5")
FEATURES = RATIO + YOY + TREND + INTERACTION + ACCRUAL + BENEISH + ALTMAN
TRAINED = tuple(f for f in FEATURES if f != "f_z_x4")


_YOY_OF = {
    "f_yoy_revenue": "revenue", "f_yoy_cfo": "cfo", "f_yoy_receivables": "receivables",
    "f_yoy_assets": "total_assets", "f_yoy_net_income": "net_income", "f_yoy_debt": "total_liabilities",
}
_TREND_OF = {
    "f_trend_current_ratio": "f_current_ratio", "f_trend_gross_margin": "f_gross_margin",
    "f_trend_net_margin": "f_net_margin", "f_trend_cfo_ni": "f_cfo_ni", "f_trend_debt_equity": "f_debt_equity",
    "f_trend_roa": "f_roa", "f_trend_dso": "f_dso", "f_trend_cfo_rev": "f_cfo_revenue",
}
_PRIOR = ("receivables", "revenue", "gross_profit", "current_assets", "total_assets", "da", "sga", "total_liabilities")


def feature_table(wide: DataFrame, pad: bool = True, inf_mode: str = "null") -> DataFrame:
    """All 53 features, not winsorised. Three layers over one sort by
    (cik, year); interactions read the unclipped values of the same row."""
    base = with_columns_or_null(wide, CONCEPTS).select(
        *IDS, *CONCEPTS,
        ratio("current_assets", "current_liabilities").alias("f_current_ratio"),
        ratio("current_assets - coalesce(inventory, 0)", "current_liabilities").alias("f_quick_ratio"),
        ratio("cash", "current_liabilities").alias("f_cash_ratio"),
        ratio("coalesce(long_term_debt, 0) + coalesce(short_term_debt, 0)", "equity").alias("f_debt_equity"),
        ratio("total_liabilities", "total_assets").alias("f_debt_assets"),
        ratio("operating_income", "abs(interest_expense)").alias("f_interest_coverage"),
        ratio("gross_profit", "revenue").alias("f_gross_margin"),
        ratio("operating_income", "revenue").alias("f_ebit_margin"),
        ratio("net_income", "revenue").alias("f_net_margin"),
        ratio("net_income", "total_assets").alias("f_roa"),
        ratio("net_income", "equity").alias("f_roe"),
        ratio("revenue", "total_assets").alias("f_asset_turnover"),
        ratio("receivables", "revenue", 365).alias("f_dso"),
        ratio("inventory", "cogs", 365).alias("f_dio"),
        ratio("cfo", "net_income").alias("f_cfo_ni"),
        ratio("cfo", "revenue").alias("f_cfo_revenue"),
        ratio("abs(capex)", "revenue").alias("f_capex_revenue"),
        ratio("coalesce(goodwill, 0) + coalesce(intangibles, 0)", "total_assets").alias("f_goodwill_assets"),
    )
    # each window once, under a name of its own
    seen = base.select(
        "*",
        *[F.expr(reported_before(source, pad)).alias(f"r_{source}") for source in _YOY_OF.values()],
        *[F.expr(previous(source, k)).alias(f"p{k}_{source}") for source in _TREND_OF.values() for k in (1, 2)],
        *[F.expr(previous(name)).alias(f"p_{name}") for name in _PRIOR],
    )
    moved = seen.select(
        "*",
        *[growth(source, pad, inf_mode, f"r_{source}").alias(name) for name, source in _YOY_OF.items()],
        *[rolling_slope(source, f"p1_{source}", f"p2_{source}").alias(name) for name, source in _TREND_OF.items()],
    )
    accruals = ratio("net_income - cfo", "total_assets")
    return moved.select(
        *IDS, *RATIO, *_YOY_OF,
        F.expr("coalesce(f_yoy_revenue, 0) - coalesce(f_yoy_cfo, 0)").alias("f_rev_cfo_divergence"),
        *TREND,
        _both("f_yoy_revenue > 0.05D", "f_yoy_cfo < -0.05D").alias("f_interact_rev_up_cfo_dn"),
        _both("f_trend_dso > 0", "f_yoy_revenue > 0.03D").alias("f_interact_dso_rev"),
        _both("net_income > 0", "cfo < 0").alias("f_interact_ni_pos_cfo_neg"),
        _both("f_trend_debt_equity > 0", "f_interest_coverage < 3").alias("f_interact_lev_cov"),
        accruals.alias("f_sloan_accrual"), accruals.alias("f_total_accruals"),
        ratio("cfo - net_income", "total_assets").alias("f_cash_roa_gap"),
        *_manipulation_indices(), accruals.alias("f_b_tata"),
        ratio("current_assets - current_liabilities", "total_assets").alias("f_z_x1"),
        ratio("retained_earnings", "total_assets").alias("f_z_x2"),
        ratio("operating_income", "total_assets").alias("f_z_x3"),
        F.lit(None).cast("double").alias("f_z_x4"),
        ratio("revenue", "total_assets").alias("f_z_x5"),
    )


def _both(first: str, second: str) -> Column:
    """1.0 when both comparisons hold; a missing operand counts as false."""
    return F.expr(f"case when {first} and {second} then 1.0D else 0.0D end")


def _manipulation_indices() -> list[Column]:
    """This year's ratio against the previous row's, per index.

    A zero prior base is an infinite prior ratio, so as a divisor it gives an
    index of 0.
    """
    def over_prior(now: str, before: str, top: str, bottom: str) -> str:
        infinite = f"p_{bottom} = 0 and p_{top} <> 0 and ({now}) is not null"
        return f"case when {infinite} then 0.0D else {div(now, before)} end"

    def change(top: str, bottom: str) -> str:
        return over_prior(div(top, bottom), div(f"p_{top}", f"p_{bottom}"), top, bottom)

    share = "1 - " + div("current_assets", "total_assets")
    prior_share = "(1 - " + div("p_current_assets", "p_total_assets") + ")"
    indices = {
        "f_b_dsri": change("receivables", "revenue"),
        "f_b_gmi": div(div("p_gross_profit", "p_revenue"), div("gross_profit", "revenue")),
        "f_b_aqi": over_prior(share, prior_share, "current_assets", "total_assets"),
        "f_b_sgi": div("revenue", "p_revenue"),
        "f_b_depi": div(div("p_da", "p_da + p_total_assets"), div("da", "da + total_assets")),
        "f_b_sgai": change("sga", "revenue"),
        "f_b_lvgi": change("total_liabilities", "total_assets"),
    }
    return [F.expr(text).alias(name) for name, text in indices.items()]


def winsor_bounds(
    features: DataFrame,
    columns: tuple[str, ...] = FEATURES,
    lower: float = 0.01,
    upper: float = 0.99,
    fit_before_year: int | None = None,
    exclude_binary: bool = False,
) -> dict[str, tuple[float | None, float | None]]:
    """Exact 1st/99th percentile of each column, as numbers.

    ``fit_before_year`` fits on earlier years only; ``exclude_binary`` leaves
    the 0/1 interaction columns alone (rare ones are clipped away otherwise).
    """
    source = features if fit_before_year is None else features.filter(F.col("year") < fit_before_year)
    wanted = [c for c in columns if not (exclude_binary and c in INTERACTION)]
    found = exact_quantiles(source, wanted, [lower, upper])
    return {c: (found[c][0], found[c][1]) for c in wanted}


def winsorise(features: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Clip each listed column to its bounds in one projection."""
    def bounded(name: str) -> Column:
        lo, hi = bounds[name]
        return clip(F.col(name), F.lit(lo).cast("double"), F.lit(hi).cast("double")).alias(name)

    return features.select(*[bounded(n) if n in bounds else F.col(n) for n in features.columns])


def completeness(features: DataFrame) -> DataFrame:
    """Non-missing share of every feature in percent, least complete first."""
    names = [n for n in features.columns if n.startswith("f_")]
    shares = features.agg(*[(F.count(n) * 100.0 / F.count(F.lit(1))).alias(n) for n in names])
    return shares.unpivot([], names, "feature", "pct").orderBy("pct", "feature")
