"""Classic bankruptcy and manipulation scores and the composite health score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsieve.functions.numeric import array_slope, div, logistic, safe_div
from finsieve.operators.panel import GROWTH, RATIOS, col_or_null, latest, reported, tail

DISTRESS, SAFE = 1.81, 2.99
MANIPULATOR = -2.22

_ALTMAN_INPUTS = (
    "total_assets", "current_assets", "current_liabilities", "retained_earnings",
    "operating_income", "total_liabilities", "revenue",
)
_BENEISH_INPUTS = (
    "revenue", "receivables", "gross_profit", "total_assets", "current_assets", "da", "sga",
    "total_liabilities", "net_income", "cfo",
)


def z_value(x1: Column, x2: Column, x3: Column, x4: Column, x5: Column) -> Column:
    return 1.2 * x1 + 1.4 * x2 + 3.3 * x3 + 0.6 * x4 + 1.0 * x5


def m_value(dsri, gmi, aqi, sgi, depi, sgai, lvgi, tata) -> Column:
    return (
        F.lit(-4.84) + 0.920 * dsri + 0.528 * gmi + 0.404 * aqi + 0.892 * sgi
        + 0.115 * depi - 0.172 * sgai + 4.679 * tata - 0.327 * lvgi
    )


# one row per feature row ---------------------------------------------------------------

def altman_z_rows(features: DataFrame) -> Column:
    """Z per feature row; a missing market-cap term counts as 1."""
    x4 = F.coalesce(col_or_null(features, "f_z_x4"), F.lit(1.0))
    x1, x2, x3, x5 = (col_or_null(features, f"f_z_x{i}") for i in (1, 2, 3, 5))
    return z_value(x1, x2, x3, x4, x5)


def altman_risk(features: DataFrame) -> Column:
    return logistic(DISTRESS - altman_z_rows(features))


def beneish_m_rows(features: DataFrame) -> Column:
    """M per feature row; missing indices count as 1, missing accruals as 0."""
    parts = [
        F.coalesce(col_or_null(features, f"f_b_{name}"), F.lit(0.0 if name == "tata" else 1.0))
        for name in ("dsri", "gmi", "aqi", "sgi", "depi", "sgai", "lvgi", "tata")
    ]
    return m_value(*parts)


def beneish_risk(features: DataFrame) -> Column:
    return logistic(1.5 * (beneish_m_rows(features) - MANIPULATOR))


def altman_zone(z: Column) -> Column:
    return (
        F.when(z < DISTRESS, "Distress Zone").when(z < SAFE, "Grey Zone")
        .when(z.isNotNull(), "Safe Zone")
    )


def beneish_class(m: Column) -> Column:
    return F.when(m > MANIPULATOR, "Likely Manipulator").when(m.isNotNull(), "Non-Manipulator")


# one row per company -------------------------------------------------------------------

TRENDS = ("current_ratio", "debt_equity", "gross_margin", "cfo_revenue", "dso")


def company_signals(histories: DataFrame, market_cap: DataFrame | None = None) -> DataFrame:
    """What scores, flags and reports read, per company.

    Adds ``last_<metric>``, ``last3_<metric>``, ``altman_z`` and ``beneish_m``.
    Array work is done once per metric in the first projection; the rest is
    plain arithmetic over its columns.
    """
    df = histories
    if market_cap is not None:
        df = df.join(market_cap.select("cik", F.col("market_cap").cast("double").alias("market_cap")), "cik", "left")
    else:
        df = df.select("*", F.lit(None).cast("double").alias("market_cap"))
    names = dict.fromkeys(_ALTMAN_INPUTS + RATIOS + GROWTH + ("capex",))
    picked = df.selectExpr(
        *df.columns,
        *[f"{latest(n)} as last_{n}" for n in names],
        *[f"{tail(reported(n), 3)} as last3_{n}" for n in TRENDS],
        f"{tail(COMPLETE_YEARS, 2)} as pair",
        f"size({reported('net_income')}) >= 2 and size({reported('cfo')}) >= 2 as two_years",
    )
    split = picked.selectExpr(
        "*", *[f"get(pair, {i}).{n} as {y}_{n}" for i, y in enumerate("pt") for n in _BENEISH_INPUTS]
    )
    indexed = split.select("*", *beneish_indices(), altman_of().alias("altman_z"))
    m = m_value(*[F.col(i) for i in ("dsri", "gmi", "aqi", "sgi", "depi", "sgai", "lvgi", "tata")])
    return indexed.select(
        *df.columns, *[f"last_{n}" for n in names], *[f"last3_{n}" for n in TRENDS],
        "altman_z", F.when(F.size("pair") == 2, m).alias("beneish_m"),
    )


def altman_of() -> Column:
    """Z from the latest reported value of each series; years may differ.

    A missing or zero market cap counts as 1.
    """
    ta, ca, cl, re, ebit, liab, rev = (F.col(f"last_{name}") for name in _ALTMAN_INPUTS)
    cap = F.coalesce(F.nullif(F.col("market_cap"), F.lit(0.0)), F.lit(1.0))
    return z_value(
        safe_div(ca - cl, ta), safe_div(re, ta), safe_div(ebit, ta), safe_div(cap, liab), safe_div(rev, ta)
    )


# years with revenue, receivables, gross profit and assets
COMPLETE_YEARS = (
    "filter(h, y -> y.revenue is not null and y.receivables is not null "
    "and y.gross_profit is not null and y.total_assets is not null)"
)


def beneish_indices() -> list[Column]:
    """Eight indices of this (``t_``) against the prior (``p_``) complete year.

    Missing receivables, margin or sales indices block the score. The others
    default to 1 and accruals to 0; accruals also need two reported years of
    income and of cash flow.
    """
    def change(top: str, bottom: str) -> str:
        return div(div(f"t_{top}", f"t_{bottom}"), div(f"p_{top}", f"p_{bottom}"))

    def noncurrent(year: str) -> str:
        return div(f"{year}_total_assets - {year}_current_assets", f"{year}_total_assets")

    def wear(year: str) -> str:
        da, assets = f"nullif({year}_da, 0)", f"nullif({year}_total_assets, 0)"
        return f"nullif({div(da, f'{da} + {assets}')}, 0)"

    indices = {
        "dsri": change("receivables", "revenue"),
        "gmi": div(div("p_gross_profit", "p_revenue"), div("t_gross_profit", "t_revenue")),
        "aqi": f"coalesce({div(noncurrent('t'), noncurrent('p'))}, 1)",
        "sgi": div("t_revenue", "p_revenue"),
        "depi": f"coalesce({div(wear('p'), wear('t'))}, 1)",
        "sgai": f"coalesce({change('sga', 'revenue')}, 1)",
        "lvgi": f"coalesce({change('total_liabilities', 'total_assets')}, 1)",
        "tata": f"coalesce(case when two_years then {div('t_net_income - t_cfo', 't_total_assets')} end, 0)",
    }
    return [F.expr(text).alias(name) for name, text in indices.items()]


WEIGHTS = {
    "liquidity": 0.15, "solvency": 0.20, "profitability": 0.15,
    "cash_quality": 0.25, "altman_score": 0.15, "beneish_score": 0.10,
}


def company_scores(signals: DataFrame, trend_penalty: str = "off", weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Adds six 0-100 category scores, the weighted overall score and its label."""
    raw = signals.select("*", *[c.alias(f"_{n}") for n, c in category_scores(trend_penalty).items()])
    overall = sum((F.col(f"_{n}") * w for n, w in weights.items()), F.lit(0.0))
    rounded = raw.select(
        *signals.columns, *[F.round(F.col(f"_{n}"), 1).alias(n) for n in weights], F.round(overall, 1).alias("overall")
    )
    return rounded.select(
        "*", score_label(F.col("overall")).alias("label"), score_color(F.col("overall")).alias("color")
    )


def category_scores(trend_penalty: str = "off") -> dict[str, Column]:
    """Six 0-100 scores over the latest metrics.

    Each starts at a neutral value; a reported metric replaces or blends in.
    ``trend_penalty='polarity'`` also discounts a worsening three-year trend.
    """
    def c(name: str) -> Column:
        return F.col(f"last_{name}")

    def limit(x: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
        return F.greatest(F.lit(lo), F.least(x, F.lit(hi)))

    def start(neutral: float, metric: Column, score: Column) -> Column:
        return F.when(metric.isNotNull(), limit(score)).otherwise(F.lit(neutral))

    def blend(score: Column, keep: float, metric: Column, other: Column) -> Column:
        known = metric.isNotNull()
        share = round(1 - keep, 2)
        return F.when(known, keep).otherwise(1.0) * score + F.when(known, share * limit(other)).otherwise(0.0)

    def penalise(score: Column, factor: float, metric: str, worse: str) -> Column:
        if trend_penalty != "polarity":
            return score
        slope = array_slope(F.col(f"last3_{metric}"))
        bad = slope < 0 if worse == "falling" else slope > 0
        return score * F.when(bad, factor).otherwise(1.0)

    liquidity = start(50.0, c("current_ratio"), (c("current_ratio") - 0.5) / 1.5 * 100)
    liquidity = blend(liquidity, 0.6, c("quick_ratio"), (c("quick_ratio") - 0.3) / 1.0 * 100)
    liquidity = penalise(liquidity, 0.85, "current_ratio", "falling")

    solvency = start(50.0, c("debt_equity"), (4.0 - c("debt_equity")) / 4.0 * 100)
    solvency = blend(solvency, 0.55, c("interest_coverage"), (c("interest_coverage") - 1.0) / 7.0 * 100)
    solvency = blend(solvency, 0.7, c("debt_assets"), (0.7 - c("debt_assets")) / 0.7 * 100)
    solvency = penalise(solvency, 0.88, "debt_equity", "rising")

    profit = start(40.0, c("net_margin"), c("net_margin") * 300 + 40)
    profit = blend(profit, 0.5, c("gross_margin"), c("gross_margin") * 200)
    profit = blend(profit, 0.6, c("roe"), c("roe") * 250 + 40)
    profit = penalise(profit, 0.90, "gross_margin", "falling")

    cash = start(50.0, c("cfo_ni_ratio"), c("cfo_ni_ratio") / 1.2 * 80 + 10)
    cash = blend(cash, 0.55, c("cfo_revenue"), c("cfo_revenue") * 300 + 30)
    gap = c("revenue_growth") - c("cfo_growth")
    cash = cash * F.when(gap > 0.20, 0.75).when(gap > 0.10, 0.90).otherwise(1.0)
    cash = penalise(cash, 0.92, "dso", "rising")

    z, m = F.col("altman_z"), F.col("beneish_m")
    altman = (
        F.when(z.isNull(), 50.0)
        .when(z >= 3.0, limit(80 + (z - 3.0) * 10))
        .when(z >= DISTRESS, limit(50 + (z - DISTRESS) / (3.0 - DISTRESS) * 30))
        .otherwise(limit(z / DISTRESS * 50))
    )
    beneish = (
        F.when(m.isNull(), 60.0)
        .when(m <= MANIPULATOR, limit(55 + (MANIPULATOR - m) / 1.78 * 45, 55.0))
        .otherwise(limit(55 - (m - MANIPULATOR) / 2.22 * 55, 0.0, 55.0))
    )
    return {
        "liquidity": limit(liquidity), "solvency": limit(solvency), "profitability": limit(profit),
        "cash_quality": limit(cash), "altman_score": altman, "beneish_score": beneish,
    }


def score_label(overall: Column) -> Column:
    return (
        F.when(overall >= 75, "Healthy").when(overall >= 55, "Caution")
        .when(overall >= 35, "At Risk").otherwise("Critical")
    )


def score_color(overall: Column) -> Column:
    return (
        F.when(overall >= 75, "green").when(overall >= 55, "amber")
        .when(overall >= 35, "orange").otherwise("red")
    )
