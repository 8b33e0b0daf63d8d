"""Report tables for every company: header, series, bands and display tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finsieve.functions.text import change_text, money, multiple, percent
from finsieve.operators import flags as flg
from finsieve.operators import scores as sc
from finsieve.operators.panel import GROWTH, RATIOS, history, ratio_panel, reported

# metric -> (display name, formatter)
KEY_METRICS = {
    "current_ratio": ("Current Ratio", multiple),
    "debt_equity": ("Debt / Equity", multiple),
    "net_margin": ("Net Margin", percent),
    "cfo_ni_ratio": ("CFO / Net Income", multiple),
    "gross_margin": ("Gross Margin", percent),
    "interest_coverage": ("Interest Coverage", multiple),
}
TREND_METRICS = {
    "current_ratio": "Current Ratio", "net_margin": "Net Margin", "gross_margin": "Gross Margin",
    "cfo_revenue": "CFO/Revenue", "roe": "Return on Equity", "interest_coverage": "Interest Coverage",
}
PERCENT_WORDS = ("margin", "growth", "ratio", "roa", "roe")


def header(signals: DataFrame, trend_penalty: str = "off") -> DataFrame:
    """One row per company: scores, flag counts and six key metrics as text.

    A projection of the company's signals: no join and no exchange of its own.
    """
    scored = sc.company_scores(flg.with_flags(signals), trend_penalty)
    shown = []
    for metric, (_, formatter) in KEY_METRICS.items():
        shown.append(formatter(F.col(f"last_{metric}")).alias(metric))
        before = F.expr(f"try_element_at({reported(metric)}, -2)")
        shown.append(change_text(F.col(f"last_{metric}"), before).alias(f"{metric}_change"))
    main = scored.select(
        "cik", "ticker", "company_name", money(F.col("market_cap")).alias("market_cap"),
        "overall", "label", "color", "altman_z", "beneish_m", *shown,
        *[flg.severity_count(s).alias(f"{s.lower()}_flags") for s in flg.SEVERITY_RANK],
    )
    return main.withColumn("clean", (F.col("high_flags") == 0) & (F.col("medium_flags") == 0))


def indexed_series(panel: DataFrame) -> DataFrame:
    """Revenue, operating cash flow and income over the size of their first value."""
    first = Window.partitionBy("cik").orderBy("year").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    indexed = []
    for c in ("revenue", "cfo", "net_income"):
        base = F.abs(F.first(c, ignorenulls=True).over(first))
        indexed.append((F.col(c) / F.when(base == 0, F.lit(1.0)).otherwise(base)).alias(c))
    return panel.select("cik", "year", *indexed).unpivot(
        ["cik", "year"], ["revenue", "cfo", "net_income"], "series", "value"
    ).filter("value is not null")


def ratio_trends(panel: DataFrame) -> DataFrame:
    return panel.unpivot(["cik", "year"], list(TREND_METRICS), "metric", "value").filter("value is not null")


def cash_split(signals: DataFrame) -> DataFrame:
    """Operating cash flow, capital spending and free cash flow in billions."""
    cfo = F.coalesce(F.col("last_cfo"), F.lit(0.0))
    spent = F.abs(F.coalesce(F.col("last_capex"), F.lit(0.0)))
    return signals.select(
        "cik",
        (cfo / 1e9).alias("Operating CFO"), (-spent / 1e9).alias("CapEx"), ((cfo - spent) / 1e9).alias("FCF"),
    ).unpivot(["cik"], ["Operating CFO", "CapEx", "FCF"], "item", "billions")


def leverage_bands(panel: DataFrame) -> DataFrame:
    de = F.col("debt_equity")
    return panel.filter(de.isNotNull()).select(
        "cik", "year", "debt_equity",
        F.when(de > 2, "red").when(de > 1, "amber").otherwise("green").alias("band"),
    )


def score_parts(scores: DataFrame) -> DataFrame:
    """Category scores in long form with their colour."""
    return scores.unpivot(["cik"], list(sc.WEIGHTS), "category", "score").select(
        "*", sc.score_color(F.col("score")).alias("color")
    )


def display_table(panel: DataFrame) -> DataFrame:
    """All years; margin, growth, ratio and return columns as percent text."""
    def shown(name: str):
        if any(word in name for word in PERCENT_WORDS):
            return percent(F.col(name), "—").alias(name)
        return F.col(name)

    return panel.select("cik", "year", *[shown(n) for n in RATIOS + GROWTH])


def gauges(signals: DataFrame) -> DataFrame:
    """Altman and Beneish with zone, class and the range a gauge shows."""
    z, m = F.col("altman_z"), F.col("beneish_m")
    return signals.select(
        "cik", "altman_z", sc.altman_zone(z).alias("altman_zone"),
        F.when(z.isNotNull(), F.greatest(F.lit(-2.0), F.least(z, F.lit(6.0)))).alias("altman_shown"),
        "beneish_m", sc.beneish_class(m).alias("beneish_class"),
        F.when(m.isNotNull(), F.greatest(F.lit(-5.0), F.least(m, F.lit(1.0)))).alias("beneish_shown"),
    )


def company_report(
    wide: DataFrame, market_cap: DataFrame | None = None, trend_penalty: str = "off"
) -> dict[str, DataFrame]:
    """Every report table, lazily. Filter on ``cik`` for one company."""
    signals = sc.company_signals(history(wide), market_cap)
    panel = ratio_panel(wide)
    scores = sc.company_scores(signals, trend_penalty)
    return {
        "header": header(signals, trend_penalty), "ratios": panel, "display": display_table(panel),
        "scores": scores.drop("h"), "score_parts": score_parts(scores), "flags": flg.detect_flags(signals),
        "series": indexed_series(panel), "trends": ratio_trends(panel), "cash": cash_split(signals),
        "leverage": leverage_bands(panel), "gauges": gauges(signals),
    }
