"""Company-year panel: pivot, ratio panel, growth and per-company history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsieve.functions.numeric import COMPANY, array_slope, growth, ratio
from finsieve.sources.sample import CONCEPTS

RATIOS = (
    "current_ratio", "quick_ratio", "cash_ratio", "debt_equity", "total_debt", "debt_assets",
    "interest_coverage", "gross_margin", "ebit_margin", "net_margin", "roa", "roe",
    "cfo_ni_ratio", "cfo_revenue", "revenue", "cfo", "net_income", "dso", "dio",
    "asset_turnover",
)
HISTORY_RAW = (
    "total_assets", "current_assets", "total_liabilities", "current_liabilities", "retained_earnings",
    "operating_income", "receivables", "gross_profit", "da", "sga", "capex",
)
PASSED_THROUGH = ("revenue", "cfo", "net_income")
GROWTH = ("revenue_growth", "cfo_growth", "gm_delta")


def company_year(long: DataFrame, concepts: tuple[str, ...] = CONCEPTS) -> DataFrame:
    """Pivot long facts to one row per (cik, year) with a fixed column list.

    The first step aggregates doubles under grouping keys only, so it stays a
    hash aggregate with map-side combine. Several share classes of one CIK are
    then resolved to the first reported value in ticker order; that step and
    every later per-company window share the one exchange on ``cik``.
    """
    keys = ["cik", "year", "ticker", "company_name"]
    per_ticker = long.groupBy(*keys).agg(
        *[F.min(F.when(F.col("concept") == c, F.col("value"))).alias(c) for c in concepts]
    )
    first = [
        F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ticker"))).alias(c) for c in concepts
    ]
    return (
        per_ticker.repartition("cik")
        .groupBy("cik", "year")
        .agg(F.min("ticker").alias("ticker"), F.min_by("company_name", "ticker").alias("company_name"), *first)
        .select("cik", "ticker", "company_name", "year", *concepts)
    )


def to_long(wide: DataFrame, ids: list[str], columns: list[str], name: str = "concept") -> DataFrame:
    """Unpivot; missing values give no row."""
    return wide.unpivot(ids, columns, name, "value").filter("value is not null")


def col_or_null(df: DataFrame, name: str, default: float | None = None) -> Column:
    """Column if present, else a constant: tolerance for user frames."""
    return F.col(name) if name in df.columns else F.lit(default).cast("double")


def with_columns_or_null(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return df.select("*", *[F.lit(None).cast("double").alias(n) for n in names if n not in df.columns])


def align(*frames: DataFrame, on: tuple[str, ...] = ("cik", "year")) -> DataFrame:
    """Inner join of value series; the i-th value column becomes ``v{i}``."""
    renamed = [f.select(*on, F.col("value").alias(f"v{i}")) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.join(b, list(on)), renamed)


def ratio_rows(wide: DataFrame, pad: bool = True, inf_mode: str = "null") -> DataFrame:
    """The wide rows plus 23 ratio columns and ``has_metric``.

    Each metric needs all of its operands. Quick ratio needs cash in the year;
    a company that never reports inventory has cash subtracted instead. Debt
    needs long- and short-term debt unless the company never reports
    short-term debt. The whole-company facts and the growth columns share one
    exchange and one sort by (cik, year).
    """
    w = with_columns_or_null(wide, CONCEPTS)
    whole = f"over ({COMPANY} rows between unbounded preceding and unbounded following)"
    ever = w.select(
        "*",
        F.expr(f"max(inventory is not null) {whole}").alias("_has_inventory"),
        F.expr(f"max(short_term_debt is not null) {whole}").alias("_has_std"),
    )
    debt = "case when _has_std then long_term_debt + short_term_debt else long_term_debt end"
    panel = ever.select(
        *wide.columns,
        ratio("current_assets", "current_liabilities").alias("current_ratio"),
        ratio(
            "case when cash is not null then current_assets - case when _has_inventory then inventory else cash end end",
            "current_liabilities",
        ).alias("quick_ratio"),
        ratio("cash", "current_liabilities").alias("cash_ratio"),
        ratio(debt, "equity").alias("debt_equity"),
        F.expr(f"case when equity is not null then {debt} end").alias("total_debt"),
        ratio("total_liabilities", "total_assets").alias("debt_assets"),
        ratio("operating_income", "abs(interest_expense)").alias("interest_coverage"),
        ratio("gross_profit", "revenue").alias("gross_margin"),
        ratio("operating_income", "revenue").alias("ebit_margin"),
        ratio("net_income", "revenue").alias("net_margin"),
        ratio("net_income", "total_assets").alias("roa"),
        ratio("net_income", "equity").alias("roe"),
        ratio("cfo", "net_income").alias("cfo_ni_ratio"),
        ratio("cfo", "revenue").alias("cfo_revenue"),
        *[n for n in PASSED_THROUGH if n not in wide.columns],
        ratio("receivables", "revenue", 365).alias("dso"),
        ratio("inventory", "cogs", 365).alias("dio"),
        ratio("revenue", "total_assets").alias("asset_turnover"),
    )
    flagged = panel.select("*", F.expr(f"coalesce({', '.join(RATIOS)}) is not null").alias("has_metric"))
    # margins compare with the previous year that has any metric at all
    earlier = (
        "last_value(case when has_metric then struct(gross_margin) end, true) "
        f"over ({COMPANY} rows between unbounded preceding and 1 preceding)"
    )
    return flagged.select(
        "*",
        growth("revenue", pad, inf_mode).alias("revenue_growth"),
        growth("cfo", pad, inf_mode).alias("cfo_growth"),
        F.expr(f"gross_margin - {earlier}.gross_margin").alias("gm_delta"),
    )


def ratio_panel(wide: DataFrame, pad: bool = True, inf_mode: str = "null") -> DataFrame:
    """(cik, year) and 23 metrics; years without any metric drop."""
    rows = ratio_rows(wide, pad, inf_mode)
    return rows.filter("has_metric").select("cik", "year", *RATIOS, *GROWTH)


def history(wide: DataFrame, pad: bool = True, inf_mode: str = "null") -> DataFrame:
    """One row per company: ``h``, its years in order as an array of structs.

    Rows are unique per (cik, year), so an array holds at most one entry per
    calendar year. A single pass over the panel; no exchange beyond the one
    the ratio windows already needed.
    """
    rows = ratio_rows(wide, pad, inf_mode)
    # a year without any metric has raw values but no growth: the padded one would be 0
    grown = [F.when(F.col("has_metric"), F.col(c)).alias(c) for c in GROWTH]
    entry = F.struct("year", "has_metric", *HISTORY_RAW, *RATIOS, *grown)
    return rows.groupBy("cik").agg(
        F.min("ticker").alias("ticker"),
        F.min_by("company_name", "ticker").alias("company_name"),
        F.array_sort(F.collect_list(entry)).alias("h"),
    )


def reported(name: str) -> str:
    """SQL of the non-missing values of one history column in year order."""
    return f"array_compact(h.{name})"


def latest(name: str) -> str:
    """SQL of the last non-missing value."""
    return f"try_element_at({reported(name)}, -1)"


def tail(values: str, n: int) -> str:
    return f"slice({values}, greatest(size({values}) - {n - 1}, 1), {n})"


def trend_of(last3: Column) -> Column:
    """Slope of up to three values per magnitude of the first of them."""
    base = F.abs(F.get(last3, F.lit(0)))
    return array_slope(last3) / F.when(base == 0, F.lit(1.0)).otherwise(base)
