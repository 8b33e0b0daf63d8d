"""Null-aware numeric column helpers. Missing is NULL everywhere, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 or either side is missing."""
    return a / F.nullif(b, F.lit(0.0))


def pct_change(curr: Column, prev: Column) -> Column:
    """(curr - prev) / abs(prev), NULL for a zero base."""
    return safe_div(curr - prev, F.abs(prev))


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def clamp(v: Column, lo: float, hi: float) -> Column:
    """Limit to [lo, hi]; a missing value stays missing."""
    return F.when(v.isNotNull(), F.greatest(F.lit(float(lo)), F.least(v, F.lit(float(hi)))))


def clip(v: Column, lo: Column, hi: Column) -> Column:
    """Winsor clip. ``least``/``greatest`` skip NULLs, so a missing bound leaves
    the value unchanged and the guard keeps missing values missing."""
    return F.when(v.isNotNull(), F.least(F.greatest(v, lo), hi))


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def indicator(cond: Column) -> Column:
    """Comparison as 1.0 / 0.0, a missing operand counting as false."""
    return F.coalesce(cond, F.lit(False)).cast("double")


def ensemble(prob: Column, anomaly: Column) -> Column:
    """Blend of supervised probability and anomaly score."""
    return F.lit(0.65) * prob + F.lit(0.35) * anomaly


# Expressions over column names are written as SQL text: one parsed expression
# instead of dozens of driver calls per feature.

COMPANY = "partition by cik order by year"


def by_company() -> WindowSpec:
    """Rows of one company in year order (at most one row per year)."""
    return Window.partitionBy("cik").orderBy("year")


def div(top: str, bottom: str) -> str:
    """SQL of a quotient that is NULL for a zero or missing divisor."""
    return f"(({top}) / nullif({bottom}, 0))"


def ratio(top: str, bottom: str, times: int = 1) -> Column:
    text = div(top, bottom)
    return F.expr(text if times == 1 else f"{text} * {times}")


def previous(name: str, rows: int = 1) -> str:
    """Value ``rows`` rows earlier: positional, a missing calendar year is skipped."""
    return f"lag({name}, {rows}) over ({COMPANY})"


def reported_before(name: str, pad: bool = True) -> str:
    """What :func:`growth` compares with: the last reported value before the row, or without ``pad`` that of the row before."""
    return f"last_value({name}, true) over ({COMPANY} rows between unbounded preceding and 1 preceding)" if pad else previous(name)


def growth(name: str, pad: bool = True, inf_mode: str = "null", prev: str | None = None) -> Column:
    """Year-over-year change.

    ``pad`` carries the last reported value over gaps first, on both sides of
    the comparison. ``inf_mode='null'`` yields NULL on a zero base, ``'ieee'``
    yields signed infinity (and NULL for 0/0). ``prev`` names a column that
    holds :func:`reported_before`: Spark works every mention of a window out anew.
    """
    prev = prev or reported_before(name, pad)
    curr = f"coalesce({name}, {prev})" if pad else name
    change = f"{div(curr, prev)} - 1"
    if inf_mode == "null":
        return F.expr(change)
    return F.expr(
        f"case when {prev} = 0 then case when {curr} > 0 then double('Infinity') "
        f"when {curr} < 0 then double('-Infinity') end else {change} end"
    )


def rolling_slope(name: str, before: str | None = None, oldest: str | None = None) -> Column:
    """OLS slope over the last three rows, divided by their mean magnitude.

    Missing values drop out and the rest are re-indexed 0..n-1, so for two or
    three points the slope is (last - first) / (n - 1). Needs two points; a
    zero mean magnitude divides by one. ``before`` and ``oldest`` name columns
    that hold the values of the two rows before.
    """
    before, oldest = before or previous(name, 1), oldest or previous(name, 2)
    n = " + ".join(f"int({p} is not null)" for p in (oldest, before, name))
    rise = f"(coalesce({name}, {before}) - coalesce({oldest}, {before})) / ({n} - 1)"
    mean = "(" + " + ".join(f"coalesce(abs({p}), 0)" for p in (oldest, before, name)) + f") / ({n})"
    return F.expr(f"case when {n} >= 2 then ({rise}) / coalesce(nullif({mean}, 0), 1) end")


def array_slope(values: Column) -> Column:
    """Slope of an array of two or three points (see :func:`rolling_slope`)."""
    n = F.size(values)
    return F.when(n >= 2, (F.get(values, n - 1) - F.get(values, F.lit(0))) / (n - 1))
