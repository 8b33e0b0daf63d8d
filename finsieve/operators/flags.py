"""Rule-based red flags: a table of rules applied to every company at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsieve.functions.text import fixed
from finsieve.operators.panel import trend_of
from finsieve.operators.scores import TRENDS

SEVERITY_RANK = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}
EMOJI = {"HIGH": "🔴", "MEDIUM": "🟡", "LOW": "🟢"}


@dataclass(frozen=True)
class Rule:
    """One rule. ``when`` is SQL over the signal columns; a rule whose input is
    missing does not fire. ``title`` and ``detail`` are formats whose ``%s``
    take ``args``: (signal, decimals, percent?) triples."""

    no: int
    severity: str
    category: str
    when: str
    title: str
    detail: str
    args: tuple[tuple[str, int, bool], ...] = ()
    title_args: tuple[tuple[str, int, bool], ...] = ()


def _x(name: str, decimals: int = 2) -> tuple[str, int, bool]:
    return (name, decimals, False)


def _pct(name: str) -> tuple[str, int, bool]:
    return (name, 1, True)


# Thresholds, severities, categories and titles every consumer of the flags relies on. Remarks are this library's own.
RULES = (
    Rule(1, "HIGH", "Liquidity", "last_current_ratio < 1.0", "Current Ratio below 1.0",
         "Each dollar due within a year is met by only %s of current assets; bills may go unpaid without new money.",
         (_x("last_current_ratio"),)),
    Rule(2, "MEDIUM", "Liquidity", "last_current_ratio >= 1.0 and last_current_ratio < 1.5", "Deteriorating Current Ratio",
         "A current ratio of %s covers what is due, yet leaves less room than the 1.5 lenders like to see.",
         (_x("last_current_ratio"),)),
    Rule(3, "MEDIUM", "Liquidity", "trend_current_ratio < -0.05", "Current Ratio in multi-year decline",
         "The current ratio has moved by %s a year over the last three reports.", (_pct("trend_current_ratio"),)),
    Rule(4, "HIGH", "Liquidity", "last_quick_ratio < 0.7", "Quick Ratio critically low",
         "Leaving stock aside, liquid assets are %s times current liabilities; under 0.7 counts as critical.",
         (_x("last_quick_ratio"),)),
    Rule(5, "HIGH", "Solvency", "last_debt_equity > 3.0", "Extreme Debt-to-Equity",
         "Borrowings are %sx equity. At over three times, weak years or dearer credit soon reach the owners.", (_x("last_debt_equity"),)),
    Rule(6, "MEDIUM", "Solvency", "last_debt_equity > 2.0 and last_debt_equity <= 3.0", "Elevated Debt-to-Equity",
         "Borrowings are %sx equity, past the 2.0x mark but not yet above 3.0x.", (_x("last_debt_equity"),)),
    Rule(7, "MEDIUM", "Solvency", "trend_debt_equity > 0.08", "Debt load accelerating",
         "Borrowings relative to equity have moved by %s a year over the last three reports.", (_pct("trend_debt_equity"),)),
    Rule(8, "HIGH", "Solvency", "last_debt_assets > 0.7", "Debt-to-Assets above 70%",
         "Creditors finance %s of the assets; 70%% is the line.", (_pct("last_debt_assets"),)),
    Rule(9, "HIGH", "Solvency", "last_interest_coverage < 1.5", "Interest Coverage below 1.5x",
         "Operating profit pays the interest bill %sx; under 1.5x a modest setback can mean missed payments.", (_x("last_interest_coverage"),)),
    Rule(10, "MEDIUM", "Solvency", "last_interest_coverage >= 1.5 and last_interest_coverage < 3.0", "Thin Interest Coverage",
         "Operating profit pays the interest bill %sx, less than the 3x usually asked for.", (_x("last_interest_coverage"),)),
    Rule(11, "MEDIUM", "Profitability", "trend_gross_margin < -0.02", "Gross Margin compression",
         "Gross margin has shifted by %s points a year, a sign of rising costs or of prices that do not hold.", (("trend_gross_margin", 1, None),)),
    Rule(12, "HIGH", "Profitability", "last_net_margin < 0", "Negative Net Income",
         "The latest year closed with a loss: net margin %s.", (_pct("last_net_margin"),)),
    Rule(13, "HIGH", "Profitability", "last_roe < 0", "Negative Return on Equity",
         "Owners' capital shrank in the latest year: return on equity %s.", (_pct("last_roe"),)),
    Rule(14, "LOW", "Profitability", "last_roa < 0.02", "Low Return on Assets",
         "Assets returned %s in the latest year, below the 2%% mark.", (_pct("last_roa"),)),
    Rule(15, "HIGH", "Cash Quality", "last_cfo_ni_ratio < 0.5", "CFO far below Net Income (accrual gap)",
         "Operations brought in %s of cash per unit of reported profit. Profit that is mostly accruals tends to be revised or to fade.", (_x("last_cfo_ni_ratio"),)),
    Rule(16, "MEDIUM", "Cash Quality", "last_cfo_ni_ratio >= 0.5 and last_cfo_ni_ratio < 0.8", "CFO-to-Net-Income ratio weakening",
         "Operations brought in %s of cash per unit of reported profit, under the 0.8 seen as sound.", (_x("last_cfo_ni_ratio"),)),
    Rule(17, "HIGH", "Cash Quality", "last_revenue_growth > 0.05 and last_cfo_growth < -0.05",
         "Revenue rising but Operating Cash Flow falling",
         "Sales went up %s on the year before while cash from operations shrank by %s; sales may be booked before they are paid.", (_pct("last_revenue_growth"), _pct("cfo_fall"))),
    Rule(18, "MEDIUM", "Cash Quality",
         "divergence > 0.15 and not (last_revenue_growth > 0.05 and last_cfo_growth < -0.05)",
         "Revenue-CFO growth divergence widening",
         "Sales changed by %s and operating cash by %s, a gap of %s that can come from early booking of sales.",
         (_pct("last_revenue_growth"), _pct("last_cfo_growth"), _pct("divergence"))),
    Rule(19, "MEDIUM", "Cash Quality", "trend_cfo_revenue < -0.03", "Cash conversion deteriorating",
         "Cash from operations per unit of sales has shifted by %s points a year.", (("trend_cfo_revenue", 1, None),)),
    Rule(20, "MEDIUM", "Cash Quality", "trend_dso > 0.05 and last_dso > 50", "Days Sales Outstanding rising",
         "Customers take %s days to pay, and longer than before; part of the sales may never be collected.",
         (_x("last_dso", 0),)),
    Rule(21, "HIGH", "Altman Z-Score", "altman_z < 1.81", "Distress Zone (Z = %s)",
         "The score is under 1.81, where failures within two years were frequent in the published samples. Check funding and covenants.", (), (_x("altman_z"),)),
    Rule(22, "MEDIUM", "Altman Z-Score", "altman_z >= 1.81 and altman_z < 2.99", "Grey Zone (Z = %s)",
         "The score lies between 1.81 and 2.99, where the published samples held failing and sound companies alike.", (), (_x("altman_z"),)),
    Rule(23, "HIGH", "Beneish M-Score", "beneish_m > -2.22", "Likely Earnings Manipulator (M = %s)",
         "A score of %s is above -2.22, the side on which known misstatements mostly fell. Read the accruals and the notes closely.",
         (_x("beneish_m"),), (_x("beneish_m"),)),
)


def _filled(template: str, args: tuple) -> Column:
    def text(name: str, decimals: int, percent: bool | None) -> Column:
        # percent None: scaled by 100 without the sign
        value = F.col(name) if percent is False else F.col(name) * 100
        shown = fixed(value, decimals)
        return F.concat(shown, F.lit("%")) if percent else shown

    pieces = template.replace("%%", "%").split("%s")
    parts: list[Column] = [F.lit(pieces[0])]
    for piece, arg in zip(pieces[1:], args):
        parts += [text(*arg), F.lit(piece)]
    return F.concat(*parts)


def with_flags(signals: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``flags``, the array of fired rules of each company in rule order."""
    ready = signals.select(
        "*",
        *[trend_of(F.col(f"last3_{n}")).alias(f"trend_{n}") for n in TRENDS],
        F.expr("last_revenue_growth - last_cfo_growth").alias("divergence"),
        F.abs("last_cfo_growth").alias("cfo_fall"),
    )
    fired = [
        F.when(
            F.expr(r.when),
            F.struct(
                F.lit(r.no).alias("rule_no"), F.lit(r.severity).alias("severity"),
                F.lit(SEVERITY_RANK[r.severity]).alias("severity_rank"), F.lit(r.category).alias("category"),
                _filled(r.title, r.title_args).alias("title"), _filled(r.detail, r.args).alias("detail"),
                F.lit(EMOJI[r.severity]).alias("emoji"),
            ),
        )
        for r in rules
    ]
    return ready.select(*signals.columns, F.array_compact(F.array(*fired)).alias("flags"))


def detect_flags(signals: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Long table (cik, rule_no, severity, category, title, detail, emoji).

    Rules are evaluated in one projection per company and exploded; only fired
    rules leave the row, so the output is as long as the number of flags.
    """
    # the outer form keeps the optimiser from repeating the rules in a filter on the array
    fired = with_flags(signals, rules).select("cik", F.explode_outer("flags").alias("f"))
    return fired.filter("f is not null").select("cik", "f.*")


def severity_count(severity: str) -> Column:
    """Fired rules of one severity in a row that carries ``flags``."""
    return F.size(F.filter("flags", lambda f: f["severity"] == severity)).cast("bigint")


def sorted_flags(flags: DataFrame) -> DataFrame:
    """Severity order, stable within rule order, per company."""
    return flags.orderBy("cik", "severity_rank", "rule_no")


def counts_by_severity(flags: DataFrame) -> DataFrame:
    return flags.groupBy("cik").agg(
        *[F.count(F.when(F.col("severity") == s, True)).alias(f"{s.lower()}_flags") for s in SEVERITY_RANK]
    )


def by_category(flags: DataFrame) -> DataFrame:
    """Flags of a company grouped by category; at most one entry per rule."""
    entry = F.struct("severity_rank", "rule_no", "severity", "title", "detail", "emoji")
    return flags.groupBy("cik", "category").agg(F.array_sort(F.collect_list(entry)).alias("flags"))
