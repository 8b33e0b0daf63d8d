"""The same queries as SQL over the given tables."""

from __future__ import annotations

import re

from finsieve.operators import features as fea
from finsieve.operators.models import FEATURE_LABELS
from finsieve.operators.panel import GROWTH, RATIOS
from finsieve.sources.facts import BULK, SINGLE
from finsieve.sources.sample import CONCEPTS

# Written here a second time, so that a changed constant of the library shows as a difference.
WEIGHTS = {"liquidity": 0.15, "solvency": 0.2, "profitability": 0.15, "cash_quality": 0.25, "altman_score": 0.15, "beneish_score": 0.1}

_EXPR = {
    "total_assets": "e*(2+x)", "current_assets": "case when f<>'R' then e*(1+t) end",
    "total_liabilities": "e*(1+x*5)", "current_liabilities": "case when s='O' then e*(1-x) end",
    "equity": "e*(0.5-x*6)", "retained_earnings": "case when f='A' then e*0.4 else -e*t end",
    "cash": "case when f='N' and s='F' then e*t end", "receivables": "case when s='O' then e end",
    "inventory": "case when f='R' and s='F' then e end", "goodwill": "case when x=0 then e*0.2 end",
    "intangibles": "case when t=0 then e*0.1 end", "revenue": "e",
    "gross_profit": "case when f='A' then e end", "cogs": "case when f<>'A' then e end",
    "operating_income": "case when f='A' then e else -e*x*5 end",
    "net_income": "case when f='A' then e*(1-x) else -e*t*6 end",
    "interest_expense": "case when x>=0.08 then e*x end", "da": "case when s='F' then e*0.05 end",
    "sga": "case when s='F' then e*t end", "rd_expense": "case when x=0.05 then e*0.1 end",
    "tax_expense": "e*t", "cfo": "case when s='F' then e*t*3 else -e*x end", "cfi": "-e*t",
    "cff": "e*(x-0.05)", "capex": "case when f='N' then -e*0.1 end",
    "long_term_debt": "case when n=1 then e*0.7 end", "short_term_debt": "case when n=2 then e*0.3 end",
}


def cik(key: str) -> str:
    return f"lpad(cast({key} as varchar), 10, '0')"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def r6(names, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) as {n}" for n in names)


PANEL = f"""
li as (select l_orderkey, cast(l_extendedprice as decimal(15,2)) e, cast(l_discount as decimal(4,2)) x,
         cast(l_tax as decimal(4,2)) t, l_returnflag f, l_linestatus s, l_linenumber n from lineitem),
cy as (select {cik('c_custkey')} as cik, 'T' || cast(c_custkey as varchar) as ticker, c_name as company_name,
         cast(year(o_orderdate) as int) as year,
         {', '.join(f'cast(sum({v}) as double) as {k}' for k, v in _EXPR.items())}
       from orders join li on o_orderkey = l_orderkey join customer on o_custkey = c_custkey
       group by c_custkey, c_name, year(o_orderdate))"""

LONG = "raw as (unpivot cy on " + ", ".join(CONCEPTS) + " into name concept value value)"

FRAUD = f"""
fraud as (select {cik('c_custkey')} as cik, 'T' || cast(c_custkey as varchar) as ticker, c_name as company_name,
            cast(1000 + c_custkey % 9000 as int) as aaer_no,
            make_date(cast(1998 + c_custkey % 4 as int), 12, 31) as fraud_date
          from customer where c_acctbal < 0)"""
BANKRUPT = f"""
bankrupt as (select {cik('c_custkey')} as cik, make_date(cast(1999 + c_custkey % 3 as int), 6, 15) as bankruptcy_date
             from customer where c_custkey % 37 = 0)"""

# ratio panel -------------------------------------------------------------------------------
_RATIO_SQL = {
    "current_ratio": div("current_assets", "current_liabilities"),
    "quick_ratio": "case when cash is not null then case when has_inv then "
                   + div("current_assets - inventory", "current_liabilities") + " else "
                   + div("current_assets - cash", "current_liabilities") + " end end",
    "cash_ratio": div("cash", "current_liabilities"),
    "debt_equity": "case when has_std then " + div("long_term_debt + short_term_debt", "equity")
                   + " else " + div("long_term_debt", "equity") + " end",
    "total_debt": "case when equity is not null then case when has_std then long_term_debt + short_term_debt "
                  "else long_term_debt end end",
    "debt_assets": div("total_liabilities", "total_assets"),
    "interest_coverage": div("operating_income", "abs(interest_expense)"),
    "gross_margin": div("gross_profit", "revenue"), "ebit_margin": div("operating_income", "revenue"),
    "net_margin": div("net_income", "revenue"), "roa": div("net_income", "total_assets"),
    "roe": div("net_income", "equity"), "cfo_ni_ratio": div("cfo", "net_income"), "cfo_revenue": div("cfo", "revenue"),
    "dso": div("receivables", "revenue") + " * 365", "dio": div("inventory", "cogs") + " * 365",
    "asset_turnover": div("revenue", "total_assets"),
}
W = "partition by cik order by year"


def padded(c: str) -> tuple[str, str]:
    prev = f"last_value({c} ignore nulls) over ({W} rows between unbounded preceding and 1 preceding)"
    return prev, f"coalesce({c}, {prev})"


def yoy(c: str) -> str:
    prev, curr = padded(c)
    return f"({curr}) / nullif({prev}, 0) - 1"


RATIO = PANEL + f""",
ever as (select *, bool_or(inventory is not null) over (partition by cik) as has_inv,
                bool_or(short_term_debt is not null) over (partition by cik) as has_std from cy),
rat0 as (select cik, year, revenue, cfo, net_income, {', '.join(f'{v} as {k}' for k, v in _RATIO_SQL.items())} from ever),
rat1 as (select * from rat0 where coalesce({', '.join(RATIOS)}) is not null),
rat as (select *, {yoy('revenue')} as revenue_growth, {yoy('cfo')} as cfo_growth,
          gross_margin - lag(gross_margin) over ({W}) as gm_delta from rat1)"""

# per-company signals ---------------------------------------------------------------------
_LAST_RAW = ("total_assets", "current_assets", "current_liabilities", "retained_earnings", "operating_income",
             "total_liabilities", "capex")
_TRENDS = ("current_ratio", "debt_equity", "gross_margin", "cfo_revenue", "dso")
_LASTS = tuple(RATIOS) + tuple(GROWTH)


def last(c: str) -> str:
    return f"last({c} order by year) filter (where {c} is not null)"


_PAIR = ("revenue", "receivables", "gross_profit", "total_assets", "current_assets", "da", "sga", "total_liabilities",
         "net_income", "cfo")


def _ratio2(y: str, a: str, b: str) -> str:
    return f"({y}_{a} / nullif({y}_{b}, 0))"


def _noncurrent(y: str) -> str:
    return f"(({y}_total_assets - {y}_current_assets) / nullif({y}_total_assets, 0))"


def _wear(y: str) -> str:
    d, a = f"nullif({y}_da, 0)", f"nullif({y}_total_assets, 0)"
    return f"nullif({d} / nullif({d} + {a}, 0), 0)"


def over(a: str, b: str) -> str:
    return f"({a} / nullif({b}, 0))"


SIGNALS = RATIO + f""",
cap as (select {cik('c_custkey')} as cik, c_acctbal * 1000 as market_cap from customer where c_acctbal > 0),
raw_last as (select cik, min(ticker) as ticker, min(company_name) as company_name,
               {', '.join(f'{last(c)} as last_{c}' for c in _LAST_RAW)},
               count(net_income) as n_ni, count(cfo) as n_cfo from cy group by cik),
rat_last as (select cik, {', '.join(f'{last(c)} as last_{c}' for c in _LASTS)},
               {', '.join(f'list({c} order by year) filter (where {c} is not null) as all_{c}' for c in RATIOS)}
             from rat group by cik),
pairs as (select *, row_number() over (partition by cik order by year desc) as rn from cy
          where revenue is not null and receivables is not null and gross_profit is not null and total_assets is not null),
pair as (select t.cik, {', '.join(f'p.{c} as p_{c}, t.{c} as t_{c}' for c in _PAIR)}
         from (select * from pairs where rn = 1) t join (select * from pairs where rn = 2) p on t.cik = p.cik),
idx as (select pair.cik,
    {over(_ratio2('t', 'receivables', 'revenue'), _ratio2('p', 'receivables', 'revenue'))} as dsri,
    {over(_ratio2('p', 'gross_profit', 'revenue'), _ratio2('t', 'gross_profit', 'revenue'))} as gmi,
    coalesce({over(_noncurrent('t'), _noncurrent('p'))}, 1.0) as aqi,
    t_revenue / nullif(p_revenue, 0) as sgi,
    coalesce({over(_wear('p'), _wear('t'))}, 1.0) as depi,
    coalesce({over(_ratio2('t', 'sga', 'revenue'), _ratio2('p', 'sga', 'revenue'))}, 1.0) as sgai,
    coalesce({over(_ratio2('t', 'total_liabilities', 'total_assets'), _ratio2('p', 'total_liabilities', 'total_assets'))}, 1.0) as lvgi,
    coalesce(case when n_ni >= 2 and n_cfo >= 2 then (t_net_income - t_cfo) / nullif(t_total_assets, 0) end, 0.0) as tata
  from pair join raw_last on pair.cik = raw_last.cik),
sig0 as (select raw_last.*, rat_last.* exclude (cik), cap.market_cap,
    cast(-4.84 as double) + 0.920::double*dsri + 0.528::double*gmi + 0.404::double*aqi + 0.892::double*sgi
      + 0.115::double*depi - 0.172::double*sgai + 4.679::double*tata - 0.327::double*lvgi as beneish_m,
    1.2::double*((last_current_assets - last_current_liabilities) / nullif(last_total_assets, 0))
      + 1.4::double*(last_retained_earnings / nullif(last_total_assets, 0))
      + 3.3::double*(last_operating_income / nullif(last_total_assets, 0))
      + 0.6::double*(coalesce(nullif(market_cap, 0), 1.0) / nullif(last_total_liabilities, 0))
      + last_revenue / nullif(last_total_assets, 0) as altman_z
  from raw_last left join rat_last on raw_last.cik = rat_last.cik left join cap on raw_last.cik = cap.cik
    left join idx on raw_last.cik = idx.cik),
sig1 as (select *, {', '.join(f'list_slice(all_{c}, greatest(len(all_{c}) - 2, 1), len(all_{c})) as l3_{c}' for c in _TRENDS)} from sig0),
sig2 as (select *, {', '.join(f'case when len(l3_{c}) >= 2 then (l3_{c}[-1] - l3_{c}[1]) / (len(l3_{c}) - 1) end as slope_{c}' for c in _TRENDS)} from sig1),
sig as (select *, {', '.join(f'slope_{c} / (case when abs(l3_{c}[1]) = 0 then 1 else abs(l3_{c}[1]) end) as trend_{c}' for c in _TRENDS)},
          last_revenue_growth - last_cfo_growth as divergence, abs(last_cfo_growth) as cfo_fall from sig2)"""


def lim(x: str, lo: str = "0.0", hi: str = "100.0") -> str:
    return f"greatest({lo}::double, least({x}, {hi}::double))"


def start(neutral: str, m: str, x: str) -> str:
    return f"(case when {m} is not null then {lim(x)} else {neutral}::double end)"


def blend(score: str, keep: float, m: str, x: str) -> str:
    share = round(1 - keep, 2)
    return f"(case when {m} is not null then {keep}::double * {score} + {share}::double * {lim(x)} else {score} end)"


def _scores(penalty: bool) -> str:
    def pen(score: str, factor: float, bad: str) -> str:
        return f"({score} * (case when {bad} then {factor}::double else 1.0::double end))" if penalty else score

    liq = start("50", "last_current_ratio", "(last_current_ratio - 0.5::double) / 1.5::double * 100")
    liq = pen(blend(liq, 0.6, "last_quick_ratio", "(last_quick_ratio - 0.3::double) / 1.0::double * 100"), 0.85, "slope_current_ratio < 0")
    sol = start("50", "last_debt_equity", "(4.0::double - last_debt_equity) / 4.0::double * 100")
    sol = blend(sol, 0.55, "last_interest_coverage", "(last_interest_coverage - 1.0::double) / 7.0::double * 100")
    sol = pen(blend(sol, 0.7, "last_debt_assets", "(0.7::double - last_debt_assets) / 0.7::double * 100"), 0.88, "slope_debt_equity > 0")
    prof = start("40", "last_net_margin", "last_net_margin * 300 + 40")
    prof = blend(prof, 0.5, "last_gross_margin", "last_gross_margin * 200")
    prof = pen(blend(prof, 0.6, "last_roe", "last_roe * 250 + 40"), 0.9, "slope_gross_margin < 0")
    cash = start("50", "last_cfo_ni_ratio", "last_cfo_ni_ratio / 1.2::double * 80 + 10")
    cash = blend(cash, 0.55, "last_cfo_revenue", "last_cfo_revenue * 300 + 30")
    cash = f"({cash} * (case when divergence > 0.20::double then 0.75::double when divergence > 0.10::double then 0.9::double else 1.0::double end))"
    cash = pen(cash, 0.92, "slope_dso > 0")
    z, m = "altman_z", "beneish_m"
    alt = (f"case when {z} is null then 50.0::double when {z} >= 3.0 then {lim(f'80 + ({z} - 3.0::double) * 10')} "
           f"when {z} >= 1.81::double then {lim(f'50 + ({z} - 1.81::double) / (3.0::double - 1.81::double) * 30')} "
           f"else {lim(f'{z} / 1.81::double * 50')} end")
    ben = (f"case when {m} is null then 60.0::double when {m} <= -2.22::double then {lim(f'55 + (-2.22::double - {m}) / 1.78::double * 45', '55.0')} "
           f"else {lim(f'55 - ({m} + 2.22::double) / 2.22::double * 55', '0.0', '55.0')} end")
    overall = " + ".join(f"r_{n} * {w}::double" for n, w in WEIGHTS.items())
    return SIGNALS + f""",
sc0 as (select *, {lim(liq)} as r_liquidity, {lim(sol)} as r_solvency, {lim(prof)} as r_profitability,
          {lim(cash)} as r_cash_quality, {alt} as r_altman_score, {ben} as r_beneish_score from sig),
sc1 as (select *, {', '.join(f'round(r_{n}, 1) as {n}' for n in WEIGHTS)}, round({overall}, 1) as overall from sc0),
sc as (select *, case when overall >= 75 then 'Healthy' when overall >= 55 then 'Caution' when overall >= 35 then 'At Risk' else 'Critical' end as label,
         case when overall >= 75 then 'green' when overall >= 55 then 'amber' when overall >= 35 then 'orange' else 'red' end as color from sc1)"""


SCORES = _scores(False)


def _num(c: str, decimals: int = 2) -> str:
    return f"printf('%.{decimals}f', {c})"


def _share(c: str) -> str:
    return f"printf('%.1f', {c} * 100)"


# number, severity, category, condition, title and remark as SQL; own copy of the rules
_FLAGS = (
    (1, "HIGH", "Liquidity", "last_current_ratio < 1", "'Current Ratio below 1.0'",
     f"'Each dollar due within a year is met by only ' || {_num('last_current_ratio')} || ' of current assets; bills may go unpaid without new money.'"),
    (2, "MEDIUM", "Liquidity", "last_current_ratio between 1 and 1.5 and last_current_ratio <> 1.5", "'Deteriorating Current Ratio'",
     f"'A current ratio of ' || {_num('last_current_ratio')} || ' covers what is due, yet leaves less room than the 1.5 lenders like to see.'"),
    (3, "MEDIUM", "Liquidity", "trend_current_ratio < -0.05::double", "'Current Ratio in multi-year decline'",
     f"'The current ratio has moved by ' || {_share('trend_current_ratio')} || '% a year over the last three reports.'"),
    (4, "HIGH", "Liquidity", "last_quick_ratio < 0.7::double", "'Quick Ratio critically low'",
     f"'Leaving stock aside, liquid assets are ' || {_num('last_quick_ratio')} || ' times current liabilities; under 0.7 counts as critical.'"),
    (5, "HIGH", "Solvency", "last_debt_equity > 3", "'Extreme Debt-to-Equity'",
     f"'Borrowings are ' || {_num('last_debt_equity')} || 'x equity. At over three times, weak years or dearer credit soon reach the owners.'"),
    (6, "MEDIUM", "Solvency", "last_debt_equity > 2 and not last_debt_equity > 3", "'Elevated Debt-to-Equity'",
     f"'Borrowings are ' || {_num('last_debt_equity')} || 'x equity, past the 2.0x mark but not yet above 3.0x.'"),
    (7, "MEDIUM", "Solvency", "trend_debt_equity > 0.08::double", "'Debt load accelerating'",
     f"'Borrowings relative to equity have moved by ' || {_share('trend_debt_equity')} || '% a year over the last three reports.'"),
    (8, "HIGH", "Solvency", "last_debt_assets > 0.7::double", "'Debt-to-Assets above 70%'",
     f"'Creditors finance ' || {_share('last_debt_assets')} || '% of the assets; 70% is the line.'"),
    (9, "HIGH", "Solvency", "last_interest_coverage < 1.5", "'Interest Coverage below 1.5x'",
     f"'Operating profit pays the interest bill ' || {_num('last_interest_coverage')} || 'x; under 1.5x a modest setback can mean missed payments.'"),
    (10, "MEDIUM", "Solvency", "last_interest_coverage >= 1.5 and last_interest_coverage < 3", "'Thin Interest Coverage'",
     f"'Operating profit pays the interest bill ' || {_num('last_interest_coverage')} || 'x, less than the 3x usually asked for.'"),
    (11, "MEDIUM", "Profitability", "trend_gross_margin < -0.02::double", "'Gross Margin compression'",
     f"'Gross margin has shifted by ' || {_share('trend_gross_margin')} || ' points a year, a sign of rising costs or of prices that do not hold.'"),
    (12, "HIGH", "Profitability", "last_net_margin < 0", "'Negative Net Income'",
     f"'The latest year closed with a loss: net margin ' || {_share('last_net_margin')} || '%.'"),
    (13, "HIGH", "Profitability", "last_roe < 0", "'Negative Return on Equity'",
     f"'Owners'' capital shrank in the latest year: return on equity ' || {_share('last_roe')} || '%.'"),
    (14, "LOW", "Profitability", "last_roa < 0.02::double", "'Low Return on Assets'",
     f"'Assets returned ' || {_share('last_roa')} || '% in the latest year, below the 2% mark.'"),
    (15, "HIGH", "Cash Quality", "last_cfo_ni_ratio < 0.5", "'CFO far below Net Income (accrual gap)'",
     f"'Operations brought in ' || {_num('last_cfo_ni_ratio')} || ' of cash per unit of reported profit. Profit that is mostly accruals tends to be revised or to fade.'"),
    (16, "MEDIUM", "Cash Quality", "last_cfo_ni_ratio >= 0.5 and last_cfo_ni_ratio < 0.8::double", "'CFO-to-Net-Income ratio weakening'",
     f"'Operations brought in ' || {_num('last_cfo_ni_ratio')} || ' of cash per unit of reported profit, under the 0.8 seen as sound.'"),
    (17, "HIGH", "Cash Quality", "last_revenue_growth > 0.05::double and last_cfo_growth < -0.05::double", "'Revenue rising but Operating Cash Flow falling'",
     f"'Sales went up ' || {_share('last_revenue_growth')} || '% on the year before while cash from operations shrank by ' || {_share('cfo_fall')} || '%; sales may be booked before they are paid.'"),
    (18, "MEDIUM", "Cash Quality", "divergence > 0.15::double and (last_revenue_growth <= 0.05::double or last_cfo_growth >= -0.05::double)",
     "'Revenue-CFO growth divergence widening'",
     f"'Sales changed by ' || {_share('last_revenue_growth')} || '% and operating cash by ' || {_share('last_cfo_growth')} || '%, a gap of ' || {_share('divergence')} || '% that can come from early booking of sales.'"),
    (19, "MEDIUM", "Cash Quality", "trend_cfo_revenue < -0.03::double", "'Cash conversion deteriorating'",
     f"'Cash from operations per unit of sales has shifted by ' || {_share('trend_cfo_revenue')} || ' points a year.'"),
    (20, "MEDIUM", "Cash Quality", "trend_dso > 0.05::double and last_dso > 50", "'Days Sales Outstanding rising'",
     f"'Customers take ' || {_num('last_dso', 0)} || ' days to pay, and longer than before; part of the sales may never be collected.'"),
    (21, "HIGH", "Altman Z-Score", "altman_z < 1.81::double", f"'Distress Zone (Z = ' || {_num('altman_z')} || ')'",
     "'The score is under 1.81, where failures within two years were frequent in the published samples. Check funding and covenants.'"),
    (22, "MEDIUM", "Altman Z-Score", "altman_z >= 1.81::double and altman_z < 2.99::double", f"'Grey Zone (Z = ' || {_num('altman_z')} || ')'",
     "'The score lies between 1.81 and 2.99, where the published samples held failing and sound companies alike.'"),
    (23, "HIGH", "Beneish M-Score", "beneish_m > -2.22::double", f"'Likely Earnings Manipulator (M = ' || {_num('beneish_m')} || ')'",
     f"'A score of ' || {_num('beneish_m')} || ' is above -2.22, the side on which known misstatements mostly fell. Read the accruals and the notes closely.'"),
)


def _flag_sql(signals: str) -> str:
    sign = {"HIGH": "🔴", "MEDIUM": "🟡", "LOW": "🟢"}
    parts = [
        f"select cik, {no} as rule_no, '{severity}' as severity, '{category}' as category, {title} as title, {remark} as detail, "
        f"'{sign[severity]}' as emoji from sig where {when}"
        for no, severity, category, when, title, remark in _FLAGS
    ]
    return signals + ",\nfl as (" + "\nunion all\n".join(parts) + ")"


# every fifth company's last year keeps its assets only
GAP_PANEL = PANEL.replace("\ncy as (", "\ncy0 as (") + """,
cy as (select cik, ticker, company_name, year, """ + ", ".join(
    c if c == "total_assets" else f"case when not (cast(cik as bigint) % 5 = 0 and year = max(year) over (partition by cik)) then {c} end as {c}"
    for c in CONCEPTS) + " from cy0)"
GAP_SIGNALS = SIGNALS.replace(PANEL, GAP_PANEL)
GAP_FLAGS = _flag_sql(GAP_SIGNALS)
FLAGS = _flag_sql(SIGNALS)
SEVERITY_COUNTS = ", ".join(f"count(*) filter (where severity = '{s}') as {s.lower()}_flags" for s in ("HIGH", "MEDIUM", "LOW"))

# features --------------------------------------------------------------------------------
_F_RATIO = {
    "f_current_ratio": div("current_assets", "current_liabilities"),
    "f_quick_ratio": div("current_assets - coalesce(inventory, 0)", "current_liabilities"),
    "f_cash_ratio": div("cash", "current_liabilities"),
    "f_debt_equity": div("coalesce(long_term_debt, 0) + coalesce(short_term_debt, 0)", "equity"),
    "f_debt_assets": div("total_liabilities", "total_assets"),
    "f_interest_coverage": div("operating_income", "abs(interest_expense)"),
    "f_gross_margin": div("gross_profit", "revenue"), "f_ebit_margin": div("operating_income", "revenue"),
    "f_net_margin": div("net_income", "revenue"), "f_roa": div("net_income", "total_assets"),
    "f_roe": div("net_income", "equity"), "f_asset_turnover": div("revenue", "total_assets"),
    "f_dso": div("receivables", "revenue") + " * 365", "f_dio": div("inventory", "cogs") + " * 365",
    "f_cfo_ni": div("cfo", "net_income"), "f_cfo_revenue": div("cfo", "revenue"),
    "f_capex_revenue": div("abs(capex)", "revenue"),
    "f_goodwill_assets": div("coalesce(goodwill, 0) + coalesce(intangibles, 0)", "total_assets"),
}
_F_YOY = {"f_yoy_revenue": "revenue", "f_yoy_cfo": "cfo", "f_yoy_receivables": "receivables",
          "f_yoy_assets": "total_assets", "f_yoy_net_income": "net_income", "f_yoy_debt": "total_liabilities"}
_F_TREND = {"f_trend_current_ratio": "f_current_ratio", "f_trend_gross_margin": "f_gross_margin",
            "f_trend_net_margin": "f_net_margin", "f_trend_cfo_ni": "f_cfo_ni", "f_trend_debt_equity": "f_debt_equity",
            "f_trend_roa": "f_roa", "f_trend_dso": "f_dso", "f_trend_cfo_rev": "f_cfo_revenue"}
_PREV = ("receivables", "revenue", "gross_profit", "current_assets", "total_assets", "da", "sga", "total_liabilities")


def window_list(c: str) -> str:
    return f"list({c}) filter (where {c} is not null) over ({W} rows between 2 preceding and current row)"


def list_slope(c: str) -> str:
    mean = f"(list_sum(list_transform(w_{c}, lambda v: abs(v))) / len(w_{c}))"
    rise = f"((w_{c}[-1] - w_{c}[1]) / (len(w_{c}) - 1))"
    return f"case when len(w_{c}) >= 2 then {rise} / (case when {mean} = 0 then 1 else {mean} end) end"


def q(a: str, b: str) -> str:
    return f"({a} / nullif({b}, 0))"


def flag01(c: str) -> str:
    return f"(case when {c} then 1.0::double else 0.0::double end)"


def index(now: str, top: str, bottom: str) -> str:
    return (f"case when p_{bottom} = 0 and p_{top} <> 0 and {now} is not null then 0.0::double "
            f"else {now} / nullif({q('p_' + top, 'p_' + bottom)}, 0) end")


FEATURES = PANEL + f""",
fe0 as (select *, {', '.join(f'{v} as {k}' for k, v in _F_RATIO.items())} from cy),
fe1 as (select *, {', '.join(f'{yoy(c)} as {k}' for k, c in _F_YOY.items())},
          {', '.join(f'{window_list(c)} as w_{c}' for c in _F_TREND.values())},
          {', '.join(f'lag({c}) over ({W}) as p_{c}' for c in _PREV)} from fe0),
fe2 as (select *, {', '.join(f'{list_slope(c)} as {k}' for k, c in _F_TREND.items())} from fe1),
fe as (select *, coalesce(f_yoy_revenue, 0) - coalesce(f_yoy_cfo, 0) as f_rev_cfo_divergence,
    {flag01('f_yoy_revenue > 0.05::double')} * {flag01('f_yoy_cfo < -0.05::double')} as f_interact_rev_up_cfo_dn,
    {flag01('f_trend_dso > 0')} * {flag01('f_yoy_revenue > 0.03::double')} as f_interact_dso_rev,
    {flag01('net_income > 0')} * {flag01('cfo < 0')} as f_interact_ni_pos_cfo_neg,
    {flag01('f_trend_debt_equity > 0')} * {flag01('f_interest_coverage < 3')} as f_interact_lev_cov,
    {q('(net_income - cfo)', 'total_assets')} as f_sloan_accrual, {q('(net_income - cfo)', 'total_assets')} as f_total_accruals,
    {q('(cfo - net_income)', 'total_assets')} as f_cash_roa_gap,
    {index(q('receivables', 'revenue'), 'receivables', 'revenue')} as f_b_dsri,
    {q(q('p_gross_profit', 'p_revenue'), q('gross_profit', 'revenue'))} as f_b_gmi,
    {q('(1 - ' + q('current_assets', 'total_assets') + ')', '(1 - ' + q('p_current_assets', 'p_total_assets') + ')')} as f_b_aqi,
    {q('revenue', 'p_revenue')} as f_b_sgi,
    {q(q('p_da', '(p_da + p_total_assets)'), q('da', '(da + total_assets)'))} as f_b_depi,
    {index(q('sga', 'revenue'), 'sga', 'revenue')} as f_b_sgai,
    {index(q('total_liabilities', 'total_assets'), 'total_liabilities', 'total_assets')} as f_b_lvgi,
    {q('(net_income - cfo)', 'total_assets')} as f_b_tata,
    {q('(current_assets - current_liabilities)', 'total_assets')} as f_z_x1, {q('retained_earnings', 'total_assets')} as f_z_x2,
    {q('operating_income', 'total_assets')} as f_z_x3, cast(null as double) as f_z_x4, {q('revenue', 'total_assets')} as f_z_x5
  from fe2)"""

_M = ("cast(-4.84 as double) + 0.920::double*coalesce(f_b_dsri, 1) + 0.528::double*coalesce(f_b_gmi, 1)"
      " + 0.404::double*coalesce(f_b_aqi, 1) + 0.892::double*coalesce(f_b_sgi, 1) + 0.115::double*coalesce(f_b_depi, 1)"
      " - 0.172::double*coalesce(f_b_sgai, 1) + 4.679::double*coalesce(f_b_tata, 0) - 0.327::double*coalesce(f_b_lvgi, 1)")
_Z = "1.2::double*f_z_x1 + 1.4::double*f_z_x2 + 3.3::double*f_z_x3 + 0.6::double*coalesce(f_z_x4, 1) + f_z_x5"
_ALT_RISK = f"1 / (1 + exp(-(1.81::double - ({_Z}))))"
_BEN_RISK = f"1 / (1 + exp(-(1.5::double * (({_M}) + 2.22::double))))"

LABELLED = FEATURES + "," + FRAUD + "," + BANKRUPT + """,
fw as (select distinct cik, unnest(range(year(fraud_date) - 3, year(fraud_date) + 1)) as year from fraud),
bw as (select distinct cik, unnest(range(year(bankruptcy_date) - 2, year(bankruptcy_date))) as year from bankrupt),
lab0 as (select fe.*, case when fw.cik is null then 0 else 1 end as is_fraud, case when bw.cik is null then 0 else 1 end as is_bankrupt
         from fe left join fw on fe.cik = fw.cik and fe.year = fw.year left join bw on fe.cik = bw.cik and fe.year = bw.year),
lab as (select *, case when is_fraud = 1 then 1 when is_bankrupt = 1 then 2 else 0 end as label,
          case when is_fraud = 1 then 'fraud' when is_bankrupt = 1 then 'bankruptcy' else 'clean' end as label_type from lab0)"""

HOLDOUT = LABELLED + """,
train as (select * from lab where year < 1999),
seen as (select distinct cik from train where is_fraud = 1 or is_bankrupt = 1),
test as (select * from lab where year >= 1999 and (cik not in (select cik from seen) or (is_fraud = 0 and is_bankrupt = 0)))"""


def _bench(label: str, prefix: str = "") -> str:
    """Ranking metrics of three scores as window sums over long scores."""
    return f"""
{prefix}sw as (select cik, year, {label} as y, round({_ALT_RISK}, 9) as a, round({_BEN_RISK}, 9) as b,
         round(0.65::double * ({_ALT_RISK}) + 0.35::double * ({_BEN_RISK}), 9) as c from test),
{prefix}sm as (select quantile_cont(a, 0.5) as ma, quantile_cont(b, 0.5) as mb, quantile_cont(c, 0.5) as mc from {prefix}sw),
{prefix}sl as (select cik, year, y, 'Altman Z-Score' as model, coalesce(a, ma) as score from {prefix}sw, {prefix}sm
       union all select cik, year, y, 'Beneish M-Score', coalesce(b, mb) from {prefix}sw, {prefix}sm
       union all select cik, year, y, 'Blend', coalesce(c, mc) from {prefix}sw, {prefix}sm),
{_metrics(prefix + 'sl', prefix)},
{prefix}bench as (select model, round(auc_roc, 4) as auc_roc, round(auc_pr, 4) as auc_pr, round(recall_at_5pct, 4) as recall_at_5pct,
      round(precision_at_20, 4) as precision_at_20, cast(null as double) as oof_recall_at_5pct, cast(null as double) as oof_precision_at_20,
      n as n_test, n_positive, round(n_positive / n, 4) as positive_rate from {prefix}met)"""


def _metrics(source: str, prefix: str = "") -> str:
    p = prefix
    return f"""
{p}g as (select model, score, count(*) as n, sum(y) as pos from {source} group by model, score),
{p}c as (select *, sum(n) over (partition by model) as tn, sum(pos) over (partition by model) as tp,
        sum(n) over (partition by model order by score) as upto, sum(n) over (partition by model order by score desc) as down,
        sum(pos) over (partition by model order by score desc) as pdown from {p}g),
{p}auc as (select model, cast(max(tn) as bigint) as n, cast(max(tp) as bigint) as n_positive,
          (sum(pos * (upto - n + (n + 1) / 2.0::double)) - max(tp) * (max(tp) + 1) / 2.0::double) / nullif(max(tp) * (max(tn) - max(tp)), 0) as auc_roc,
          sum(pos * (pdown / down::double)) / nullif(max(tp), 0) as auc_pr from {p}c group by model),
{p}thr as (select model, quantile_cont(score, 0.95) as thr from {source} group by model),
{p}rec as (select s.model, sum(case when score >= thr then y else 0 end) / nullif(sum(y), 0)::double as recall_at_5pct
        from {source} s join {p}thr t on s.model = t.model group by s.model),
{p}top as (select model, sum(y) / 20.0::double as precision_at_20 from
        (select *, row_number() over (partition by model order by score desc, cik, year) as rn from {source}) where rn <= 20 group by model),
{p}met as (select {p}auc.*, recall_at_5pct, precision_at_20 from {p}auc join {p}rec on {p}auc.model = {p}rec.model join {p}top on {p}auc.model = {p}top.model)"""


def _pooled(scores: str) -> str:
    """AUC and average precision of the blended score as it was given, missing scores last."""
    return f"""select round((sum(pos * (upto - n + (n + 1) / 2.0::double)) - max(tp) * (max(tp) + 1) / 2.0::double)
          / nullif(max(tp) * (max(tn) - max(tp)), 0), 4) as a, round(sum(pos * (pdown / down::double)) / nullif(max(tp), 0), 4) as p
      from (select n, pos, sum(n) over () as tn, sum(pos) over () as tp, sum(n) over (order by score nulls first) as upto,
              sum(n) over (order by score desc nulls last) as down, sum(pos) over (order by score desc nulls last) as pdown
            from (select c as score, count(*) as n, sum(y) as pos from {scores} group by c))"""


WINDOWS = """,
        yb as (select min(year) as lo, max(year) as hi from cy),
        st as (select unnest(range(lo + 3, hi - 2 + 1 + 1, 2)) as val_from from yb),
        sz as (select val_from, val_from + 1 as val_to, min(year) filter (where year < val_from) as train_first,
                 max(year) filter (where year < val_from) as train_last, count(*) filter (where year < val_from) as n_train,
                 count(*) filter (where year between val_from and val_from + 1) as n_val from st, cy group by val_from)"""

FOLDS = LABELLED + WINDOWS + f""",
wf as (select cast(row_number() over (order by val_from) as int) as fold, * from sz where n_train > 0 and n_val > 0),
given as (select fold, is_fraud as y, cik, year,
            round(coalesce(0.65::double * ({_ALT_RISK}) + 0.35::double * ({_BEN_RISK}), 0), 9) as score,
            round(coalesce({_ALT_RISK}, 0), 9) as xgb_prob, round(coalesce({_BEN_RISK}, 0), 9) as iso_score
          from lab join wf on year between val_from and val_to),
parts as (""" + " union all ".join(f"select cik, year, y, fold || '/{p}' as model, {p} as score from given" for p in ("score", "xgb_prob", "iso_score")) + "),"


def _lift(source: str) -> str:
    return f"""
lr as (select model, y, row_number() over (partition by model order by score desc nulls last, cik, year) as rn,
         sum(y) over (partition by model) as tp, count(*) over (partition by model) as n from {source}),
lc as (select *, sum(y) over (partition by model order by rn) as caught from lr),
cuts as (select range as i, 0.01::double + 0.01::double * range as pct from range(100)),
lift as (select model, round(1.0::double + i, 1) as pct_reviewed, round(coalesce(caught / nullif(tp, 0)::double, 0), 4) as recall
   from lc join cuts on rn = greatest(1, cast(floor(pct * n) as bigint)))"""


ORDER_SCORES = f"""
os as (select o_orderstatus as model, case when starts_with(o_orderpriority, '2') then 100000.0::double
         else floor(o_totalprice / 500) * 500.0::double end as score,
         case when starts_with(o_orderpriority, '1') then 1 else 0 end as y, {cik('o_orderkey')} as cik,
         cast(year(o_orderdate) as int) as year from orders)"""

_LINE_OBS = f"""
obs as (select {cik('o_custkey')} as cik, 'revenue' as concept, l_linenumber % 3 as priority, cast(year(o_orderdate) as int) as year,
          strftime(l_shipdate, '%Y-%m-%d') as filed, strftime(o_orderdate, '%Y-%m-%d') as "end", l_extendedprice as val
        from lineitem join orders on l_orderkey = o_orderkey)"""


def _latest(where: str = "") -> str:
    return _LINE_OBS + f""",
lf as (select cik, concept, priority, year, val as value from (
    select *, row_number() over (partition by cik, priority, year order by filed desc, "end" desc, val desc) as rn from obs {where}) where rn = 1)"""


def _facts(profile: str) -> str:
    every = list(dict.fromkeys(t for tags in [*BULK.values(), *SINGLE.values()] for t in tags))
    wanted = BULK if profile == "bulk" else SINGLE
    rows = ", ".join(f"({every.index(t)}, '{c}', {p})" for c, tags in wanted.items() for p, t in enumerate(tags))
    months = ("date_diff('day', s, e) / 30.44::double" if profile == "bulk"
              else "(year(e) - year(s)) * 12 + month(e) - month(s)")
    return f"""
tagged(idx, concept, priority) as (values {rows}),
fo as (select {cik('o_custkey')} as cik, c_name as company_name, concept, priority, cast(o_orderdate as date) as e,
         case when l_linenumber <> 5 then cast(o_orderdate as date) - cast(270 + (cast(l_quantity as int) % 10) * 20 as int) end as s,
         l_shipdate as filed, l_extendedprice as val
       from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join tagged on l_partkey % {len(every)} = idx
       where l_returnflag <> 'A' and l_suppkey % 10 <> 0),
fa as (select *, cast(year(e) as int) as year from fo where s is null or ({months}) between 10 and 14),
fl as (select * from (select *, row_number() over (partition by cik, concept, priority, year order by cast(filed as date) desc, e desc, val desc) as rn from fa) where rn = 1),
fb as (select *, min(priority) over (partition by cik, concept) as best from fl)
select cik, company_name, concept, year, val as value from fb where priority = best"""


MASTER = """
mast as (select cik, ticker, title from (
  select lpad(cast(c_custkey as varchar), 10, '0') as cik, 'T' || cast(c_custkey % 1000 as varchar) as ticker, c_name as title,
    row_number() over (partition by c_custkey % 1000 order by c_custkey desc) as rn from customer) where rn = 1)"""
WANTED = "wanted as (select distinct 'T' || cast(p_partkey as varchar) as ticker from part)"

_HTML = ("trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({h}, "
         "'<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!doctype[^>]*>', ' ', 'gis'), '<[^>]*>', ' ', 'g'), "
         "'&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\\s+', ' ', 'g'))")

_NAME_WORDS = r"\b(?:inc|corp|llc|ltd|co|corporation|company|holdings|group|international|enterprises|partners)\b"


def _norm(c: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[^\\w\\s]', ' ', 'g'), "
            f"'{_NAME_WORDS}', '', 'g'), '\\s+', ' ', 'g'))")


def _clean(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({c}, '\\s*SIC:\\d+.*$', '', 'gi'), '\\s*/[^/]+/', ' ', 'g'))"


_NOISY = ("upper(c_name) || ' & Holdings, Inc. /' || substr(c_mktsegment, 1, 2) || '/ SIC:' || "
          "cast(c_custkey % 9000 as varchar) || '- Oil'")

_MONTH = "strftime(o_orderdate, '%B %-d, %Y')"
_NUMBER = "cast(1000 + o_orderkey % 9000 as varchar)"


def _fmt(c: str) -> str:
    return f"printf('%.2f', {c})"


def _money(v: str) -> str:
    return f"""case when {v} is null then 'N/A' else (case when {v} < 0 then '-' else '' end) || '$' || case
  when abs({v}) >= 1e12 then printf('%.2f', abs({v}) / 1e12) || 'T' when abs({v}) >= 1e9 then printf('%.2f', abs({v}) / 1e9) || 'B'
  when abs({v}) >= 1e6 then printf('%.1f', abs({v}) / 1e6) || 'M' else format('{{:,}}', cast(round_even(abs({v}), 0) as bigint)) end end"""


def _change(m: str) -> str:
    a = f"all_{m}"
    return (f"case when len({a}) >= 2 then (case when {a}[-1] - {a}[-2] > 0 then '▲' else '▼' end) || ' ' || "
            f"printf('%.1f', (case when {a}[-2] = 0 then 0 else abs(({a}[-1] - {a}[-2]) / {a}[-2]) end) * 100) || '% YoY' else '' end as {m}_change")


def _shown(m: str, kind: str) -> str:
    body = f"printf('%.2f', last_{m}) || 'x'" if kind == "x" else f"printf('%.1f', last_{m} * 100) || '%'"
    return f"case when last_{m} is null then 'N/A' else {body} end as {m}"


_KEY = {"current_ratio": "x", "debt_equity": "x", "net_margin": "p", "cfo_ni_ratio": "x", "gross_margin": "p", "interest_coverage": "x"}
_PCT = lambda c: f"case when {c} is null then '—' else printf('%.1f', {c} * 100) || '%' end as {c}"


def _sorted_name(c: str) -> str:
    return f"array_to_string(list_sort(string_split({_norm(c)}, ' ')), ' ')"


def _ratio_sql(a: str, b: str) -> str:
    """200 * LCS / (len a + len b), the LCS by one bit per character of ``a``, folded over the characters of ``b``."""
    full = f"((1::hugeint << length({a})) - 1)"
    masks = (f"list_transform(string_split({b}, ''), lambda c: list_sum(list_transform(range(1, length({a}) + 1), "
             f"lambda i: case when substr({a}, i, 1) = c then 1::hugeint << (i - 1)::int else 0::hugeint end))::hugeint)")
    left = f"list_reduce(list_prepend({full}, {masks}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})"
    return f"(200.0::double * (length({a}) - bit_count({left})) / (length({a}) + length({b})))"


NAME_MATCH = FRAUD + f""",
acc as (select aaer_no, fraud_date, (case when cast(cik as bigint) % 3 = 0 then replace(company_name, 'stomer', 'stmer')
          when cast(cik as bigint) % 3 = 1 then 'Corp. ' || company_name else upper(company_name) end) || ' Inc.' as raw_aaer_name from fraud),
ent as (select *, {_sorted_name('raw_aaer_name')} as name from acc),
com as (select name, min({{'cik': cik, 'ticker': ticker, 'title': title}}) as c from (
          select {cik('c_custkey')} as cik, 'T' || cast(c_custkey as varchar) as ticker, c_name as title, {_sorted_name('c_name')} as name from customer)
        where name <> '' group by name),
pairs as (select ent.name, com.name as match, com.c, case when ent.name = com.name then 100.0::double else {_ratio_sql('ent.name', 'com.name')} end as ratio
          from (select distinct name from ent) ent, com),
best as (select * from (select *, row_number() over (partition by name order by ratio desc, match) as rn from pairs where ratio >= 82) where rn = 1),
hit as (select c.cik as cik, c.ticker as ticker, c.title as company_name, aaer_no, fraud_date, raw_aaer_name, round(ratio, 1) as match_score
        from ent join best using (name))"""

SEED_RESOLVE = f"""
seed as (select c_custkey as seed_no, c_name as company_name, case when c_custkey % 2 = 0 then 'T' || cast(c_custkey as varchar) else 'GONE' end as ticker,
           make_date(cast(1999 + c_custkey % 3 as int), 6, 15) as bankruptcy_date from customer where c_custkey % 37 = 0),
mas as (select {cik('c_custkey')} as cik, 'T' || cast(c_custkey as varchar) as ticker, c_name as title, c_custkey from customer),
tick as (select seed_no, bankruptcy_date, mas.cik, mas.ticker, mas.title as company_name, 100.0::double as match_score from seed join mas using (ticker)
         where {_ratio_sql(_sorted_name('seed.company_name'), _sorted_name('mas.title'))} >= 60),
rest as (select seed_no, bankruptcy_date, {_sorted_name('company_name')} as name from seed where seed_no not in (select seed_no from tick)),
fil as (select cik, {_clean("title || ' /NEW/SIC:3533- OIL'")} as clean from mas where c_custkey % 2 = 0),
one as (select name, min({{'cik': cik, 'clean': clean}}) as c from (select *, {_sorted_name('clean')} as name from fil) where name <> '' group by name),
pairs as (select rest.seed_no, rest.bankruptcy_date, one.name as match, one.c,
            case when rest.name = one.name then 100.0::double else {_ratio_sql('rest.name', 'one.name')} end as ratio from rest, one),
best as (select * from (select *, row_number() over (partition by seed_no order by ratio desc, match) as rn from pairs where ratio >= 65) where rn = 1),
every as (select * from tick union all select seed_no, bankruptcy_date, c.cik, '', c.clean, 90.0::double from best)"""


def _draw(seed: int) -> str:
    return f"('0x' || substr(md5(cik || '|' || year || '|' || copy || '|{seed}'), 1, 10))::bigint / 1099511627776.0::double"


SMOTE = LABELLED + ",\nmed as (select " + ", ".join(f"quantile_cont({c}, 0.5) as m_{c}" for c in fea.TRAINED) + " from lab)," + f"""
x as (select cik, year, is_fraud as y, [{', '.join(f'coalesce({c}, m_{c}, 0)' for c in fea.TRAINED)}] as v from lab, med),
size as (select count(*) - 2 * sum(y) as new, sum(y) as pos from x),
few as (select *, row_number() over (order by cik, year) - 1 as i from x where y = 1),
plan as (select cik, year, v, unnest(range(1, (((i + 1) * new) // pos - (i * new) // pos)::bigint + 1))::int as copy from few, size),
drawn as (select *, (floor({_draw(42)} * least(5, pos - 1)) + 1)::int as nb, {_draw(43)} as gap from plan, size),
near as (select a.cik, a.year, b.v as z, cast(row_number() over (partition by a.cik, a.year order by
           list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), b.cik, b.year) as int) as nb
         from few a join few b on a.i <> b.i)"""


def _score(g: str, h: str) -> str:
    return f"(greatest(abs({g}) - 0.1::double, 0) * greatest(abs({g}) - 0.1::double, 0) / ({h} + 1.0::double))"


def _best_split(node: int, rows: str) -> str:
    """Node sums and the split of greatest gain among rows of the tree's training data."""
    return f"""
n{node} as (select x.* from tx x where {rows}),
s{node} as (select sum(g) as g, sum(h) as h from n{node}),
b{node} as (select * from (select f, cut, gl, hl, {_score('gl', 'hl')} + {_score('g - gl', 'h - hl')} - {_score('g', 'h')} as gain
      from (select c.f, c.cut, sum(x.g) filter (x.v[c.f] <= c.cut) as gl, sum(x.h) filter (x.v[c.f] <= c.cut) as hl
            from n{node} x, cuts c group by c.f, c.cut), s{node} where hl >= 8 and h - hl >= 8)
      where gain > 1e-6 order by gain desc, f, cut limit 1)"""


#: One tree of depth two over all rows: cuts at eighths, splits by second-order gain, leaves that gain too little pruned.
TREE = SMOTE.split("size as (select count(*) - 2")[0].rstrip().rstrip(",") + f""",
tx as (select cik, year, v, w * (0.5::double - y) as g, w * 0.25::double as h
       from (select *, case when y = 1 then greatest((select (count(*) - sum(y)) // sum(y) from x), 1) else 1 end as w from x)),
names as (select unnest(range(1, {len(fea.TRAINED) + 1})) as f, unnest([{', '.join(f"'{c}'" for c in fea.TRAINED)}]) as feature),
cuts as (select distinct f, unnest(q) as cut from (select f, quantile_cont(z, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) as q
         from (select unnest(range(1, {len(fea.TRAINED) + 1})) as f, unnest(v) as z from tx) group by f)),""" + _best_split(0, "true") + "," + _best_split(
    1, "x.v[(select f from b0)] <= (select cut from b0)") + "," + _best_split(2, "x.v[(select f from b0)] > (select cut from b0)") + """,
cut0 as (select 0 as node, f, cut, gain from b0 union all select 1, f, cut, gain from b1 where gain >= 0.1 union all select 2, f, cut, gain from b2 where gain >= 0.1),
cutting as (select * from cut0 where node > 0 or gain >= 0.1 or (select count(*) from cut0) > 1),
sums as (select 0 as node, g, h from s0 union all select 1, g, h from s1 union all select 2, g, h from s2
         union all select 3, gl, hl from b1 union all select 4, g - gl, h - hl from b1, s1
         union all select 5, gl, hl from b2 union all select 6, g - gl, h - hl from b2, s2),
nodes as (select s.node, i.f, i.cut, coalesce(i.gain, 0) as gain, s.h as cover,
            case when i.f is null then -sign(s.g) * greatest(abs(s.g) - 0.1::double, 0) / (s.h + 1.0::double) * 0.3::double else 0 end as value
          from sums s left join cutting i on s.node = i.node where s.node = 0 or (s.node - 1) // 2 in (select node from cutting)),
walk as (select t.cik, t.year, t.v, case when i.f is null then 0 when t.v[i.f] <= i.cut then 1 else 2 end as half
         from tx t left join cutting i on i.node = 0),
fell as (select w.cik, w.year, w.v, w.half, case when w.half = 0 or i.f is null then w.half when w.v[i.f] <= i.cut then 2 * w.half + 1 else 2 * w.half + 2 end as node
         from walk w left join cutting i on i.node = w.half and w.half > 0)"""

#: A leaf's path holds at most two splits: each one's share of the cover and whether a row passes it.
PATHS = TREE + """,
leaf as (select n.node, n.value, p.node as p1, case when p.node > 0 then 0 end as p0,
                n.cover / p.cover as z1, p.cover / g.cover as z0, n.node % 2 = 1 as left1, p.node % 2 = 1 as left0
         from nodes n join nodes p on p.node = (n.node - 1) // 2 left join nodes g on p.node > 0 and g.node = (p.node - 1) // 2
         where n.f is null and n.node > 0),
step as (select t.cik, t.year, l.value, a.f as f1, b.f as f0, z1, z0,
                ((t.v[a.f] <= a.cut) = left1)::int as o1, ((t.v[b.f] <= b.cut) = left0)::int as o0
         from tx t cross join leaf l join cutting a on a.node = l.p1 left join cutting b on b.node = l.p0),
part as (select cik, year, f1 as f, value * (o1 - z1) as phi from step where f0 is null
         union all select cik, year, f1, value * (o1 * o0 - z1 * z0) from step where f0 = f1
         union all select cik, year, f1, value * (o1 - z1) * (z0 + o0) / 2 from step where f0 <> f1
         union all select cik, year, f0, value * (o0 - z0) * (z1 + o1) / 2 from step where f0 <> f1)"""


def _digest(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 10))::bigint"


def _path(n: str) -> str:
    return f"case when {n} <= 1 then 0.0 when {n} = 2 then 1.0 else 2.0::double * (ln({n} - 1.0::double) + 0.5772156649015329::double) - 2.0::double * ({n} - 1) / {n} end"


def _isolation(trees: int, sample: int, limit: int, seed: int) -> str:
    """A small isolation forest grown level by level, then walked by every row."""
    prime = 2**31 - 1
    width = len(fea.TRAINED)
    ctes = SMOTE.split("size as (select count(*) - 2")[0].rstrip().rstrip(",") + f""",
it as (select unnest(range(0, {trees})) as tree),
tick as (select tree, cik, year, v, (h * greatest(({_digest(f"'{seed}|' || tree || '|factor'")}) % {prime}, 1) + ({_digest(f"'{seed}|' || tree || '|offset'")}) % {prime}) % {prime} as u
         from (select *, ('0x' || substr(md5(cik || '|' || year || '|{seed}'), 1, 7))::bigint as h from x), it),
g0 as (select tree, v, 0 as node from (select *, row_number() over (partition by tree order by u, cik, year) as rk from tick) where rk <= {sample}),
q0 as (select tree, cik, year, v, 0 as node from x, it)"""
    for level in range(limit):
        ctes += f""",
r{level} as (select tree, node, any_value(n) as n, list(f order by f) as fs, list(lo order by f) as los, list(hi order by f) as his from (
        select tree, node, f, min(z) as lo, max(z) as hi, count(*) as n from (
          select tree, node, unnest(range(1, {width + 1})) as f, unnest(v) as z from g{level} where node >= {2**level - 1}) group by all) where hi > lo group by tree, node),
o{level} as (select tree, node, fs[p] as f, case when los[p] + w * (his[p] - los[p]) >= his[p] then los[p] else los[p] + w * (his[p] - los[p]) end as cut from (
        select *, 1 + floor({_digest(f"'{seed}|' || tree || '|' || node || '|feature'")} / 1099511627776.0::double * len(fs))::int as p,
               {_digest(f"'{seed}|' || tree || '|' || node || '|cut'")} / 1099511627776.0::double as w from r{level} where n > 1)),
""" + ",\n".join(
            f"{t}{level + 1} as (select {keep}, a.v, case when o.f is null then a.node when a.v[o.f] <= o.cut then 2 * a.node + 1 else 2 * a.node + 2 end as node "
            f"from {t}{level} a left join o{level} o on a.tree = o.tree and a.node = o.node)"
            for t, keep in (("g", "a.tree"), ("q", "a.tree, a.cik, a.year")))
    return ctes + f""",
grown as (select tree, node, count(*) as n from g{limit} group by all),
deep as (select q.cik, q.year, avg(floor(log2(q.node + 1)) + {_path('n')}) as depth from q{limit} q join grown using (tree, node) group by q.cik, q.year)"""


def _facts_panel() -> str:
    """Company-years as the single profile reads them from filings, under the names of the panel."""
    # table names of their own, as the report has an fl as well
    picked = re.sub(r"\b(fo|fa|fl|fb)\b", r"q\1", _facts("single").rsplit("select cik, company_name, concept", 1)[0])
    held = ", ".join(
        f"max(case when concept = '{c}' then val end)::double as {c}" if c in SINGLE else f"null::double as {c}" for c in CONCEPTS)
    return f"""{picked},
cy as (select cik, 'T' || cast(cast(cik as bigint) as varchar) as ticker, min(company_name) as company_name, year, {held}
       from qfb where priority = best group by cik, year)"""


FACTS_PANEL = _facts_panel()
_NO_CAPS = "from customer where c_acctbal > 0"
_LABELS_OF = "(values " + ", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in FEATURE_LABELS.items()) + ") as t(feature, label)"


def _w(ctes: str, body: str) -> str:
    return f"with {ctes.strip()}\n{body}"


_RATIO_ROUNDED = ", ".join(c if c in ("total_debt", "revenue", "cfo", "net_income") else f"round({c}, 6) as {c}" for c in RATIOS)


def _family(columns) -> str:
    return _w(FEATURES, f"select cik, year, {r6(columns)} from fe")


_FOLD_ROWS = """,
fm as (select fold, cast(train_first as varchar) || '–' || cast(train_last as varchar) as train_years,
         cast(val_from as varchar) || '–' || cast(val_to as varchar) as val_years, n_train, max(n) as n_val, max(n_positive) as n_fraud_val, """ + ", ".join(
    f"round(max(case when model = fold || '/{p}' then {c} end), 4) as {name}" for p, c, name in (
        ("score", "auc_roc", "auc_roc"), ("score", "auc_pr", "auc_pr"), ("xgb_prob", "auc_roc", "auc_roc_xgb"), ("iso_score", "auc_roc", "auc_roc_iso"))) + """
       from wf join met on model like fold || '/%' group by all having max(n_positive) >= 2)"""


SQL: dict[str, str] = {
    "company_year_wide": _w(PANEL, "select * from cy"),
    "company_year_long": _w(PANEL + "," + LONG, "select cik, ticker, company_name, year, concept, value from raw"),
    "min_years_filter": _w(PANEL + "," + LONG, "select cik, ticker, company_name, year, concept, value from raw "
                           "where cik in (select cik from raw group by cik having count(distinct year) >= 6)"),
    "series_align": _w(PANEL, "select cik, year, cfo as v0, capex as v1, cash as v2 from cy "
                       "where cfo is not null and capex is not null and cash is not null"),
    "ratio_panel": _w(RATIO, f"select cik, year, {_RATIO_ROUNDED} from rat"),
    "ratio_growth": _w(RATIO, f"select cik, year, {r6(GROWTH)} from rat"),
    "latest_filed_dedupe": _w(_latest(), "select cik, priority, year, value from lf"),
    "latest_filed_as_of": _w(_latest("where filed <= '1998-06-30'"), "select cik, priority, year, value from lf"),
    "tag_priority_pick": _w(_latest(), "select cik, concept, year, value from lf where priority = (select min(priority) from lf b where b.cik = lf.cik)"),
    "tag_priority_per_year": _w(_latest(), "select cik, concept, year, value from lf "
                                "where priority = (select min(priority) from lf b where b.cik = lf.cik and b.year = lf.year)"),
    "facts_extract_bulk": _w(_facts("bulk"), ""),
    "facts_extract_single": _w(_facts("single"), ""),
    "ticker_master": _w(MASTER, "select cik, ticker, title from mast"),
    "universe_fallback": _w(MASTER, "select distinct ticker from mast order by ticker"),
    "universe_first": _w(MASTER, "select ticker from (select ticker from mast order by cik desc, ticker limit 100) order by ticker"),
    "universe_union": "select distinct ticker from (select 'BRK-' || cast(c_custkey as varchar) as ticker from customer union all "
                      "select 'S-' || cast(s_suppkey as varchar) from supplier where s_suppkey % 5 <> 0)",
    "ticker_lookup": _w(MASTER + "," + WANTED, "select ticker, cik from wanted join mast using (ticker)"),
    "fetch_status": _w(PANEL + "," + MASTER + "," + WANTED, """
        select status, count(*) as n from (
          select case when m.cik is null then 'no_cik' when y.n is null then 'no_facts' when y.n < 6 then 'low_data' else 'used' end as status
          from wanted w left join mast m on w.ticker = m.ticker
          left join (select cik, count(distinct year) as n from cy group by cik) y on m.cik = y.cik) group by status"""),
    "augment_missing": _w(PANEL + "," + LONG + "," + FRAUD, """
        select cik, count(*) as n, count(distinct year) as years from raw where cast(cik as bigint) % 3 <> 0
          or (cik in (select cik from fraud) and cik in (select cik from raw group by cik having count(distinct year) >= 2)) group by cik"""),
    "feat_ratio": _family(fea.RATIO), "feat_yoy": _family(fea.YOY), "feat_trend": _family(fea.TREND),
    "feat_interaction": _family(fea.INTERACTION), "feat_accrual": _family(fea.ACCRUAL),
    "feat_beneish": _family(fea.BENEISH), "feat_altman": _family(fea.ALTMAN),
    "feat_winsor": _w(FEATURES + ",\nqs as (select " + ", ".join(
        f"quantile_cont({c}, 0.01) as lo_{c}, quantile_cont({c}, 0.99) as hi_{c}" for c in fea.FEATURES) + " from fe)",
        "select cik, year, " + ", ".join(
            f"round(case when {c} is not null then least(greatest({c}, lo_{c}), hi_{c}) end, 6) as {c}" for c in fea.FEATURES) + " from fe, qs"),
    "completeness": _w(FEATURES + ",\ncomp as (select " + ", ".join(f"round(count({c}) * 100.0::double / count(*), 6) as {c}" for c in fea.FEATURES) + " from fe)",
                       "select feature, pct from (unpivot comp on " + ", ".join(fea.FEATURES) + " into name feature value pct)"),
    "altman_latest": _w(SIGNALS, "select cik, round(altman_z, 6) as altman_z, case when altman_z < 1.81 then 'Distress Zone' "
                        "when altman_z < 2.99 then 'Grey Zone' when altman_z is not null then 'Safe Zone' end as zone from sig"),
    "beneish_latest": _w(SIGNALS, "select cik, round(beneish_m, 6) as beneish_m, case when beneish_m > -2.22 then 'Likely Manipulator' "
                         "when beneish_m is not null then 'Non-Manipulator' end as class from sig"),
    "altman_risk": _w(FEATURES, f"select cik, year, round({_Z}, 6) as z, round({_ALT_RISK}, 6) as risk from fe"),
    "beneish_risk": _w(FEATURES, f"select cik, year, round({_M}, 6) as m, round({_BEN_RISK}, 6) as risk from fe"),
    "composite_score": _w(SCORES, f"select cik, {', '.join(WEIGHTS)}, overall, label, color from sc"),
    "composite_score_trend": _w(_scores(True), f"select cik, {', '.join(WEIGHTS)}, overall, label, color from sc"),
    "health_rank_top20": _w(SCORES, "select cik, company_name, overall, label from sc order by overall, cik limit 20"),
    "flags_long": _w(FLAGS, "select * from fl"),
    "flags_sorted": _w(FLAGS, """select cik, place, rule_no, severity from (select *, cast(row_number() over (partition by cik order by
        case severity when 'HIGH' then 0 when 'MEDIUM' then 1 else 2 end, rule_no) as int) as place from fl) where place <= 3"""),
    "gap_growth": _w(GAP_SIGNALS, f"select cik, {r6(('last_revenue_growth', 'last_cfo_growth', 'last_total_assets'))} from sig"),
    "gap_flags": _w(GAP_FLAGS, "select cik, rule_no, title, detail from fl"),
    "gap_scores": _w(SCORES.replace(PANEL, GAP_PANEL), f"select cik, {', '.join(WEIGHTS)}, overall, label from sc"),
    "flags_by_severity": _w(FLAGS, f"select cik, {SEVERITY_COUNTS} from fl group by cik"),
    "flags_by_category": _w(FLAGS, """select cik, category, string_agg(title, ' | ' order by
        case severity when 'HIGH' then 0 when 'MEDIUM' then 1 else 2 end, rule_no) as titles from fl group by cik, category"""),
    "indexed_series": _w(RATIO + ",\nix as (select cik, year, " + ", ".join(
        f"{c} / coalesce(nullif(abs(first_value({c} ignore nulls) over ({W})), 0), 1) as i_{c}" for c in ("revenue", "cfo", "net_income")) + " from rat)",
        " union all ".join(f"select cik, year, '{c}' as series, round(i_{c}, 6) as value from ix where i_{c} is not null" for c in ("revenue", "cfo", "net_income"))),
    "ratio_trend_long": _w(RATIO, " union all ".join(
        f"select cik, year, '{c}' as metric, round({c}, 6) as value from rat where {c} is not null"
        for c in ("current_ratio", "net_margin", "gross_margin", "cfo_revenue", "roe", "interest_coverage"))),
    "fcf_split": _w(SIGNALS, """select cik, 'Operating CFO' as item, round(coalesce(last_cfo, 0) / 1e9, 9) as billions from sig
        union all select cik, 'CapEx', round(-abs(coalesce(last_capex, 0)) / 1e9, 9) from sig
        union all select cik, 'FCF', round((coalesce(last_cfo, 0) - abs(coalesce(last_capex, 0))) / 1e9, 9) from sig"""),
    "de_band": _w(RATIO, "select cik, year, round(debt_equity, 6) as debt_equity, case when debt_equity > 2 then 'red' "
                  "when debt_equity > 1 then 'amber' else 'green' end as band from rat where debt_equity is not null"),
    "score_parts": _w(SCORES, " union all ".join(
        f"select cik, '{c}' as category, {c} as score, case when {c} >= 75 then 'green' when {c} >= 55 then 'amber' when {c} >= 35 then 'orange' else 'red' end as color from sc"
        for c in WEIGHTS)),
    "ratio_display": _w(RATIO, "select cik, year, " + ", ".join(_PCT(c) for c in ("current_ratio", "gross_margin", "roe", "revenue_growth", "cfo_ni_ratio")) + " from rat"),
    "gauges": _w(SIGNALS, """select cik, round(altman_z, 6) as altman_z, case when altman_z < 1.81 then 'Distress Zone'
        when altman_z < 2.99 then 'Grey Zone' when altman_z is not null then 'Safe Zone' end as altman_zone,
        case when altman_z is not null then round(greatest(-2, least(altman_z, 6)), 6) end as altman_shown,
        round(beneish_m, 6) as beneish_m, case when beneish_m > -2.22 then 'Likely Manipulator' when beneish_m is not null then 'Non-Manipulator' end as beneish_class,
        case when beneish_m is not null then round(greatest(-5, least(beneish_m, 1)), 6) end as beneish_shown from sig"""),
    "report_header": _w(FLAGS + SCORES[len(SIGNALS):] + f",\nfc as (select cik, {SEVERITY_COUNTS} from fl group by cik)", f"""
        select sc.cik, ticker, company_name, {_money('market_cap')} as market_cap,
          overall, label, color, round(altman_z, 6) as altman_z, round(beneish_m, 6) as beneish_m,
          {', '.join(_shown(m, k) + ', ' + _change(m) for m, k in _KEY.items())},
          coalesce(high_flags, 0) as high_flags, coalesce(medium_flags, 0) as medium_flags, coalesce(low_flags, 0) as low_flags,
          coalesce(high_flags, 0) = 0 and coalesce(medium_flags, 0) = 0 as clean
        from sc left join fc on sc.cik = fc.cik"""),
    "metric_format": f"""select c_custkey, {_money('v')} as money, printf('%.1f', c_acctbal / 7000 * 100) || '%' as pct, printf('%.2f', c_acctbal / 300) || 'x' as times
        from (select *, case c_custkey % 4 when 0 then c_acctbal when 1 then c_acctbal * 1e3 when 2 then c_acctbal * 1e6 else c_acctbal * 1e9 end as v from customer)""",
    "label_fraud_window": _w(LABELLED, "select cik, year, is_fraud from lab"),
    "label_bankrupt_window": _w(LABELLED, "select cik, year, is_bankrupt from lab"),
    "label_gone_dark": _w(FEATURES + """,
        gd as (select *, row_number() over (partition by cik order by year desc) as rn, max(year) over () as top from fe),
        gh as (select cik from gd where rn <= 2 group by cik having max(year) <= max(top) - 3 and
          cast(coalesce(bool_or(f_current_ratio < 1.0), false) as int) + cast(coalesce(bool_or(f_debt_assets > 0.8), false) as int)
          + cast(coalesce(bool_or(f_net_margin < 0), false) as int) + cast(coalesce(bool_or(f_cfo_ni < 0), false) as int)
          + cast(coalesce(bool_or(f_z_x1 < 0), false) as int) >= 2)""",
        "select cik, year, case when rn <= 2 and cik in (select cik from gh) then 1 else 0 end as is_bankrupt from gd"),
    "label_unified_dist": _w(LABELLED, "select label_type, count(*) as n from lab group by label_type"),
    "firm_year_label_join": _w(PANEL + f""",
        fy as (select {cik('o_custkey')} as cik, cast(year(o_orderdate) as int) as year, max(case when o_totalprice > 300000 then 1 else 0 end) as is_fraud
               from orders group by all)""",
        "select cy.cik, cy.year, coalesce(is_fraud, 0) as is_fraud from cy left join fy on cy.cik = fy.cik and cy.year = fy.year"),
    "holdout_split_counts": _w(HOLDOUT, " union all ".join(
        f"select '{s}' as side, count(*) as n, cast(sum(is_fraud) as bigint) as fraud, cast(sum(is_bankrupt) as bigint) as bankrupt, count(distinct cik) as companies from {s}"
        for s in ("train", "test"))),
    "walk_forward_folds": _w(PANEL + WINDOWS,
        """select row_number() over (order by val_from) as fold, cast(val_from as int) as val_from, cast(val_to as int) as val_to, train_first, train_last,
           n_train, n_val, cast(train_first as varchar) || '–' || cast(train_last as varchar) as train_years from sz where n_train > 0 and n_val > 0"""),
    "run_summary": _w(LABELLED, f"""select count(distinct cik) as companies, count(distinct year) as years, min(year) as first_year, max(year) as last_year,
        count(*) as rows, {len(fea.FEATURES)} as features, cast(sum(is_fraud) as bigint) as fraud, cast(sum(is_bankrupt) as bigint) as bankrupt,
        count(*) filter (where label = 0) as clean, round(sum(is_fraud) * 100.0::double / count(*), 6) as fraud_pct,
        round(sum(is_bankrupt) * 100.0::double / count(*), 6) as bankrupt_pct,
        round(count(*) filter (where label = 0) * 100.0::double / count(*), 6) as clean_pct from lab"""),
    "label_diagnostics": _w(PANEL + "," + FRAUD, """
        select f.cik, cast(year(fraud_date) as int) as fraud_year, cast(count(*) as int) as years_on_file,
          cast(count(*) filter (where c.year between year(fraud_date) - 3 and year(fraud_date)) as int) as matching_years
        from fraud f join cy c on f.cik = c.cik group by f.cik, fraud_date"""),
    "label_overlap": _w(PANEL + "," + FRAUD, """
        select 'raw' as form, count(*) as n from (select distinct cik from cy) a join (select distinct cast(cast(cik as bigint) as varchar) as cik from fraud) b using (cik)
        union all select 'padded', count(*) from (select distinct cik from cy) a join (select distinct cik from fraud) b using (cik)"""),
    "rank_metrics": _w(ORDER_SCORES + "," + _metrics("os"), "select model, n, n_positive, round(auc_roc, 6) as auc_roc, round(auc_pr, 6) as auc_pr, "
                       "round(recall_at_5pct, 6) as recall_at_5pct, round(precision_at_20, 6) as precision_at_20 from met"),
    "lift_orders": _w(ORDER_SCORES + "," + _lift("os"), "select * from lift"),
    "benchmark_fraud": _w(HOLDOUT + "," + _bench("is_fraud"), "select * from bench"),
    "benchmark_distress": _w(HOLDOUT + "," + _bench("is_bankrupt"), "select * from bench"),
    "lift_curve": _w(HOLDOUT + "," + _bench("is_fraud") + """,
        raws as (select cik, year, y, 'Altman Z-Score' as model, a as score from sw union all select cik, year, y, 'Beneish M-Score', b from sw
                 union all select cik, year, y, 'Blend', c from sw),""" + _lift("raws"), "select * from lift"),
    "recall_at_review": _w(HOLDOUT + "," + _bench("is_fraud") + """,
        raws as (select cik, year, y, 'Altman Z-Score' as model, a as score from sw union all select cik, year, y, 'Beneish M-Score', b from sw
                 union all select cik, year, y, 'Blend', c from sw),""" + _lift("raws"), "select model, recall from lift where pct_reviewed = 5.0"),
    "fold_metrics": _w(FOLDS + _metrics("parts") + _FOLD_ROWS, "select * from fm"),
    "fold_statistics": _w(FOLDS + _metrics("parts") + _FOLD_ROWS,
                          "select round(avg(auc_roc), 6) as auc_roc_mean, round(stddev_samp(auc_roc), 6) as auc_roc_std from fm"),
    "evaluation_summary": _w(HOLDOUT + "," + _bench("is_fraud", "f_") + "," + _bench("is_bankrupt", "d_"),
        " union all ".join(
            f"select '{task}' as task, model, auc_roc, auc_pr, precision_at_20, recall_at_5pct, case when model = 'Blend' then o.a end as oof_auc_roc, "
            f"case when model = 'Blend' then o.p end as oof_auc_pr from {p}_bench, ({_pooled(p + '_sw')}) o"
            for task, p in (("fraud", "f"), ("distress", "d")))),
    "class_weight": _w(LABELLED, " union all ".join(
        f"select '{t}' as target, cast(sum({t}) as bigint) as pos, round((count(*) - sum({t})) / greatest(sum({t}), 1)::double, 6) as weight from lab"
        for t in ("is_fraud", "is_bankrupt"))),
    "page_links": """select page_id, case when starts_with(h, '/') then 'https://www.sec.gov' || h else h end as url from
        (select page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*?href\\s*=\\s*"([^"]*)"[^>]*>(.*?)</a>', 1, 'is')) as h from pages)""",
    "page_text": f"select page_id, {_HTML.format(h='html')} as text from pages",
    "index_entries": f"""select o_orderkey as page_id, 'link' as kind, 'https://example.org/aaer/' || {_NUMBER} as url, o_orderstatus as raw_text from orders
        union all select o_orderkey, 'row', 'https://www.sec.gov/lit/' || {_NUMBER} || '.htm',
          'AAER-' || {_NUMBER} || ' ' || {_MONTH} || ' In the Matter of ' || c_name || ', Respondent' from orders join customer on o_custkey = c_custkey""",
    "release_parse": f"""select aaer_no, fraud_date, raw_name, url from (
        select cast(1000 + o_orderkey % 9000 as int) as aaer_no, cast(o_orderdate as date) as fraud_date, c_name as raw_name, '/r/' || {_NUMBER} as url,
          row_number() over (partition by 1000 + o_orderkey % 9000 order by o_orderkey) as rn from orders join customer on o_custkey = c_custkey) where rn = 1""",
    "name_match": _w(NAME_MATCH, """select cik, ticker, company_name, aaer_no, fraud_date, raw_aaer_name, match_score from (
        select *, row_number() over (partition by cik order by match_score desc, aaer_no, fraud_date, raw_aaer_name) as rn from hit) where rn = 1"""),
    "seed_resolve": _w(SEED_RESOLVE, """select cik, ticker, company_name, bankruptcy_date, match_score from (
        select *, row_number() over (partition by cik order by seed_no) as rn from every) where rn = 1"""),
    "boost_tree": _w(TREE, """select node::int as node, feature, round(cut, 6) as threshold, round(gain, 6) as gain, round(cover, 6) as cover, round(value, 6) as value
        from nodes left join names using (f)"""),
    "boost_margins": _w(TREE, "select cik, year, round(value, 6) as margin from fell join nodes using (node)"),
    "tree_attribution": _w(PATHS, "select cik, year, feature, round(sum(phi), 6) as phi from part join names using (f) group by cik, year, feature"),
    "iso_small": _w(_isolation(3, 16, 4, 7), f"select cik, year, round(pow(2.0::double, -depth / ({_path('16')})), 6) as anomaly from deep"),
    "model_scores": _w(TREE + "," + _isolation(3, 16, 4, 7).split("it as (select unnest")[1].join(["it as (select unnest", ""]) + f""",
raws as (select cik, year, pow(2.0::double, -depth / ({_path('256')})) as a from deep),
ends as (select min(a) as lo, max(a) as hi from raws),
blended as (select r.cik, r.year, 1 / (1 + exp(-n.value)) as p, (a - lo) / (hi - lo) as i from raws r, ends, fell f join nodes n using (node) where f.cik = r.cik and f.year = r.year)""",
        "select cik, year, round(0.65::double * p + 0.35::double * i, 6) as score, round(p, 6) as xgb_prob, round(i, 6) as iso_score from blended"),
    "stored_tree": _w(TREE, "select cik, year, round(value, 6) as margin from fell join nodes using (node)"),
    "tree_importance": _w(PATHS, f"""select row_number() over (order by mean_shap desc, feature) as rank, feature, label, round(mean_shap, 5) as mean_shap from (
        select n.feature, coalesce(m.mean, 0) as mean_shap from names n left join (
          select f, sum(abs(phi)) / (select count(*) from tx) as mean from (select cik, year, f, sum(phi) as phi from part group by all) group by f) m using (f))
        join {_LABELS_OF} using (feature) order by mean_shap desc, feature limit 20"""),
    "tree_top3": _w(PATHS, f"""select cik, year, label as name, feature as feature_key, round(phi, 4) as shap_value, round(z, 4) as feature_val,
          case when phi > 0 then 'increases_risk' else 'decreases_risk' end as direction, printf('%.1f', abs(phi) * 100) || '%' as impact_pct
        from (select *, row_number() over (partition by cik, year order by abs(phi) desc, f) as place from (
          select t.cik, t.year, n.f, n.feature, t.v[n.f] as z, coalesce(p.phi, 0) as phi from tx t cross join names n left join (
            select cik, year, f, sum(phi) as phi from part group by all) p on p.cik = t.cik and p.year = t.year and p.f = n.f))
        join {_LABELS_OF} using (feature) where place <= 3"""),
    "feature_names": _w(FEATURES + ",\ncomp as (select " + ", ".join(f"round(count({c}) * 100.0::double / count(*), 6) as {c}" for c in fea.FEATURES) + " from fe)",
                        "select feature, coalesce(label, feature) as label, pct from (unpivot comp on " + ", ".join(fea.FEATURES) + f""" into name feature value pct)
                         left join {_LABELS_OF} using (feature)"""),
    "stored_raw": _w("rawf as (with " + _facts("bulk").strip() + ")", """select cik, 'T' || cast(cast(cik as bigint) as varchar) as ticker, company_name, year, concept, value
        from rawf where cast(cik as bigint) % 3 = 0 and value > 0 and cik in (select cik from rawf group by cik having count(distinct year) >= 3)"""),
    "stored_version": _w(PANEL + "," + LONG, "select cik, ticker, company_name, year, concept, value from raw"),
    "stored_features": _family(fea.RATIO),
    "stored_labelled": _w(LABELLED, "select cik, year, label, label_type from lab"),
    "label_file": _w(FRAUD, "select cik, ticker, company_name, aaer_no, fraud_date, 100.0::double as match_score from fraud"),
    "results_file": _w(FEATURES + ",\ncomp as (select " + ", ".join(f"round(count({c}) * 100.0::double / count(*), 6) as {c}" for c in fea.FEATURES) + " from fe)",
                       "select feature, pct from (unpivot comp on " + ", ".join(fea.FEATURES) + " into name feature value pct)"),
    "seed_labels": """select cast(row_number() over (order by n_nationkey) - 1 as int) as seed_no, n_name as company_name, cast(1990 + n_nationkey as int) as year,
        null::varchar as ticker, make_date(cast(1990 + n_nationkey as int), 12, 31) as fraud_date from nation""",
    "column_tolerance": _w(PANEL, "select cik, year, cash, null::double as inventory, 1.5::double as goodwill from cy"),
    "revenue_change": _w(PANEL, f"select cik, year, round((revenue - lag(revenue) over ({W})) / nullif(abs(lag(revenue) over ({W})), 0), 6) as change from cy"),
    "single_profile": _w(FACTS_PANEL, f"select cik, ticker, company_name, year, {', '.join(CONCEPTS)} from cy"),
    "fraud_label_sources": _w(SEED_RESOLVE, f"""select 'firm_years' as source, cik, '' as ticker, '' as company_name, null::int as aaer_no,
          make_date(min(year), 12, 31) as fraud_date, 100.0::double as match_score from (
            select {cik('o_custkey')} as cik, cast(year(o_orderdate) as int) as year from orders where o_totalprice > 300000) group by cik
        union all select 'seeds', cik, ticker, company_name, null, bankruptcy_date, match_score from (
          select *, row_number() over (partition by cik order by seed_no) as rn from every) where rn = 1"""),
    "stream_refresh": None,
    "smote_rows": _w(SMOTE, """select cik, year, copy, nb, round(gap, 6) as gap, round(v[1] + gap * (z[1] - v[1]), 6) as f_current_ratio
        from drawn join near using (cik, year, nb)"""),
    "name_normalise": f"""select c_custkey, {_clean(_NOISY)} as clean, {_norm(_clean(_NOISY))} as name,
        array_to_string(list_sort(string_split({_norm("('the Zeta ' || " + _NOISY + ")")}, ' ')), ' ') as sorted_name from customer""",
}

# the report of the panel, over what the stream's filings say and without market values
SQL["stream_refresh"] = SQL["report_header"].replace(PANEL.strip(), FACTS_PANEL.strip()).replace(_NO_CAPS, _NO_CAPS + " and false")
