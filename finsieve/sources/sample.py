"""Company-year tables derived from an orders/lineitem warehouse.

Each customer plays a company, each order year a fiscal year, and every
accounting concept is an exact sum over the line items of that year. Amounts
are added as integers (cents, and cents times hundredths), so sums are exact
and independent of partitioning; decimals appear only on the aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONCEPTS = (
    "total_assets", "current_assets", "total_liabilities", "current_liabilities", "equity",
    "retained_earnings", "cash", "receivables", "inventory", "goodwill", "intangibles",
    "revenue", "gross_profit", "cogs", "operating_income", "net_income", "interest_expense",
    "da", "sga", "rd_expense", "tax_expense", "cfo", "cfi", "cff", "capex",
    "long_term_debt", "short_term_debt",
)

# partial sums: name -> (measure, row condition); p price, pd price*discount, pt price*tax
_SUMS = {
    "p": ("p", None), "pd": ("pd", None), "pt": ("pt", None),
    "p_a": ("p", "f = 'A'"), "p_not_a": ("p", "f <> 'A'"),
    "p_not_r": ("p", "f <> 'R'"), "p_n": ("p", "f = 'N'"),
    "p_o": ("p", "s = 'O'"), "p_f": ("p", "s = 'F'"), "p_rf": ("p", "f = 'R' and s = 'F'"),
    "p_d0": ("p", "d = 0"), "p_d5": ("p", "d = 5"), "p_t0": ("p", "t = 0"),
    "p_1": ("p", "n = 1"), "p_2": ("p", "n = 2"),
    "pd_a": ("pd", "f = 'A'"), "pd_not_a": ("pd", "f <> 'A'"), "pd_o": ("pd", "s = 'O'"),
    "pd_not_f": ("pd", "s <> 'F'"), "pd_d8": ("pd", "d >= 8"),
    "pt_not_a": ("pt", "f <> 'A'"), "pt_not_r": ("pt", "f <> 'R'"), "pt_f": ("pt", "s = 'F'"),
    "pt_nf": ("pt", "f = 'N' and s = 'F'"),
}

# concept -> exact combination of the partial sums
_COMBINE = {
    "total_assets": "2 * p + pd",
    "current_assets": "p_not_r + pt_not_r",
    "total_liabilities": "p + 5 * pd",
    "current_liabilities": "p_o - pd_o",
    "equity": "0.5 * p - 6 * pd",
    "retained_earnings": "0.4 * coalesce(p_a, 0) - coalesce(pt_not_a, 0)",
    "cash": "pt_nf",
    "receivables": "p_o",
    "inventory": "p_rf",
    "goodwill": "0.2 * p_d0",
    "intangibles": "0.1 * p_t0",
    "revenue": "p",
    "gross_profit": "p_a",
    "cogs": "p_not_a",
    "operating_income": "coalesce(p_a, 0) - 5 * coalesce(pd_not_a, 0)",
    "net_income": "coalesce(p_a, 0) - coalesce(pd_a, 0) - 6 * coalesce(pt_not_a, 0)",
    "interest_expense": "pd_d8",
    "da": "0.05 * p_f",
    "sga": "pt_f",
    "rd_expense": "0.1 * p_d5",
    "tax_expense": "pt",
    "cfo": "3 * coalesce(pt_f, 0) - coalesce(pd_not_f, 0)",
    "cfi": "-pt",
    "cff": "pd - 0.05 * p",
    "capex": "-0.1 * p_n",
    "long_term_debt": "0.7 * p_1",
    "short_term_debt": "0.3 * p_2",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cik_of(key: str):
    """Zero-padded ten-character company key."""
    text = F.col(key).cast("string")
    return F.when(F.length(text) >= 10, text).otherwise(F.lpad(text, 10, "0"))


def company_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide ``(cik, ticker, company_name, year, 27 concepts)``, one row per company-year.

    Line items are summed map-side per (customer, year) before the shuffle, and
    names join after the aggregation. A hot customer therefore shrinks to one
    partial row per task and year.
    """
    items = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as orderkey",
        "cast(round(l_extendedprice * 100) as bigint) as p",
        "cast(round(l_discount * 100) as int) as d",
        "cast(round(l_tax * 100) as int) as t",
        "l_returnflag as f", "l_linestatus as s", "l_linenumber as n",
    ).selectExpr("*", "p * d as pd", "p * t as pt")
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as orderkey", "o_custkey as custkey", "year(o_orderdate) as year"
    )
    sums = [
        F.expr(f"sum({measure if cond is None else f'case when {cond} then {measure} end'}) as {name}")
        for name, (measure, cond) in _SUMS.items()
    ]
    summed = items.join(orders, "orderkey").groupBy("custkey", "year").agg(*sums)
    exact = summed.selectExpr(
        "custkey", "year",
        *[f"cast({name} as decimal(20,0)) * {'0.01BD' if m == 'p' else '0.0001BD'} as {name}" for name, (m, _) in _SUMS.items()],
    )
    combined = exact.selectExpr(
        "custkey", "year", *[f"double({expr}) as {concept}" for concept, expr in _COMBINE.items()]
    )
    names = table(spark, sf_dir, "customer").selectExpr("c_custkey as custkey", "c_name as company_name")
    return combined.join(names, "custkey").select(
        cik_of("custkey").alias("cik"),
        F.concat(F.lit("T"), F.col("custkey").cast("string")).alias("ticker"),
        "company_name", "year", *CONCEPTS,
    )


def raw_financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long ``(cik, ticker, company_name, year, concept, value)``; absent values have no row."""
    wide = company_panel(spark, sf_dir)
    return wide.unpivot(
        ["cik", "ticker", "company_name", "year"], list(CONCEPTS), "concept", "value"
    ).filter("value is not null")


def fraud_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in debt play enforcement cases."""
    return table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(
        cik_of("c_custkey").alias("cik"),
        F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("ticker"),
        F.col("c_name").alias("company_name"),
        (F.lit(1000) + F.col("c_custkey") % 9000).cast("int").alias("aaer_no"),
        F.make_date((F.lit(1998) + F.col("c_custkey") % 4).cast("int"), F.lit(12), F.lit(31)).alias("fraud_date"),
        F.lit(100.0).alias("match_score"),
    )


def bankruptcy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 37th customer plays a Chapter 11 filer."""
    return table(spark, sf_dir, "customer").filter("c_custkey % 37 = 0").select(
        cik_of("c_custkey").alias("cik"),
        F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("ticker"),
        F.col("c_name").alias("company_name"),
        F.make_date((F.lit(1999) + F.col("c_custkey") % 3).cast("int"), F.lit(6), F.lit(15)).alias("bankruptcy_date"),
        F.lit(100.0).alias("match_score"),
    )
