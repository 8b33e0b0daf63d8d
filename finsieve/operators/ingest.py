"""From annual observations to the long company-year table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finsieve.functions.text import clean_ticker, pad_cik


def latest_filed(obs: DataFrame, as_of: str | None = None) -> DataFrame:
    """Most recently filed value per (cik, concept, priority, year).

    ``as_of`` drops later filings (point-in-time view). Ties in the filing
    date go to the later period end, then to the larger value. Repeats of a
    key combine inside each task before the one exchange, so a company with
    very many observations leaves a task as one row per key.
    """
    if as_of is not None:
        obs = obs.filter(F.col("filed") <= as_of)
    entry = F.struct(
        F.coalesce("filed", F.lit("")).alias("filed"), F.coalesce("end", F.lit("")).alias("end"),
        F.col("val").alias("val"), "company_name",
    )
    best = obs.groupBy("cik", "concept", "priority", "year").agg(F.max(entry).alias("e"))
    return best.select("cik", "concept", "priority", "year", F.col("e.val").alias("value"), "e.company_name")


def pick_tags(filed: DataFrame, tag_policy: str = "per_company") -> DataFrame:
    """One tag per company and concept: the most preferred with any annual value.

    ``per_year`` picks the most preferred tag year by year instead. Input is
    already one row per (cik, concept, tag, year), so groups are short.
    """
    if tag_policy == "per_year":
        return filed.groupBy("cik", "concept", "year").agg(
            F.min_by("value", "priority").alias("value"), F.max("company_name").alias("company_name")
        )
    # a company and concept holds at most tags x years rows here
    best = F.min("priority").over(Window.partitionBy("cik", "concept"))
    return filed.withColumn("_best", best).filter("priority = _best").select(
        "cik", "concept", "year", "value", "company_name"
    )


def min_years(long: DataFrame, years: int) -> DataFrame:
    """Companies with at least ``years`` distinct years.

    Counted over a company's own rows (concepts x years), so that ``long`` is worked out once.
    """
    seen = F.size(F.collect_set("year").over(Window.partitionBy("cik")))
    return long.withColumn("_years", seen).filter((F.col("_years") >= years) & F.col("cik").isNotNull()).drop("_years")


def lookup_cik(tickers: DataFrame, master: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing) for a ticker list against the ticker master."""
    wanted = tickers.select(clean_ticker(F.col("ticker")).alias("ticker")).distinct()
    return wanted.join(master, "ticker"), wanted.join(master, "ticker", "left_anti")


def company_of(master: DataFrame) -> DataFrame:
    """One ticker per CIK: the first in alphabetical order."""
    return master.groupBy("cik").agg(F.min("ticker").alias("ticker"))


def with_ticker(long: DataFrame, master: DataFrame) -> DataFrame:
    """Adds the company's ticker; companies outside the master drop."""
    return long.join(company_of(master), "cik").select("cik", "ticker", "company_name", "year", "concept", "value")


def restrict_to(long: DataFrame, tickers: DataFrame) -> DataFrame:
    wanted = tickers.select(clean_ticker(F.col("ticker")).alias("ticker")).distinct()
    return long.join(wanted, "ticker", "left_semi")


def augment(raw: DataFrame, ciks: DataFrame, candidates: DataFrame, years: int = 2) -> DataFrame:
    """Appends candidate facts of listed companies that ``raw`` does not hold."""
    wanted = ciks.select(pad_cik(F.col("cik")).alias("cik")).distinct()
    missing = wanted.join(raw.select("cik").distinct(), "cik", "left_anti")
    extra = min_years(candidates.join(missing, "cik", "left_semi"), years)
    return raw.unionByName(extra.select(raw.columns))


def fetch_status(tickers: DataFrame, master: DataFrame, long: DataFrame, years: int = 3) -> DataFrame:
    """Counts of tickers by outcome: no_cik, no_facts, low_data, used."""
    found, missing = lookup_cik(tickers, master)
    on_file = long.select("cik", "year").distinct().groupBy("cik").agg(F.count("year").alias("_years"))
    outcome = found.join(on_file, "cik", "left").select(
        F.when(F.col("_years").isNull(), "no_facts").when(F.col("_years") < years, "low_data").otherwise("used").alias("status")
    )
    return (
        outcome.unionByName(missing.select(F.lit("no_cik").alias("status")))
        .groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    )
