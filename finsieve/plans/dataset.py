"""Dataset assembly: filings to raw table, features, labels, labelled dataset."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsieve.functions.text import release_date, release_hits, release_number, respondent
from finsieve.operators import features as fea
from finsieve.operators import ingest, labels as lab, match
from finsieve.operators.panel import company_year
from finsieve.session import materialize
from finsieve.sources import facts as fx
from finsieve.sources import masters, sinks


def long_facts(
    docs: DataFrame, profile: str = "bulk", tag_policy: str = "per_company", as_of: str | None = None,
    concepts: dict[str, list[str]] | None = None,
) -> DataFrame:
    """(cik, concept, year, value, company_name) of every company in ``docs``.

    ``concepts`` maps a concept to its tags, most preferred first, in place of the profile's own; ``docs`` must have been read with them.
    """
    concepts = fx.PROFILES[profile] if concepts is None else concepts
    readable, _ = fx.split_rejects(docs)
    annual = fx.annual(fx.observations(readable, concepts), profile)
    return ingest.pick_tags(ingest.latest_filed(annual, as_of), tag_policy)


def raw_table(
    docs: DataFrame, master: DataFrame, tickers: DataFrame | None = None, min_years: int = 3, **options
) -> DataFrame:
    """Long company-year table of the wanted tickers (all of the master by
    default) with enough years on file.

    Other companies drop where the ticker joins, after documents have shrunk to one row per tag and year."""
    companies = master if tickers is None else ingest.restrict_to(master, tickers)
    return ingest.min_years(ingest.with_ticker(long_facts(docs, **options), companies), min_years)


def financial_data(docs: DataFrame, master: DataFrame) -> DataFrame:
    """Wide table in the single-company profile, for the report."""
    return company_year(ingest.with_ticker(long_facts(docs, "single"), master))


def feature_dataset(raw: DataFrame, winsor: bool = True, **fit) -> DataFrame:
    """Feature table of a long raw table, winsorised. The unclipped features
    are landed once because the bounds and the result both read them."""
    features = fea.feature_table(company_year(raw))
    if not winsor:
        return features
    landed = materialize(features, "features")
    return fea.winsorise(landed, fea.winsor_bounds(landed, **fit))


def parse_releases(entries: DataFrame) -> DataFrame:
    """(entry_no, aaer_no, fraud_date, raw_name, url) of readable releases.

    ``entries`` has entry_no, url, raw_text and optionally detail_text, read
    where the index text lacks a name or date. The first entry of a release
    number stays; entries without a number all stay.
    """
    rows = _released(entries.withColumn("_text", F.col("raw_text")))
    if "detail_text" in entries.columns:
        # the page text is searched only where the index text was not readable
        rest = rows.withColumn("_text", F.when(F.col("_r").isNull(), F.col("detail_text"))).withColumnRenamed("_r", "_index")
        rows = _released(rest).withColumn("_r", F.coalesce("_index", "_r"))
    # through explode, so that the filter on unreadable rows does not repeat the parsing
    rows = rows.select("entry_no", "url", F.explode_outer(F.array("_r")).alias("r")).filter("r is not null").select(
        "entry_no", "r.*", "url"
    )
    kept = F.struct("entry_no", "fraud_date", "raw_name", "url")
    # entries without a number form a group of their own
    alone = F.when(F.col("aaer_no").isNull(), F.col("entry_no"))
    return rows.groupBy("aaer_no", alone.alias("_alone")).agg(F.min_by(kept, "entry_no").alias("k")).select(
        "k.entry_no", "aaer_no", "k.fraud_date", "k.raw_name", "k.url"
    )


def _released(rows: DataFrame) -> DataFrame:
    """Adds ``_r`` (aaer_no, fraud_date, raw_name) read from ``_text``, NULL
    without name or date. Patterns run once; the next projections read their hits."""
    hits = rows.select("*", *release_hits(F.col("_text"), "_h_"))
    fields = hits.select(
        *rows.columns, release_number("_h_").alias("_no"), release_date("_h_").alias("_date"), respondent("_h_").alias("_name")
    )
    record = F.struct(F.col("_no").alias("aaer_no"), F.col("_date").alias("fraud_date"), F.col("_name").alias("raw_name"))
    readable = F.col("_date").isNotNull() & F.col("_name").isNotNull()
    return fields.select(*[c for c in rows.columns if c != "_text"], F.when(readable, record).alias("_r"))


def fraud_labels(
    firm_years: DataFrame | None = None,
    releases: DataFrame | None = None,
    master: DataFrame | None = None,
    seeds: DataFrame | None = None,
    filers: DataFrame | None = None,
) -> DataFrame:
    """Fraud cases from the first source that has any: firm-year labels, then
    parsed releases matched to the master, then resolved seeds."""
    if firm_years is not None and not firm_years.isEmpty():
        first = firm_years.filter("is_fraud = 1").groupBy("cik").agg(F.min("year").alias("year"))
        return first.select(
            "cik", F.lit("").alias("ticker"), F.lit("").alias("company_name"), F.lit(None).cast("int").alias("aaer_no"),
            F.make_date("year", F.lit(12), F.lit(31)).alias("fraud_date"), F.lit(100.0).alias("match_score"),
        )
    if releases is not None and master is not None:
        # texts are taken apart once: the test, and both sides of the name join, read the result
        parsed = materialize(parse_releases(releases), "parsed-releases")
        if not parsed.isEmpty():
            return match.match_releases(parsed, master)
    if seeds is None or master is None or filers is None:
        raise ValueError("no fraud label source given")
    return match.resolve_seeds(seeds, master, filers, "fraud_date").withColumn("aaer_no", F.lit(None).cast("int"))


def bankruptcy_labels(seeds: DataFrame, master: DataFrame, filers: DataFrame) -> DataFrame:
    return match.resolve_seeds(seeds, master, filers, "bankruptcy_date")


def build(
    spark: SparkSession,
    facts_path: str,
    master_path: str,
    out: str,
    tickers: DataFrame | None = None,
    fraud: DataFrame | None = None,
    bankruptcies: DataFrame | None = None,
    firm_years: DataFrame | None = None,
    min_years: int = 3,
    version: str | None = None,
    concepts: dict[str, list[str]] | None = None,
) -> dict[str, DataFrame]:
    """Filings to labelled dataset, each stage landed under ``out``.

    ``version`` names this run's folder of the augmented table; without it each
    run takes a new one. ``concepts`` replaces the concept map. ``rejects`` are the documents that could not be read,
    ``fetch_status`` counts the wanted tickers by outcome.
    """
    docs = fx.read_facts(spark, facts_path, fx.BULK if concepts is None else concepts)
    master = masters.read_master(spark, master_path)
    _, bad = fx.split_rejects(docs)
    rejects = sinks.write_table(bad.select("file", "cik", F.col("_corrupt").alias("content")), f"{out}/rejected_documents")
    # the corpus is taken apart once; the raw table and its additions both read the result
    every = sinks.write_table(long_facts(docs, concepts=concepts), f"{out}/long_facts")
    companies = master if tickers is None else ingest.restrict_to(master, tickers)
    raw = sinks.write_table(
        ingest.min_years(ingest.with_ticker(every, companies), min_years), f"{out}/raw_financials"
    )
    status = ingest.fetch_status(master if tickers is None else tickers, master, every, min_years)
    if raw.isEmpty():
        raise ValueError("no company has usable filings")
    extra = [df.select("cik") for df in (fraud, bankruptcies) if df is not None]
    if extra:
        ciks = extra[0] if len(extra) == 1 else extra[0].union(extra[1])
        candidates = ingest.with_ticker(every, master)
        raw = sinks.write_version(
            ingest.augment(raw, ciks, candidates), f"{out}/raw_financials_augmented", version or uuid.uuid4().hex
        )
    features = sinks.write_table(feature_dataset(raw), f"{out}/features")
    labelled = sinks.write_table(
        lab.labelled_dataset(features, firm_years, fraud, bankruptcies), f"{out}/labelled_dataset"
    )
    return {
        "raw": raw, "features": features, "labelled": labelled, "summary": lab.run_summary(labelled),
        "distribution": lab.label_distribution(labelled), "rejects": rejects, "fetch_status": status,
    }
