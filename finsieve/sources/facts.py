"""Company-facts documents: nested JSON to annual observations.

A document holds thousands of tags; an analysis reads about fifty. The read
schema therefore names only the wanted tags and the USD unit, and the JSON
reader skips everything else while parsing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finsieve.functions.text import pad_cik

# Concept -> tags in order of preference, for the bulk profile.
BULK = {
    "total_assets": ["Assets"],
    "current_assets": ["AssetsCurrent"],
    "total_liabilities": ["Liabilities"],
    "current_liabilities": ["LiabilitiesCurrent"],
    "equity": ["StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"],
    "retained_earnings": ["RetainedEarningsAccumulatedDeficit"],
    "cash": ["CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsAndShortTermInvestments"],
    "receivables": ["AccountsReceivableNetCurrent", "ReceivablesNetCurrent"],
    "inventory": ["InventoryNet", "InventoryFinishedGoods"],
    "goodwill": ["Goodwill"],
    "intangibles": ["IntangibleAssetsNetExcludingGoodwill", "FiniteLivedIntangibleAssetsNet"],
    "revenue": [
        "RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet",
        "RevenueFromContractWithCustomerIncludingAssessedTax",
    ],
    "gross_profit": ["GrossProfit"],
    "cogs": ["CostOfGoodsAndServicesSold", "CostOfRevenue", "CostOfGoodsSold"],
    "operating_income": ["OperatingIncomeLoss"],
    "net_income": ["NetIncomeLoss"],
    "interest_expense": ["InterestExpense"],
    "da": ["DepreciationDepletionAndAmortization", "DepreciationAndAmortization", "Depreciation"],
    "sga": ["SellingGeneralAndAdministrativeExpense", "GeneralAndAdministrativeExpense"],
    "rd_expense": ["ResearchAndDevelopmentExpense"],
    "tax_expense": ["IncomeTaxExpenseBenefit"],
    "cfo": ["NetCashProvidedByUsedInOperatingActivities"],
    "cfi": ["NetCashProvidedByUsedInInvestingActivities"],
    "cff": ["NetCashProvidedByUsedInFinancingActivities"],
    "capex": ["PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets"],
    "long_term_debt": ["LongTermDebt", "LongTermDebtNoncurrent", "LongTermDebtAndCapitalLeaseObligations"],
    "short_term_debt": ["ShortTermBorrowings", "NotesPayableCurrent", "CommercialPaper"],
}
# Concept -> tags in order of preference, for the single-company profile.
SINGLE = {
    "total_assets": ["Assets"],
    "current_assets": ["AssetsCurrent"],
    "total_liabilities": ["Liabilities"],
    "current_liabilities": ["LiabilitiesCurrent"],
    "equity": ["StockholdersEquity"],
    "retained_earnings": ["RetainedEarningsAccumulatedDeficit"],
    "cash": ["CashAndCashEquivalentsAtCarryingValue"],
    "receivables": ["AccountsReceivableNetCurrent"],
    "inventory": ["InventoryNet"],
    "revenue": [
        "RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet",
        "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueGoodsNet", "RevenueFromRelatedParties",
    ],
    "gross_profit": ["GrossProfit"],
    "cogs": ["CostOfGoodsAndServicesSold", "CostOfRevenue", "CostOfGoodsSold", "CostOfServices"],
    "operating_income": ["OperatingIncomeLoss"],
    "net_income": ["NetIncomeLoss"],
    "interest_expense": ["InterestExpense"],
    "da": ["DepreciationDepletionAndAmortization", "DepreciationAndAmortization", "Depreciation"],
    "sga": ["SellingGeneralAndAdministrativeExpense", "GeneralAndAdministrativeExpense"],
    "cfo": ["NetCashProvidedByUsedInOperatingActivities"],
    "cfi": ["NetCashProvidedByUsedInInvestingActivities"],
    "cff": ["NetCashProvidedByUsedInFinancingActivities"],
    "capex": [
        "PaymentsToAcquirePropertyPlantAndEquipment", "CapitalExpendituresIncurredButNotYetPaid",
        "PaymentsToAcquireProductiveAssets",
    ],
    "long_term_debt": ["LongTermDebt", "LongTermDebtNoncurrent", "LongTermDebtAndCapitalLeaseObligations"],
    "short_term_debt": [
        "ShortTermBorrowings", "NotesPayableCurrent", "CommercialPaper", "ShortTermNonBankLoansAndNotesPayable",
    ],
}
PROFILES = {"bulk": BULK, "single": SINGLE}

OBSERVATION = T.StructType([
    T.StructField("start", T.StringType()), T.StructField("end", T.StringType()),
    T.StructField("val", T.DoubleType()), T.StructField("accn", T.StringType()),
    T.StructField("fy", T.IntegerType()), T.StructField("fp", T.StringType()),
    T.StructField("form", T.StringType()), T.StructField("filed", T.StringType()),
    T.StructField("frame", T.StringType()),
])


def all_tags(concepts: dict[str, list[str]]) -> list[str]:
    return list(dict.fromkeys(t for tags in concepts.values() for t in tags))


def facts_schema(tags: list[str], unit: str = "USD", taxonomy: str = "us-gaap") -> T.StructType:
    """Read schema limited to the wanted tags and one unit."""
    per_tag = T.StructType([T.StructField("units", T.StructType([T.StructField(unit, T.ArrayType(OBSERVATION))]))])
    facts = T.StructType([T.StructField(taxonomy, T.StructType([T.StructField(t, per_tag) for t in tags]))])
    return T.StructType([
        T.StructField("entityName", T.StringType()), T.StructField("cik", T.LongType()),
        T.StructField("facts", facts),
    ])


def read_facts(spark: SparkSession, path: str, concepts: dict[str, list[str]] = BULK) -> DataFrame:
    """Documents of a folder, one JSON file per company.

    The file reader packs small files into tasks. Unparsable files keep their
    text in ``_corrupt`` and nothing else; :func:`split_rejects` parts them.
    The key falls back to the digits of the file name.
    """
    schema = facts_schema(all_tags(concepts)).add("_corrupt", T.StringType())
    docs = (
        spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt")
        .option("pathGlobFilter", "*.json").json(path).withColumn("file", F.col("_metadata.file_name"))
    )
    return docs.withColumn("cik", pad_cik(company_key("file")))


def company_key(file: str) -> Column:
    """The document's key, or the digits of its file name."""
    named = F.regexp_extract(file, r"(\d+)\.json", 1)
    return F.coalesce(F.col("cik").cast("string"), F.when(named != "", named))


def parse_facts(docs: DataFrame, column: str = "json", concepts: dict[str, list[str]] = BULK) -> DataFrame:
    """Documents already landed as text in a table column."""
    schema = facts_schema(all_tags(concepts)).add("_corrupt", T.StringType())
    parsed = F.from_json(column, schema, {"columnNameOfCorruptRecord": "_corrupt"})
    # through explode, so that later filters do not repeat the parsing
    kept = [c for c in docs.columns if c not in (column, "cik")]
    return docs.select(*kept, F.explode_outer(F.array(parsed)).alias("_d")).select(
        "*", "_d.entityName", pad_cik(F.col("_d.cik")).alias("cik"), "_d.facts", "_d._corrupt"
    ).drop("_d")


def split_rejects(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable, rejected) documents."""
    bad = F.col("_corrupt").isNotNull() | F.col("facts").isNull()
    return docs.filter(~bad), docs.filter(bad)


def observations(
    docs: DataFrame, concepts: dict[str, list[str]] = BULK, unit: str = "USD", taxonomy: str = "us-gaap"
) -> DataFrame:
    """(cik, company_name, concept, priority, tag, + observation fields) in long form.

    Tags become rows next to their concept and preference, so the concept map
    needs no join; a tag serving two concepts gives rows for both.
    """
    def entry(concept: str, priority: int, tag: str) -> Column:
        obs = F.col("facts").getField(taxonomy).getField(tag).getField("units").getField(unit)
        return F.when(obs.isNotNull(), F.struct(F.lit(concept).alias("concept"), F.lit(priority).alias("priority"), F.lit(tag).alias("tag"), obs.alias("obs")))

    entries = F.array(*[entry(concept, priority, tag) for concept, tags in concepts.items() for priority, tag in enumerate(tags)])
    # tags a document does not hold go before they become rows; the array is a column of its own, as what a filter's lambda reads is not compiled
    return (
        docs.select("cik", F.col("entityName").alias("company_name"), entries.alias("_entries"))
        .select("cik", "company_name", F.explode(F.filter("_entries", lambda e: e.isNotNull())).alias("e"))
        .select("cik", "company_name", "e.concept", "e.priority", "e.tag", F.explode("e.obs").alias("o"))
        .select("cik", "company_name", "concept", "priority", "tag", "o.*")
    )


def concept_map(spark: SparkSession, profile: str = "bulk") -> DataFrame:
    """(profile, concept, tag, priority) as a table, for observations landed by tag."""
    rows = [(profile, c, t, i) for c, tags in PROFILES[profile].items() for i, t in enumerate(tags)]
    return spark.createDataFrame(rows, "profile string, concept string, tag string, priority int")


def annual(obs: DataFrame, profile: str = "bulk") -> DataFrame:
    """Observations of plain annual reports covering about twelve months.

    Balances without a start date pass; an unreadable date skips the length
    check; without a readable end date there is no year and the row drops.
    The single profile counts calendar months, the bulk profile days / 30.44.
    """
    start, end = _date("start"), _date("end")
    if profile == "single":
        months: Column = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    else:
        months = F.datediff(end, start) / F.lit(30.44)
    fits = start.isNull() | end.isNull() | months.between(10, 14)
    return obs.filter((F.col("form") == "10-K") & fits & end.isNotNull()).withColumn("year", F.year(end))


def _date(name: str) -> Column:
    return F.try_to_date(F.col(name), "yyyy-MM-dd")
