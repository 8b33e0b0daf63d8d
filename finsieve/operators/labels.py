"""Fraud and distress labels on company-years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finsieve.functions.text import pad_cik

FRAUD_YEARS = (-3, 0)
BANKRUPTCY_YEARS = (-2, -1)


def _window_years(labels: DataFrame, date: str, span: tuple[int, int], flag: str) -> DataFrame:
    """(cik, year) covered by a span of years around each label date."""
    year = F.year(F.col(date))
    return (
        labels.filter(F.col("cik").isNotNull() & F.col(date).isNotNull())
        .select(
            pad_cik(F.col("cik")).alias("cik"), F.explode(F.sequence(year + span[0], year + span[1])).alias("year"), F.lit(1).alias(flag)
        )
    )


def _flagged(features: DataFrame, years: DataFrame, flag: str) -> DataFrame:
    """Left join with one row per company that holds its label years; missing means 0.

    The key of the wide side stays as it is (``features`` carries padded keys
    already) and alone is joined on, so a table that lies by ``cik`` is not
    exchanged again. A company has at most one label year per calendar year.
    """
    held = years.filter(F.col(flag) == 1).groupBy("cik").agg(F.collect_set("year").alias("_years"))
    hit = F.coalesce(F.array_contains("_years", F.col("year")), F.lit(False))
    return features.join(held, "cik", "left").withColumn(flag, hit.cast("int")).drop("_years")


def attach_fraud(features: DataFrame, fraud: DataFrame) -> DataFrame:
    """is_fraud = 1 for the three years up to and including the fraud year."""
    return _flagged(features, _window_years(fraud, "fraud_date", FRAUD_YEARS, "is_fraud"), "is_fraud")


def attach_bankruptcy(features: DataFrame, bankruptcies: DataFrame) -> DataFrame:
    """is_bankrupt = 1 for the two years before the filing year."""
    years = _window_years(bankruptcies, "bankruptcy_date", BANKRUPTCY_YEARS, "is_bankrupt")
    return _flagged(features, years, "is_bankrupt")


def attach_firm_years(features: DataFrame, firm_years: DataFrame) -> DataFrame:
    """Firm-year labels; repeats of one (cik, year) collapse to the highest flag."""
    years = (
        firm_years.select(pad_cik(F.col("cik")).alias("cik"), F.col("year").cast("int").alias("year"), "is_fraud")
        .groupBy("cik", "year").agg(F.max("is_fraud").cast("int").alias("is_fraud"))
    )
    return _flagged(features, years, "is_fraud")


def attach_gone_dark(features: DataFrame) -> DataFrame:
    """Fallback distress labels for companies that stopped filing.

    A company whose last year is at least three years before the latest year
    of the table, and whose last two rows show two or more of five distress
    signals, has those two rows marked.
    """
    latest = features.agg(F.max("year").alias("max_year"))
    newest_first = Window.partitionBy("cik").orderBy(F.col("year").desc())
    signals = {
        "low_liquidity": F.col("f_current_ratio") < 1.0,
        "high_debt": F.col("f_debt_assets") > 0.8,
        "loss": F.col("f_net_margin") < 0.0,
        "cash_burn": F.col("f_cfo_ni") < 0.0,
        "negative_capital": F.col("f_z_x1") < 0.0,
    }
    both = Window.partitionBy("cik")
    last_two = (
        features.select("cik", "year", *[F.coalesce(s, F.lit(False)).cast("int").alias(n) for n, s in signals.items()])
        .withColumn("_recent", F.row_number().over(newest_first))
        .filter("_recent <= 2")
    )
    hits = sum((F.max(n).over(both) for n in signals), F.lit(0))
    dark = (
        last_two.select("cik", "year", F.max("year").over(both).alias("last_year"), hits.alias("hits"))
        .join(F.broadcast(latest))
        .filter((F.col("last_year") <= F.col("max_year") - 3) & (F.col("hits") >= 2))
        .select("cik", "year", F.lit(1).alias("is_bankrupt"))
    )
    return _flagged(features, dark, "is_bankrupt")


def unified_label(fraud: Column, bankrupt: Column) -> list[Column]:
    """label 0/1/2 and its name; fraud wins over bankruptcy."""
    return [
        F.when(fraud == 1, 1).when(bankrupt == 1, 2).otherwise(0).alias("label"),
        F.when(fraud == 1, "fraud").when(bankrupt == 1, "bankruptcy").otherwise("clean").alias("label_type"),
    ]


def with_unified_label(df: DataFrame) -> DataFrame:
    return df.select("*", *unified_label(F.col("is_fraud"), F.col("is_bankrupt")))


def labelled_dataset(
    features: DataFrame,
    firm_years: DataFrame | None = None,
    fraud: DataFrame | None = None,
    bankruptcies: DataFrame | None = None,
) -> DataFrame:
    """Features with labels: firm-year labels before dated cases before none;
    dated bankruptcies before the gone-dark rule."""
    if firm_years is not None:
        out = attach_firm_years(features, firm_years)
    elif fraud is not None:
        out = attach_fraud(features, fraud)
    else:
        out = features.withColumn("is_fraud", F.lit(0))
    if bankruptcies is not None and not bankruptcies.isEmpty():
        out = attach_bankruptcy(out, bankruptcies)
    else:
        out = attach_gone_dark(out)
    return with_unified_label(out)


def label_distribution(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label_type").agg(F.count(F.lit(1)).alias("n"))


def run_summary(labelled: DataFrame) -> DataFrame:
    """Companies, years, rows, features and label counts in one row."""
    n = F.count(F.lit(1))
    features = len([c for c in labelled.columns if c.startswith("f_")])
    return labelled.agg(
        F.countDistinct("cik").alias("companies"), F.countDistinct("year").alias("years"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), n.alias("rows"),
        F.lit(features).alias("features"),
        F.sum("is_fraud").alias("fraud"), F.sum("is_bankrupt").alias("bankrupt"),
        F.count(F.when(F.col("label") == 0, True)).alias("clean"),
        (F.sum("is_fraud") * 100.0 / n).alias("fraud_pct"),
        (F.sum("is_bankrupt") * 100.0 / n).alias("bankrupt_pct"),
        (F.count(F.when(F.col("label") == 0, True)) * 100.0 / n).alias("clean_pct"),
    )


def holdout_split(labelled: DataFrame, cutoff: int = 2016) -> tuple[DataFrame, DataFrame]:
    """(train, test) by year. Test rows that carry a label are dropped when
    their company already carried one in training; its clean rows stay."""
    labelled_row = (F.col("is_fraud") == 1) | (F.col("is_bankrupt") == 1)
    train = labelled.filter(F.col("year") < cutoff)
    later = labelled.filter(F.col("year") >= cutoff)
    seen = train.filter(labelled_row).select("cik").distinct().withColumn("_seen", F.lit(True))
    test = (
        later.join(seen, "cik", "left")
        .filter(F.col("_seen").isNull() | ~labelled_row)
        .select(labelled.columns)
    )
    return train, test


def walk_forward_folds(df: DataFrame, min_train_years: int = 8, test_window: int = 3, step: int = 3) -> DataFrame:
    """(fold, train_before, val_from, val_to) for complete validation windows
    with rows on both sides. One row per fold; years are few by nature."""
    per_year = df.groupBy("year").agg(F.count(F.lit(1)).alias("rows"))
    bounds = per_year.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    starts = bounds.filter(F.col("lo") + min_train_years + test_window - 1 <= F.col("hi")).select(
        F.explode(
            F.sequence(F.col("lo") + min_train_years, F.col("hi") - test_window + 1, F.lit(step))
        ).alias("val_from")
    )
    val_to = F.col("val_from") + test_window - 1
    sized = (
        starts.join(F.broadcast(per_year))
        .groupBy("val_from")
        .agg(
            F.sum(F.when(F.col("year") < F.col("val_from"), F.col("rows")).otherwise(0)).alias("n_train"),
            F.sum(F.when(F.col("year").between(F.col("val_from"), val_to), F.col("rows")).otherwise(0)).alias("n_val"),
            F.min(F.when(F.col("year") < F.col("val_from"), F.col("year"))).alias("train_first"),
            F.max(F.when(F.col("year") < F.col("val_from"), F.col("year"))).alias("train_last"),
        )
        .filter("n_train > 0 and n_val > 0")
    )
    return sized.select(
        F.row_number().over(Window.orderBy("val_from")).alias("fold"),
        "val_from", val_to.alias("val_to"), "train_first", "train_last", "n_train", "n_val",
    )


def label_overlap(features: DataFrame, fraud: DataFrame) -> DataFrame:
    """CIKs shared by features and labels, as given and zero-padded."""
    def shared(f) -> Column:
        a = features.select(f(F.col("cik")).alias("cik")).distinct()
        b = fraud.select(f(F.col("cik")).alias("cik")).distinct()
        return a.intersect(b).agg(F.count(F.lit(1)).alias("n"))

    raw = shared(lambda c: c.cast("string")).select(F.lit("raw").alias("form"), "n")
    padded = shared(pad_cik).select(F.lit("padded").alias("form"), "n")
    return raw.unionByName(padded)


def label_diagnostics(features: DataFrame, fraud: DataFrame) -> DataFrame:
    """Per labelled company: label window, years on file, years that match."""
    years = features.select(pad_cik(F.col("cik")).alias("cik"), "year").groupBy("cik").agg(
        F.array_sort(F.collect_set("year")).alias("years")
    )
    windows = fraud.filter("fraud_date is not null").select(
        pad_cik(F.col("cik")).alias("cik"), F.year("fraud_date").alias("fraud_year")
    ).distinct()
    window = F.sequence(F.col("fraud_year") - 3, F.col("fraud_year"))
    matched = windows.join(years, "cik").select(
        "cik", "fraud_year", F.size("years").alias("years_on_file"),
        F.size(F.array_intersect("years", window)).alias("matching_years"),
    )
    return matched
