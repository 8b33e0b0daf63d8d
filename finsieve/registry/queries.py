"""Queries over the given tables, one per operator."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from finsieve.functions import numeric as num
from finsieve.functions import text as tx
from finsieve.operators import features as fea
from finsieve.operators import flags as flg
from finsieve.operators import attribution, boosting, ingest, isolation, labels as lab, match, models, ranking as rk, smote
from finsieve.operators import panel as pan
from finsieve.operators import scores as sc
from finsieve.operators.quantiles import exact_quantiles
from finsieve.plans import evaluation as ev
from finsieve.plans import report as rpt
from finsieve.plans import dataset
from finsieve.plans.dataset import parse_releases
from finsieve.session import materialize, shared_dir
from finsieve.sources import facts as fx
from finsieve.sources import masters, pages as pg, sample, sinks
from finsieve.streaming import refresh

CUTOFF = 1999


def rounded(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded for comparison across engines."""
    return df.selectExpr(*[
        f"round(`{c}`, {digits}) as `{c}`" if t == "double" and c not in skip else f"`{c}`" for c, t in df.dtypes
    ])


def _market_cap(spark: SparkSession, d: str) -> DataFrame:
    return sample.table(spark, d, "customer").filter("c_acctbal > 0").select(
        sample.cik_of("c_custkey").alias("cik"), (F.col("c_acctbal") * 1000).alias("market_cap")
    )


def _signals(spark: SparkSession, d: str) -> DataFrame:
    return sc.company_signals(pan.history(sample.company_panel(spark, d)), _market_cap(spark, d))


def _features(spark: SparkSession, d: str) -> DataFrame:
    return fea.feature_table(sample.company_panel(spark, d))


def _labelled(spark: SparkSession, d: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """The labelled table, or those of ``columns`` that it has."""
    table = lab.labelled_dataset(
        _features(spark, d), fraud=sample.fraud_labels(spark, d), bankruptcies=sample.bankruptcy_labels(spark, d)
    )
    return table.select(*[c for c in columns if c in table.columns]) if columns else table


#: What models are fitted on and judged by.
_MODELLED = ("cik", "year", "is_fraud", "is_bankrupt", *fea.TRAINED)


# panel -----------------------------------------------------------------------------------

def company_year_wide(spark, d):
    return pan.company_year(sample.raw_financials(spark, d))


def company_year_long(spark, d):
    return sample.raw_financials(spark, d)


def min_years_filter(spark, d):
    return ingest.min_years(sample.raw_financials(spark, d), 6)


def series_align(spark, d):
    long = sample.raw_financials(spark, d)
    frames = [long.filter(F.col("concept") == c).select("cik", "year", "value") for c in ("cfo", "capex", "cash")]
    return pan.align(*frames)


def ratio_panel(spark, d):
    panel = pan.ratio_panel(sample.company_panel(spark, d))
    return rounded(panel.select("cik", "year", *pan.RATIOS), skip=("total_debt", *pan.PASSED_THROUGH))


def ratio_growth(spark, d):
    return rounded(pan.ratio_panel(sample.company_panel(spark, d)).select("cik", "year", *pan.GROWTH))


# filings ---------------------------------------------------------------------------------

def _line_observations(spark: SparkSession, d: str) -> DataFrame:
    """Line items as observations of three alternative tags of one concept."""
    items = sample.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("orderkey"), (F.col("l_linenumber") % 3).alias("priority"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("filed"), F.col("l_extendedprice").alias("val"),
    )
    orders = sample.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("orderkey"), sample.cik_of("o_custkey").alias("cik"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("end"), F.year("o_orderdate").alias("year"),
    )
    return items.join(orders, "orderkey").select(
        "cik", F.lit("revenue").alias("concept"), "priority", "year", "filed", "end", "val", F.col("cik").alias("company_name")
    )


def latest_filed_dedupe(spark, d):
    return ingest.latest_filed(_line_observations(spark, d)).select("cik", "priority", "year", "value")


def latest_filed_as_of(spark, d):
    return ingest.latest_filed(_line_observations(spark, d), as_of="1998-06-30").select("cik", "priority", "year", "value")


def tag_priority_pick(spark, d):
    picked = ingest.pick_tags(ingest.latest_filed(_line_observations(spark, d)))
    return picked.select("cik", "concept", "year", "value")


def tag_priority_per_year(spark, d):
    picked = ingest.pick_tags(ingest.latest_filed(_line_observations(spark, d)), "per_year")
    return picked.select("cik", "concept", "year", "value")


def facts_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every line item as a company-facts document in JSON text."""
    items = sample.table(spark, d, "lineitem")
    orders = sample.table(spark, d, "orders")
    names = sample.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    tags = fx.all_tags(fx.BULK | {f"single_{c}": t for c, t in fx.SINGLE.items()})
    tag = F.get(F.array(*[F.lit(t) for t in tags]), (F.col("l_partkey") % len(tags)).cast("int"))
    span = (F.lit(270) + (F.col("l_quantity").cast("int") % 10) * 20)
    obs = F.struct(
        F.when(F.col("l_linenumber") != 5, F.date_format(F.date_sub(F.col("o_orderdate").cast("date"), span), "yyyy-MM-dd")).alias("start"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("end"), F.col("l_extendedprice").alias("val"),
        F.when(F.col("l_returnflag") == "A", "10-K/A").otherwise("10-K").alias("form"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("filed"),
    )
    unit = F.when(F.col("l_suppkey") % 10 == 0, "EUR").otherwise("USD")
    body = F.struct(
        F.col("c_name").alias("entityName"), F.col("o_custkey").alias("cik"),
        F.struct(
            F.create_map(tag, F.struct(F.create_map(unit, F.array(obs)).alias("units"))).alias("us-gaap")
        ).alias("facts"),
    )
    joined = items.join(orders, items.l_orderkey == orders.o_orderkey).join(names, "o_custkey")
    return joined.select(F.to_json(body).alias("json"))


def _extract(spark: SparkSession, d: str, profile: str) -> DataFrame:
    concepts = fx.PROFILES[profile]
    docs, _ = fx.split_rejects(fx.parse_facts(facts_documents(spark, d), concepts=concepts))
    filed = ingest.latest_filed(fx.annual(fx.observations(docs, concepts), profile))
    return ingest.pick_tags(filed).select("cik", "company_name", "concept", "year", "value")


def facts_extract_bulk(spark, d):
    return _extract(spark, d, "bulk")


def facts_extract_single(spark, d):
    return _extract(spark, d, "single")


# universe --------------------------------------------------------------------------------

def master_documents(spark: SparkSession, d: str) -> DataFrame:
    """Customers as ticker-master documents in JSON text, one entry each."""
    return sample.table(spark, d, "customer").select(
        F.to_json(
            F.create_map(
                F.col("c_custkey").cast("string"),
                F.struct(
                    F.col("c_custkey").alias("cik_str"),
                    F.concat(F.lit("t"), (F.col("c_custkey") % 1000).cast("string")).alias("ticker"),
                    F.col("c_name").alias("title"),
                ),
            )
        ).alias("value")
    )


def ticker_master(spark, d):
    return masters.parse_master(master_documents(spark, d))


def universe_fallback(spark, d):
    return masters.ticker_universe([], ticker_master(spark, d), use_master=True)


def universe_first(spark, d):
    return masters.ticker_universe([], ticker_master(spark, d), use_master=True, limit=100)


def universe_union(spark, d):
    customers = sample.table(spark, d, "customer").select(
        F.concat(F.lit(" BRK."), F.col("c_custkey").cast("string")).alias("Symbol")
    )
    suppliers = sample.table(spark, d, "supplier").select(
        F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("S."), F.col("s_suppkey").cast("string"))).alias("Ticker symbol")
    )
    return masters.ticker_universe([(customers, "Symbol"), (suppliers, "Ticker symbol")])


def _wanted_tickers(spark: SparkSession, d: str) -> DataFrame:
    return sample.table(spark, d, "part").select(F.concat(F.lit(" t"), F.col("p_partkey").cast("string")).alias("ticker"))


def ticker_lookup(spark, d):
    found, _ = ingest.lookup_cik(_wanted_tickers(spark, d), ticker_master(spark, d))
    return found.select("ticker", "cik")


def fetch_status(spark, d):
    return ingest.fetch_status(_wanted_tickers(spark, d), ticker_master(spark, d), sample.raw_financials(spark, d), 6)


def augment_missing(spark, d):
    long = sample.raw_financials(spark, d)
    base = long.filter(F.col("cik").cast("bigint") % 3 != 0)
    out = ingest.augment(base, sample.fraud_labels(spark, d), long, 2)
    return out.groupBy("cik").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("year").alias("years"))


# features --------------------------------------------------------------------------------

def _family(columns):
    def query(spark, d):
        return rounded(_features(spark, d).select("cik", "year", *columns))
    return query


feat_ratio = _family(fea.RATIO)
feat_yoy = _family(fea.YOY)
feat_trend = _family(fea.TREND)
feat_interaction = _family(fea.INTERACTION)
feat_accrual = _family(fea.ACCRUAL)
feat_beneish = _family(fea.BENEISH)
feat_altman = _family(fea.ALTMAN)


def feat_winsor(spark, d):
    table = materialize(_features(spark, d), "features")
    return rounded(fea.winsorise(table, fea.winsor_bounds(table)).drop("ticker", "company_name"))


def completeness(spark, d):
    return rounded(fea.completeness(_features(spark, d)))


# scores, flags, report -------------------------------------------------------------------

def altman_latest(spark, d):
    return rounded(_signals(spark, d).select("cik", "altman_z", sc.altman_zone(F.col("altman_z")).alias("zone")))


def beneish_latest(spark, d):
    return rounded(_signals(spark, d).select("cik", "beneish_m", sc.beneish_class(F.col("beneish_m")).alias("class")))


def altman_risk(spark, d):
    f = _features(spark, d)
    return rounded(f.select("cik", "year", sc.altman_z_rows(f).alias("z"), sc.altman_risk(f).alias("risk")))


def beneish_risk(spark, d):
    f = _features(spark, d)
    return rounded(f.select("cik", "year", sc.beneish_m_rows(f).alias("m"), sc.beneish_risk(f).alias("risk")))


def composite_score(spark, d):
    return sc.company_scores(_signals(spark, d)).select("cik", *sc.WEIGHTS, "overall", "label", "color")


def composite_score_trend(spark, d):
    return sc.company_scores(_signals(spark, d), "polarity").select("cik", *sc.WEIGHTS, "overall", "label", "color")


def health_rank_top20(spark, d):
    scores = sc.company_scores(_signals(spark, d))
    return scores.orderBy("overall", "cik").limit(20).select("cik", "company_name", "overall", "label")


def _gap_signals(spark: SparkSession, d: str) -> DataFrame:
    """Signals when every fifth company's last year holds assets only, so no metric."""
    panel = sample.company_panel(spark, d)
    kept = ("cik", "ticker", "company_name", "year", "total_assets")
    last = panel.groupBy("cik").agg(F.max("year").alias("_last"))
    bare = (F.col("cik").cast("bigint") % 5 == 0) & (F.col("year") == F.col("_last"))
    blanked = panel.join(last, "cik").select(*[c if c in kept else F.when(~bare, F.col(c)).alias(c) for c in panel.columns])
    return sc.company_signals(pan.history(blanked), _market_cap(spark, d))


def gap_growth(spark, d):
    return rounded(_gap_signals(spark, d).select("cik", "last_revenue_growth", "last_cfo_growth", "last_total_assets"))


def gap_flags(spark, d):
    return flg.detect_flags(_gap_signals(spark, d)).select("cik", "rule_no", "title", "detail")


def gap_scores(spark, d):
    return sc.company_scores(_gap_signals(spark, d)).select("cik", *sc.WEIGHTS, "overall", "label")


def flags_sorted(spark, d):
    """The three gravest flags of every company by their place in severity order."""
    ordered = flg.sorted_flags(flg.detect_flags(_signals(spark, d)))
    place = F.row_number().over(Window.partitionBy("cik").orderBy("severity_rank", "rule_no"))
    return ordered.withColumn("place", place).filter("place <= 3").select("cik", "place", "rule_no", "severity")


def flags_long(spark, d):
    return flg.detect_flags(_signals(spark, d)).select("cik", "rule_no", "severity", "category", "title", "detail", "emoji")


def flags_by_severity(spark, d):
    return flg.counts_by_severity(flg.detect_flags(_signals(spark, d)))


def flags_by_category(spark, d):
    grouped = flg.by_category(flg.detect_flags(_signals(spark, d)))
    return grouped.select("cik", "category", F.array_join(F.col("flags.title"), " | ").alias("titles"))


def indexed_series(spark, d):
    return rounded(rpt.indexed_series(pan.ratio_panel(sample.company_panel(spark, d))))


def ratio_trend_long(spark, d):
    return rounded(rpt.ratio_trends(pan.ratio_panel(sample.company_panel(spark, d))))


def fcf_split(spark, d):
    return rpt.cash_split(_signals(spark, d)).withColumn("billions", F.round("billions", 9))


def de_band(spark, d):
    return rounded(rpt.leverage_bands(pan.ratio_panel(sample.company_panel(spark, d))))


def score_parts(spark, d):
    return rpt.score_parts(sc.company_scores(_signals(spark, d)))


def ratio_display(spark, d):
    return rpt.display_table(pan.ratio_panel(sample.company_panel(spark, d))).select(
        "cik", "year", "current_ratio", "gross_margin", "roe", "revenue_growth", "cfo_ni_ratio"
    )


def gauges(spark, d):
    return rounded(rpt.gauges(_signals(spark, d)))


def report_header(spark, d):
    return rounded(rpt.header(_signals(spark, d)))


def metric_format(spark, d):
    v = F.col("c_acctbal")
    scaled = F.when(F.col("c_custkey") % 4 == 0, v).when(F.col("c_custkey") % 4 == 1, v * 1e3).when(
        F.col("c_custkey") % 4 == 2, v * 1e6).otherwise(v * 1e9)
    return sample.table(spark, d, "customer").select(
        "c_custkey", tx.money(scaled).alias("money"), tx.percent(v / 7000).alias("pct"), tx.multiple(v / 300).alias("times")
    )


# labels ----------------------------------------------------------------------------------

def label_fraud_window(spark, d):
    panel = sample.company_panel(spark, d).select("cik", "year")
    return lab.attach_fraud(panel, sample.fraud_labels(spark, d)).select("cik", "year", "is_fraud")


def label_bankrupt_window(spark, d):
    panel = sample.company_panel(spark, d).select("cik", "year")
    return lab.attach_bankruptcy(panel, sample.bankruptcy_labels(spark, d)).select("cik", "year", "is_bankrupt")


def label_gone_dark(spark, d):
    return lab.attach_gone_dark(_features(spark, d)).select("cik", "year", "is_bankrupt")


def label_unified_dist(spark, d):
    return lab.label_distribution(_labelled(spark, d))


def firm_year_label_join(spark, d):
    raw = sample.table(spark, d, "orders").select(
        F.col("o_custkey").alias(" CIK "), F.year("o_orderdate").alias("FYEAR"),
        (F.col("o_totalprice") > 300000).cast("int").alias("P_AAER"),
    )
    panel = sample.company_panel(spark, d).select("cik", "year")
    return lab.attach_firm_years(panel, masters.normalise_firm_years(raw)).select("cik", "year", "is_fraud")


def holdout_split_counts(spark, d):
    train, test = lab.holdout_split(_labelled(spark, d), CUTOFF)
    sides = train.select(F.lit("train").alias("side"), "*").unionByName(test.select(F.lit("test").alias("side"), "*"))
    return sides.groupBy("side").agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_fraud").alias("fraud"), F.sum("is_bankrupt").alias("bankrupt"),
        F.countDistinct("cik").alias("companies"),
    )


def walk_forward_folds(spark, d):
    return lab.walk_forward_folds(sample.company_panel(spark, d).select("cik", "year"), 3, 2, 2).select(
        F.col("fold").cast("bigint").alias("fold"), "val_from", "val_to", "train_first", "train_last", "n_train", "n_val",
        tx.year_range(F.col("train_first"), F.col("train_last")).alias("train_years"),
    )


def run_summary(spark, d):
    return rounded(lab.run_summary(_labelled(spark, d)))


def label_diagnostics(spark, d):
    return lab.label_diagnostics(sample.company_panel(spark, d).select("cik", "year"), sample.fraud_labels(spark, d))


def label_overlap(spark, d):
    unpadded = sample.fraud_labels(spark, d).withColumn("cik", F.regexp_replace("cik", "^0+(?=.)", ""))
    return lab.label_overlap(sample.company_panel(spark, d).select("cik", "year"), unpadded)


# ranking ---------------------------------------------------------------------------------

def _order_scores(spark: SparkSession, d: str) -> DataFrame:
    """Orders rank by price; urgent ones are the positives. Prices in steps of
    500 make ties, and one status shares a single score."""
    return sample.table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("model"),
        F.when(F.col("o_orderpriority").startswith("2"), 100000.0)
        .otherwise(F.floor(F.col("o_totalprice") / 500) * 500.0).alias("score"),
        (F.col("o_orderpriority").startswith("1")).cast("int").alias("y"),
        sample.cik_of("o_orderkey").alias("cik"), F.year("o_orderdate").alias("year"),
    )


def rank_metrics(spark, d):
    rows = materialize(_order_scores(spark, d), "orders")
    cum = materialize(rk.cumulative(rk.score_groups(rows)), "ranked")
    return rounded(rk.auc_and_ap(cum).drop("constant").join(rk.recall_at_top(cum), "model").join(rk.precision_at(rows), "model"))


def lift_orders(spark, d):
    return rk.lift_curve(materialize(_order_scores(spark, d), "orders"))


def _test_scores(spark: SparkSession, d: str, task: str) -> DataFrame:
    _, test = lab.holdout_split(_labelled(spark, d), CUTOFF)
    blend = num.ensemble(sc.altman_risk(test), sc.beneish_risk(test))
    rows = ev.score_rows(test, task, blend, "Blend")
    return rows.select("cik", "year", "y", *[F.round(F.col(f"`{n}`"), 9).alias(n) for n in ev.model_names(rows)])


def benchmark_fraud(spark, d):
    return ev.benchmark(_test_scores(spark, d, "fraud"))


def benchmark_distress(spark, d):
    return ev.benchmark(_test_scores(spark, d, "distress"))


def lift_curve(spark, d):
    return ev.lift(_test_scores(spark, d, "fraud"))


def recall_at_review(spark, d):
    return ev.recall_at_review(ev.lift(_test_scores(spark, d, "fraud")))


def _given_folds(spark: SparkSession, d: str) -> DataFrame:
    """Fold metrics of scores that need no training: the blend and its two parts on every validation window."""
    labelled = materialize(_labelled(spark, d), "labelled")
    folds = lab.walk_forward_folds(labelled, 3, 2, 2).collect()
    fold = F.coalesce(*[F.when(F.col("year").between(f["val_from"], f["val_to"]), F.lit(str(f["fold"]))) for f in folds])
    part = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 9)
    a, b = sc.altman_risk(labelled), sc.beneish_risk(labelled)
    oof = labelled.select(
        fold.alias("fold"), "cik", "year", F.col("is_fraud").alias("y"), part(num.ensemble(a, b)).alias("score"),
        part(a).alias("xgb_prob"), part(b).alias("iso_score"),
    ).filter("fold is not null")
    years = [(str(f["fold"]), f"{f['train_first']}–{f['train_last']}", f"{f['val_from']}–{f['val_to']}", f["n_train"]) for f in folds]
    return ev.fold_metrics(materialize(oof, "given-oof"), years)


def fold_metrics(spark, d):
    return _given_folds(spark, d)


def fold_statistics(spark, d):
    return rounded(ev.fold_statistics(_given_folds(spark, d)))


def evaluation_summary(spark, d):
    rows = {task: _test_scores(spark, d, task) for task in ev.TASKS}
    pooled = {task: ev.pooled_metrics(r.select("cik", "year", "y", F.col("Blend").alias("score"))) for task, r in rows.items()}
    return ev.summary({task: ev.benchmark(r) for task, r in rows.items()}, pooled, "Blend").select(
        "task", "model", "auc_roc", "auc_pr", "precision_at_20", "recall_at_5pct", "oof_auc_roc", "oof_auc_pr"
    )


# text ------------------------------------------------------------------------------------

def page_links(spark, d):
    return pg.page_anchors(sample.table(spark, d, "pages")).select("page_id", "url")


def page_text(spark, d):
    return pg.page_text(sample.table(spark, d, "pages")).select("page_id", "text")


def release_pages(spark: SparkSession, d: str) -> DataFrame:
    """Orders as rows of a release index page."""
    number = (F.lit(1000) + F.col("o_orderkey") % 9000).cast("string")
    row = F.concat(
        F.lit('<table><tr><td>AAER-'), number, F.lit('</td><td><a href="/lit/'), number, F.lit('.htm">'),
        F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit("</a></td><td>In the Matter of "), F.col("c_name"),
        F.lit(", Respondent</td></tr><tr><td>short</td></tr></table>"),
        F.lit('<a class="x" href="https://example.org/aaer/'), number, F.lit('">'), F.col("o_orderstatus"), F.lit("</a>"),
    )
    customers = sample.table(spark, d, "customer")
    return sample.table(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("page_id"), row.alias("html")
    )


def index_entries(spark, d):
    return pg.index_entries(release_pages(spark, d)).select("page_id", "kind", "url", "raw_text")


def releases(spark: SparkSession, d: str) -> DataFrame:
    """Orders as release texts in three layouts, some readable only in detail."""
    number = (F.lit(1000) + F.col("o_orderkey") % 9000).cast("string")
    kind = F.col("o_orderkey") % 4
    date = F.when(kind == 1, F.date_format("o_orderdate", "M/d/yyyy")).when(
        kind == 2, F.date_format("o_orderdate", "yyyy-MM-dd")
    ).otherwise(F.date_format("o_orderdate", "MMMM d, yyyy"))
    name = F.when(kind == 2, F.concat(F.lit("Complaint against "), F.col("c_name"), F.lit("; filed"))).otherwise(
        F.concat(F.lit("In the Matter of "), F.col("c_name"), F.lit(", Respondent"))
    )
    full = F.concat(F.lit("AAER No. "), number, F.lit(" | "), date, F.lit(" | "), name)
    customers = sample.table(spark, d, "customer")
    return sample.table(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("entry_no"), F.concat(F.lit("/r/"), number).alias("url"),
        F.when(kind == 3, F.concat(F.lit("AAER-"), number)).otherwise(full).alias("raw_text"), full.alias("detail_text"),
    )


def release_parse(spark, d):
    return parse_releases(releases(spark, d)).select("aaer_no", "fraud_date", "raw_name", "url")


def name_normalise(spark, d):
    raw = F.concat(
        F.upper("c_name"), F.lit(" & Holdings, Inc. /"), F.substring("c_mktsegment", 1, 2), F.lit("/ SIC:"),
        (F.col("c_custkey") % 9000).cast("string"), F.lit("- Oil"),
    )
    return sample.table(spark, d, "customer").select(
        "c_custkey", tx.strip_registry_noise(raw).alias("clean"),
        tx.normalise_name(tx.strip_registry_noise(raw)).alias("name"),
        tx.token_sorted(tx.normalise_name(F.concat(F.lit("the Zeta "), raw))).alias("sorted_name"),
    )


def _accused(spark: SparkSession, d: str) -> DataFrame:
    """Label names as they appear in releases: suffixes, order and typos differ."""
    label = sample.fraud_labels(spark, d)
    digits = F.col("cik").cast("bigint")
    typo = F.when(digits % 3 == 0, F.regexp_replace("company_name", "stomer", "stmer")).when(
        digits % 3 == 1, F.concat(F.lit("Corp. "), F.col("company_name"))).otherwise(F.upper("company_name"))
    return label.select("aaer_no", "fraud_date", F.concat(typo, F.lit(" Inc.")).alias("raw_name"))


def name_match(spark, d):
    master = sample.table(spark, d, "customer").select(
        sample.cik_of("c_custkey").alias("cik"), F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("ticker"),
        F.col("c_name").alias("title"),
    )
    return match.match_releases(_accused(spark, d), master)


def _seed_tables(spark: SparkSession, d: str, date: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    customers = sample.table(spark, d, "customer")
    key = F.col("c_custkey")
    master = customers.select(
        sample.cik_of("c_custkey").alias("cik"), F.concat(F.lit("T"), key.cast("string")).alias("ticker"),
        F.col("c_name").alias("title"),
    )
    filers = master.select(
        "cik", F.concat(F.col("title"), F.lit(" /NEW/SIC:3533- OIL")).alias("title"),
        F.when(F.col("cik").cast("bigint") % 2 == 0, F.array(F.lit("8-K"), F.lit("10-K405"))).otherwise(F.array(F.lit("8-K"))).alias("forms"),
    )
    seeds = customers.filter("c_custkey % 37 = 0").select(
        key.alias("seed_no"), F.col("c_name").alias("company_name"),
        F.when(key % 2 == 0, F.concat(F.lit("t"), key.cast("string"))).otherwise(F.lit("GONE")).alias("ticker"),
        F.make_date((F.lit(1999) + key % 3).cast("int"), F.lit(6), F.lit(15)).alias(date),
    )
    return seeds, master, filers


def seed_resolve(spark, d):
    return match.resolve_seeds(*_seed_tables(spark, d, "bankruptcy_date"), "bankruptcy_date")


# tables written and read back ----------------------------------------------------------------

def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _companies(spark: SparkSession, d: str) -> DataFrame:
    """Customers as a ticker master."""
    return sample.table(spark, d, "customer").select(
        sample.cik_of("c_custkey").alias("cik"), F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("ticker"), F.col("c_name").alias("title"),
    )


def stored_raw(spark, d):
    """The raw table of every third company, first written with other rows, then replaced."""
    docs = fx.parse_facts(facts_documents(spark, d), concepts=fx.BULK)
    listed = sample.table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.concat(F.lit(" t"), F.col("c_custkey").cast("string")).alias("ticker"))
    path = _folder(spark, "stored-raw")
    raw = sinks.write_table(dataset.raw_table(docs, _companies(spark, d), listed, 3), path)
    sinks.write_table(raw.filter("value > 0"), path, "concept")
    return sinks.read_table(spark, path).select("cik", "ticker", "company_name", "year", "concept", "value")


def stored_version(spark, d):
    path = _folder(spark, "stored-version")
    long = sample.raw_financials(spark, d)
    first = sinks.write_version(long.filter("year < 1996"), path, "1")
    return sinks.write_version(first.unionByName(long.filter("year >= 1996")), path, "2")


def stored_features(spark, d):
    return rounded(sinks.write_table(_features(spark, d), _folder(spark, "stored-features")).select("cik", "year", *fea.RATIO))


def stored_labelled(spark, d):
    return sinks.write_table(_labelled(spark, d), _folder(spark, "stored-labelled")).select("cik", "year", "label", "label_type")


def label_file(spark, d):
    path = _folder(spark, "labels")
    sinks.write_labels(sample.fraud_labels(spark, d), path)
    return masters.read_labels(spark, path).select("cik", "ticker", "company_name", "aaer_no", "fraud_date", "match_score")


def results_file(spark, d):
    path = _folder(spark, "results")
    sinks.write_results({"completeness": fea.completeness(_features(spark, d))}, path)
    return rounded(spark.read.schema("feature string, pct double").json(f"{path}/completeness"))


def seed_labels(spark, d):
    """Nations (a list of fixed size) as a caller's seed list."""
    nations = sample.table(spark, d, "nation").orderBy("n_nationkey").select("n_name", "n_nationkey").collect()
    return masters.seed_table(spark, [(r["n_name"], 1990 + r["n_nationkey"], None) for r in nations], "fraud_date", 12, 31)


def column_tolerance(spark, d):
    """A caller's frame without two of the concepts: an absent one is null, or the default given."""
    given = sample.company_panel(spark, d).drop("inventory", "goodwill")
    goodwill = pan.col_or_null(given, "goodwill", 1.5).alias("goodwill")
    return pan.with_columns_or_null(given, ("cash", "inventory")).select("cik", "year", "cash", "inventory", goodwill)


def revenue_change(spark, d):
    before = F.lag("revenue").over(Window.partitionBy("cik").orderBy("year"))
    return sample.company_panel(spark, d).select("cik", "year", F.round(num.pct_change(F.col("revenue"), before), 6).alias("change"))


def single_profile(spark, d):
    docs = fx.parse_facts(facts_documents(spark, d), concepts=fx.SINGLE)
    return dataset.financial_data(docs, _companies(spark, d))


def fraud_label_sources(spark, d):
    """Enforcement labels from firm-years, and from seeds where there are none."""
    firm = masters.normalise_firm_years(sample.table(spark, d, "orders").select(
        F.col("o_custkey").alias("cik"), F.year("o_orderdate").alias("year"), (F.col("o_totalprice") > 300000).cast("int").alias("misstate")
    ))
    seeds, master, filers = _seed_tables(spark, d, "fraud_date")
    wanted = ["cik", "ticker", "company_name", "aaer_no", "fraud_date", "match_score"]
    return dataset.fraud_labels(firm).select(F.lit("firm_years").alias("source"), *wanted).unionByName(
        dataset.fraud_labels(firm.limit(0), None, master, seeds, filers).select(F.lit("seeds").alias("source"), *wanted)
    )


def stream_refresh(spark, d):
    """Reports after two batches of filings and a replay of the second."""
    docs = materialize(facts_documents(spark, d).withColumn("half", F.pmod(F.xxhash64("json"), F.lit(2))), "stream-documents")
    store, reports = _folder(spark, "stream-store"), _folder(spark, "stream-reports")
    process = refresh.run_batch(lambda session: _companies(session, d), store, reports)
    for batch, half in ((0, 0), (1, 1), (1, 1)):
        parsed = fx.parse_facts(docs.filter(F.col("half") == half).select("json"), concepts=fx.SINGLE)
        process(parsed.withColumn("file", F.lit(None).cast("string")), batch)
    return rounded(refresh.current_reports(spark, reports))


# learning --------------------------------------------------------------------------------

def _training_table(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, float]]:
    """The labelled columns that the models read, landed, and the features' medians."""
    table = materialize(_labelled(spark, d).select("cik", "year", "is_fraud", *fea.TRAINED), "labelled")
    return table, {f: v[0] if v[0] is not None else 0.0 for f, v in exact_quantiles(table, list(fea.TRAINED), [0.5], landed=True).items()}


def _filled_rows(table: DataFrame, medians: dict[str, float]) -> DataFrame:
    return materialize(
        table.select("cik", "year", F.col("is_fraud").alias("y"), models.feature_array(list(fea.TRAINED), medians).alias("features")),
        "rows",
    )


def _array_rows(spark: SparkSession, d: str) -> DataFrame:
    """(cik, year, y, features): the features the models train on, missing ones at their median."""
    return _filled_rows(*_training_table(spark, d))


def class_weight(spark, d):
    rows = materialize(_labelled(spark, d).select("is_fraud", "is_bankrupt"), "labels")
    counts = {t: smote.class_counts(rows, t) for t in ("is_fraud", "is_bankrupt")}
    return rounded(spark.createDataFrame(
        [(t, pos, smote.positive_weight(n, pos)) for t, (n, pos) in counts.items()], "target string, pos bigint, weight double"
    ))


def smote_rows(spark, d):
    rows = _array_rows(spark, d)
    n, pos = smote.class_counts(rows)
    made = smote.synthetic_rows(rows.filter("y = 1"), n - 2 * pos, pos)
    return made.select("cik", "year", "copy", "nb", F.round("gap", 6).alias("gap"), F.round(F.get("features", F.lit(0)), 6).alias("f_current_ratio"))


def iso_scores(spark, d):
    rows = _array_rows(spark, d)
    n, _ = smote.class_counts(rows)
    arrays = isolation.forest_arrays(isolation.grow_forest(rows, n))
    return rows.select("cik", "year", F.round(isolation.anomaly(arrays, n, F.col("features")), 6).alias("anomaly"))


def iso_small(spark, d):
    """Three trees of sixteen rows each, which SQL can grow as well."""
    rows = _array_rows(spark, d)
    n, _ = smote.class_counts(rows)
    arrays = isolation.forest_arrays(isolation.grow_forest(rows, n, trees=3, sample=16, seed=7))
    return rows.select("cik", "year", F.round(isolation.anomaly(arrays, n, F.col("features"), sample=16), 6).alias("anomaly"))


def _one_tree(rows: DataFrame) -> list[boosting.Tree]:
    """One tree over all rows, cut at eighths of each feature: small enough for SQL to find the same splits."""
    names = list(fea.TRAINED)
    wide = materialize(rows.select(*[F.get("features", F.lit(i)).alias(c) for i, c in enumerate(names)]), "tree-columns")
    eighths = exact_quantiles(wide, names, [k / 8 for k in range(1, 8)], landed=True)
    cuts = {0: [np.unique(np.array(eighths[c], float)) for c in names]}
    n, pos = smote.class_counts(rows)
    weight = F.when(F.col("y") == 1, F.lit(float(max((n - pos) // max(pos, 1), 1)))).otherwise(1.0)
    training = rows.select(
        F.lit(0).alias("grp"), boosting.row_key(0, "cik", "year").alias("key"), F.col("y").cast("double").alias("y"), weight.alias("w"), "features"
    )
    settings = boosting.Settings(trees=1, depth=2, learning_rate=0.3, min_child=8, gamma=0.1, row_share=1.0, feature_share=1.0, bins=8)
    return boosting.fit(training, len(names), settings, cuts)[0]


def boost_tree(spark, d):
    trees = _one_tree(_array_rows(spark, d))
    names = F.array(*[F.lit(c) for c in fea.TRAINED])
    inner = F.col("feature") >= 0
    return boosting.to_table(spark, {0: trees}).select(
        "node", F.when(inner, F.get(names, F.col("feature"))).alias("feature"), F.when(inner, F.round("threshold", 6)).alias("threshold"),
        F.round("gain", 6).alias("gain"), F.round("cover", 6).alias("cover"), F.round("value", 6).alias("value"),
    )


def boost_margins(spark, d):
    rows = _array_rows(spark, d)
    trees = _one_tree(rows)
    return rows.select("cik", "year", F.round(boosting.margin(trees, F.col("features")), 6).alias("margin"))


def tree_attribution(spark, d):
    rows = _array_rows(spark, d)
    trees = _one_tree(rows)
    used = sorted({int(f) for tree in trees for f in tree.feature if f >= 0})
    phi = attribution.attributions(attribution.leaf_paths(trees), F.col("features"))
    shown = rows.select("cik", "year", phi.alias("phi")).select("cik", "year", *[F.get("phi", F.lit(f)).alias(fea.TRAINED[f]) for f in used])
    return shown.unpivot(["cik", "year"], [fea.TRAINED[f] for f in used], "feature", "phi").withColumn("phi", F.round("phi", 6))


def model_scores(spark, d):
    """A model of one tree and three small isolation trees, saved, loaded, and applied to the labelled table with its gaps."""
    table, medians = _training_table(spark, d)
    rows = _filled_rows(table, medians)
    trees = _one_tree(rows)
    n, _ = smote.class_counts(rows)
    forest = materialize(isolation.grow_forest(rows, n, trees=3, sample=16, seed=7), "small-forest")
    raw = rows.select(isolation.anomaly(isolation.forest_arrays(forest), n, F.col("features")).alias("a"))
    low, high = raw.agg(F.min("a"), F.max("a")).first()
    names = list(fea.TRAINED)
    path = _folder(spark, "small-model")
    models.FittedRiskModel(models.fraud_model(max_depth=2), names, medians, trees, forest, n, low, high).save(path)
    scored = models.FittedRiskModel.load(spark, path).predict(table, explain=False)
    return rounded(scored.select("cik", "year", "score", "xgb_prob", "iso_score"))


def stored_tree(spark, d):
    """The tree's margins after its node table was written and read back."""
    rows = _array_rows(spark, d)
    trees = _one_tree(rows)
    nodes = sinks.write_table(boosting.to_table(spark, {0: trees}), _folder(spark, "stored-tree"))
    again = boosting.from_table(nodes, 2)[0]
    return rows.select("cik", "year", F.round(boosting.margin(again, F.col("features")), 6).alias("margin"))


def tree_importance(spark, d):
    rows = _array_rows(spark, d)
    trees = _one_tree(rows)
    phi = rows.select(attribution.attributions(attribution.leaf_paths(trees), F.col("features")).alias("phi"))
    return attribution.importance(phi, list(fea.TRAINED), models.FEATURE_LABELS)


def tree_top3(spark, d):
    rows = _array_rows(spark, d)
    trees = _one_tree(rows)
    told = rows.withColumn("phi", attribution.attributions(attribution.leaf_paths(trees), F.col("features")))
    top = attribution.top_features(F.col("phi"), F.col("features"), list(fea.TRAINED), models.FEATURE_LABELS)
    return told.select("cik", "year", F.inline(top))


def feature_names(spark, d):
    names = F.create_map(*[F.lit(x) for pair in models.FEATURE_LABELS.items() for x in pair])
    table = fea.completeness(_features(spark, d))
    return rounded(table.select("feature", F.coalesce(names[F.col("feature")], F.col("feature")).alias("label"), "pct"))


def _fitted(spark: SparkSession, d: str, model: models.RiskModel) -> tuple[models.FittedRiskModel, DataFrame]:
    train, test = lab.holdout_split(materialize(_labelled(spark, d, _MODELLED), "labelled"), CUTOFF)
    return model.fit(train, True), test


def _scores(spark: SparkSession, d: str, model: models.RiskModel) -> DataFrame:
    fitted, test = _fitted(spark, d, model)
    return rounded(fitted.predict(test, explain=False).select("cik", "year", model.target, "score", "xgb_prob", "iso_score"))


def _top3(spark: SparkSession, d: str, model: models.RiskModel) -> DataFrame:
    fitted, test = _fitted(spark, d, model)
    return fitted.predict(test).select("cik", "year", F.inline("top3"))


def _importance(spark: SparkSession, d: str, model: models.RiskModel) -> DataFrame:
    fitted, test = _fitted(spark, d, model)
    return fitted.importance(test)


def _folds(spark: SparkSession, d: str, model: models.RiskModel) -> DataFrame:
    return ev.walk_forward(model, materialize(_labelled(spark, d, _MODELLED), "labelled"), 3, 2, 2, True)["folds"]


def gbt_scores(spark, d):
    return _scores(spark, d, models.fraud_model())


def attribution_top3(spark, d):
    return _top3(spark, d, models.fraud_model())


def feature_importance(spark, d):
    return _importance(spark, d, models.fraud_model())


def oof_metrics(spark, d):
    return _folds(spark, d, models.fraud_model())


def distress_gbt_scores(spark, d):
    return _scores(spark, d, models.distress_model())


def distress_attribution_top3(spark, d):
    return _top3(spark, d, models.distress_model())


def distress_feature_importance(spark, d):
    return _importance(spark, d, models.distress_model())


def distress_oof_metrics(spark, d):
    return _folds(spark, d, models.distress_model())
