"""Fraud and distress risk models: boosted trees blended with an anomaly score."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finsieve.functions.numeric import ensemble
from finsieve.operators import attribution, boosting, isolation, smote
from finsieve.operators.features import TRAINED
from finsieve.operators.quantiles import exact_quantiles
from finsieve.session import drop, materialize, scratch

# Display names of the trained features.
FEATURE_LABELS = {
    "f_current_ratio": "Current Ratio", "f_quick_ratio": "Quick Ratio", "f_cash_ratio": "Cash Ratio",
    "f_debt_equity": "Debt / Equity", "f_debt_assets": "Debt / Assets", "f_interest_coverage": "Interest Coverage",
    "f_gross_margin": "Gross Margin", "f_ebit_margin": "EBIT Margin", "f_net_margin": "Net Margin",
    "f_roa": "Return on Assets", "f_roe": "Return on Equity", "f_asset_turnover": "Asset Turnover",
    "f_dso": "Days Sales Outstanding", "f_dio": "Days Inventory Outstanding", "f_cfo_ni": "CFO / Net Income Ratio",
    "f_cfo_revenue": "CFO / Revenue", "f_capex_revenue": "CapEx / Revenue",
    "f_goodwill_assets": "Goodwill + Intangibles / Assets",
    "f_yoy_revenue": "Revenue Growth (YoY)", "f_yoy_cfo": "CFO Growth (YoY)",
    "f_yoy_receivables": "Receivables Growth (YoY)", "f_yoy_assets": "Asset Growth (YoY)",
    "f_yoy_net_income": "Net Income Growth (YoY)", "f_yoy_debt": "Debt Growth (YoY)",
    "f_rev_cfo_divergence": "Revenue–CFO Growth Divergence",
    "f_trend_current_ratio": "Current Ratio Trend (3yr)", "f_trend_gross_margin": "Gross Margin Trend (3yr)",
    "f_trend_net_margin": "Net Margin Trend (3yr)", "f_trend_cfo_ni": "CFO/NI Trend (3yr)",
    "f_trend_debt_equity": "Debt/Equity Trend (3yr)", "f_trend_roa": "ROA Trend (3yr)",
    "f_trend_dso": "DSO Trend (3yr)", "f_trend_cfo_rev": "CFO/Revenue Trend (3yr)",
    "f_interact_rev_up_cfo_dn": "Revenue ↑ while CFO ↓", "f_interact_dso_rev": "Rising DSO + Growing Revenue",
    "f_interact_ni_pos_cfo_neg": "Positive NI but Negative CFO", "f_interact_lev_cov": "Rising Leverage + Weak Coverage",
    "f_sloan_accrual": "Sloan Accrual Ratio", "f_total_accruals": "Total Accruals / Assets",
    "f_cash_roa_gap": "Cash ROA Gap",
    "f_b_dsri": "Beneish: Receivables Index (DSRI)", "f_b_gmi": "Beneish: Gross Margin Index (GMI)",
    "f_b_aqi": "Beneish: Asset Quality Index (AQI)", "f_b_sgi": "Beneish: Sales Growth Index (SGI)",
    "f_b_depi": "Beneish: Depreciation Index (DEPI)", "f_b_sgai": "Beneish: SGA Index (SGAI)",
    "f_b_lvgi": "Beneish: Leverage Index (LVGI)", "f_b_tata": "Beneish: Total Accruals (TATA)",
    "f_z_x1": "Altman: Working Capital / Assets", "f_z_x2": "Altman: Retained Earnings / Assets",
    "f_z_x3": "Altman: EBIT / Assets", "f_z_x5": "Altman: Revenue / Assets",
}


@dataclass(frozen=True)
class RiskModel:
    """Training settings of one target."""

    target: str
    name: str
    max_depth: int = 5
    trees: int = 400
    learning_rate: float = 0.05
    min_child: float = 5
    gamma: float = 0.0
    alpha: float = 0.1
    reg_lambda: float = 1.0
    row_share: float = 0.8
    feature_share: float = 0.8
    bins: int = 256
    forest_trees: int = isolation.TREES
    seed: int = 42
    features: tuple[str, ...] = TRAINED

    def settings(self) -> boosting.Settings:
        return boosting.Settings(
            self.trees, self.max_depth, self.learning_rate, self.min_child, self.gamma, self.alpha, self.reg_lambda, self.row_share,
            self.feature_share, self.bins, self.seed,
        )

    def fit(self, df: DataFrame, landed: bool = False) -> "FittedRiskModel":
        """Medians, boosted trees and anomaly forest from the rows given; ``landed`` says that these are rows of a landed table."""
        return self.fit_many({0: df}, landed)[0]

    def fit_many(self, parts: dict[int, DataFrame], landed: bool = False) -> dict[int, "FittedRiskModel"]:
        """One model per group of rows, such as the training side of each fold; the trees of all groups grow in the same jobs.

        Rows are landed once per group. Medians and weights come from a group's own rows and are stored with its model. Of what is
        landed on the way only the forests stay.
        """
        with scratch(next(iter(parts.values())).sparkSession) as keep:
            fitted = self._fit_many(parts, landed)
            for model in fitted.values():
                keep(model.forest)
        return fitted

    def _fit_many(self, parts: dict[int, DataFrame], landed: bool) -> dict[int, "FittedRiskModel"]:
        available = [f for f in self.features if all(f in df.columns for df in parts.values())]
        prepared = {g: self._prepare(df, available, landed) for g, df in parts.items()}
        training = None
        for g, (_, rows, n, pos) in prepared.items():
            weight = F.when(F.col("y") == 1, F.lit(float(smote.positive_weight(n, pos)))).otherwise(1.0)
            some = smote.oversample(rows, self.seed).select(
                F.lit(g).cast("int").alias("grp"), boosting.row_key(self.seed, "cik", "year", "copy").alias("key"),
                F.col("y").cast("double").alias("y"), weight.alias("w"), "features",
            )
            training = some if training is None else training.unionByName(some)
        trees = boosting.fit(training, len(available), self.settings())
        return {g: self._finish(available, medians, rows, n, trees[g]) for g, (medians, rows, n, _) in prepared.items()}

    def _prepare(self, df: DataFrame, available: list[str], landed: bool) -> tuple[dict[str, float], DataFrame, int, int]:
        train = df.select("cik", "year", F.col(self.target).cast("int").alias("y"), *available)
        if not landed:
            train = materialize(train, f"{self.name}-train")
        medians = {f: v[0] if v[0] is not None else 0.0 for f, v in exact_quantiles(train, available, [0.5], landed=True).items()}
        rows = materialize(train.select("cik", "year", "y", feature_array(available, medians).alias("features")), f"{self.name}-rows")
        if not landed:
            drop(train)
        return medians, rows, *smote.class_counts(rows)

    def _finish(self, available: list[str], medians: dict[str, float], rows: DataFrame, n: int, trees: list[boosting.Tree]) -> "FittedRiskModel":
        forest = materialize(isolation.grow_forest(rows, n, self.forest_trees, seed=self.seed), f"{self.name}-forest")
        raw = rows.select(isolation.anomaly(isolation.forest_arrays(forest), n, F.col("features")).alias("a"))
        low, high = raw.agg(F.min("a"), F.max("a")).first()
        return FittedRiskModel(self, available, medians, trees, forest, n, low, high)


def fraud_model(**changes) -> RiskModel:
    """Shallow trees for the rarer, subtler class."""
    own = dict(target="is_fraud", name="fraud_model", max_depth=4, trees=500, learning_rate=0.04, min_child=8, gamma=0.1)
    return RiskModel(**{**own, **changes})


def distress_model(**changes) -> RiskModel:
    """Deeper trees: distress leaves clearer traces."""
    own = dict(target="is_bankrupt", name="distress_model", max_depth=6, trees=400, learning_rate=0.05, min_child=3, gamma=0.05)
    return RiskModel(**{**own, **changes})


def feature_array(names: list[str], fill: dict[str, float]) -> Column:
    return F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(float(fill[n]))) for n in names])


@dataclass
class FittedRiskModel:
    spec: RiskModel
    features: list[str]
    medians: dict[str, float]
    trees: list[boosting.Tree]
    forest: DataFrame
    n_train: int
    low: float
    high: float
    _leaves: list | None = field(default=None, repr=False)
    _arrays: list | None = field(default=None, repr=False)

    def predict(self, df: DataFrame, fill: str = "median", explain: bool = True) -> DataFrame:
        """Adds score, xgb_prob, iso_score and, with ``explain``, top3.

        ``fill='zero'`` replaces missing inputs by 0 instead of the training
        median, the convention for single records.
        """
        have = df.select("*", *[F.lit(None).cast("double").alias(f) for f in self.features if f not in df.columns])
        values = self.medians if fill == "median" else {f: 0.0 for f in self.features}
        rows = have.withColumn("_x", feature_array(self.features, values))
        if self._arrays is None:
            self._arrays = isolation.forest_arrays(self.forest)
        spread = (self.high - self.low) or 1.0
        anomaly = (isolation.anomaly(self._arrays, self.n_train, F.col("_x")) - self.low) / spread
        out = rows.withColumn("xgb_prob", 1 / (1 + F.exp(-boosting.margin(self.trees, F.col("_x"))))).withColumn("iso_score", anomaly)
        out = out.withColumn("score", ensemble(F.col("xgb_prob"), F.col("iso_score")))
        extra = []
        if explain:
            out = out.withColumn("_phi", attribution.attributions(self.leaves(), F.col("_x")))
            extra = [attribution.top_features(F.col("_phi"), F.col("_x"), self.features, FEATURE_LABELS).alias("top3")]
        return out.select(*df.columns, "score", "xgb_prob", "iso_score", *extra)

    def predict_record(self, spark: SparkSession, record: dict[str, float]) -> dict:
        """One company-year given as a dict; missing features count as 0."""
        one = spark.createDataFrame([tuple(record.get(f) for f in self.features)], ", ".join(f"{f} double" for f in self.features))
        row = self.predict(one, fill="zero").first()
        return {
            "score": round(row["score"], 4), "xgb_prob": round(row["xgb_prob"], 4), "iso_score": round(row["iso_score"], 4),
            "top3": [t.asDict() for t in row["top3"]],
        }

    def leaves(self) -> list[tuple]:
        if self._leaves is None:
            self._leaves = attribution.leaf_paths(self.trees)
        return self._leaves

    def attributions(self, df: DataFrame, fill: str = "zero") -> DataFrame:
        """(phi) per row of ``df``."""
        values = self.medians if fill == "median" else {f: 0.0 for f in self.features}
        return df.select(attribution.attributions(self.leaves(), feature_array(self.features, values)).alias("phi"))

    def importance(self, df: DataFrame, n: int = 20) -> DataFrame:
        return attribution.importance(self.attributions(df), self.features, FEATURE_LABELS, n)

    def save(self, path: str) -> None:
        """Trees, forest and settings under one folder."""
        spark = self.forest.sparkSession
        boosting.to_table(spark, {0: self.trees}).write.mode("overwrite").parquet(f"{path}/trees")
        self.forest.write.mode("overwrite").parquet(f"{path}/forest")
        settings = {
            "spec": asdict(self.spec), "features": self.features, "medians": self.medians, "n_train": self.n_train,
            "low": self.low, "high": self.high,
        }
        spark.createDataFrame([(json.dumps(settings),)], "value string").write.mode("overwrite").text(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FittedRiskModel":
        s = json.loads(spark.read.text(f"{path}/settings").first()["value"])
        spec = RiskModel(**{**s["spec"], "features": tuple(s["spec"]["features"])})
        return FittedRiskModel(
            spec, s["features"], s["medians"], boosting.from_table(spark.read.parquet(f"{path}/trees"), spec.max_depth).get(0, []),
            spark.read.parquet(f"{path}/forest"), s["n_train"], s["low"], s["high"],
        )
