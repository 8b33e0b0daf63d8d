"""Corpus preparation in stages; each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsieve.llm import decontaminate, exact_dedup, ngram_join, pieces, quality
from finsieve.llm.shared import table
from finsieve.session import bounded_batches, materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose combined co-trained score is 0.5 or more stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.keep_unique(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked at five-word Jaccard 0.8 or more the smallest id stays."""
    return ngram_join.keep_one_per_class(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds piece ids, their number, and whether they decode to the text."""
    return pieces.encode(docs, pieces.read_vocabulary(), restored="restored").withColumn("n_pieces", F.size("ids"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _bounded(stage: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality classifier", _bounded(quality_stage)),
    ("exact dedup", _bounded(exact_dedup_stage)),
    ("n-gram Jaccard join", _bounded(near_dedup_stage)),
    ("benchmark decontamination", _bounded(decontamination_stage)),
    ("SentencePiece encoding", _bounded(sentencepiece_stage)),
]

#: The first stage is a trained classifier, so SQL cannot give the rows; tests/llm holds the stages' operators against brute force or held-out rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.lower().replace(" ", "-"))
    return docs
