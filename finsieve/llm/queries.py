"""Queries over the given tables, one per operator of this subpackage, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsieve.llm import (
    chat, decontaminate, exact_dedup, kd_sharding, line_dedup, lm_scoring, ngram_join, periodic_runs, pieces, quality, substring_dedup, toxicity, whitening,
)
from finsieve.llm.shared import crc_of_id, documents, table
from finsieve.llm.sql import SQL


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(documents(spark, sf_dir))


def op5_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "text_score", "page_score", "quality_score", (F.col("quality_score") >= 0.5).alias("kept"))


def op6_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_sharding.shard(documents(spark, sf_dir), 40)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(documents(spark, sf_dir), pieces.read_vocabulary())


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links", "class_size")


def op9_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


def _repeat_stretch(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every tenth text, by the checksum of its id, repeats a stretch of its words to its end."""
    counts = np.diff(first)
    g = h // 10
    a = g % np.maximum(counts, 1)
    p = 1 + (counts - a) // (3 + g % 8)
    row = np.repeat(np.arange(len(counts)), counts)
    i = np.arange(len(row)) - first[row]
    source = np.where((h[row] % 10 == 0) & (i >= a[row]), a[row] + (i - a[row]) % p[row], i) + first[row]
    return starts[source], ends[source]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse(documents(spark, sf_dir).withColumn("checksum", crc_of_id()), _repeat_stretch, "checksum")
    shown = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(shown, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


__all__ = ["QUERIES", "SQL"]

QUERIES = {f.__name__: f for f in (
    op1_benchmark_decontamination, op2_chat_formatting, op3_lm_scoring, op4_exact_dedup, op5_quality_cotraining, op6_kd_sharding, op7_sentencepiece,
    op8_ngram_jaccard_join, op9_toxicity_cnn, op10_line_dedup,
    op11_substring_dedup, op12_periodic_runs, op13_embedding_whitening,
)}
