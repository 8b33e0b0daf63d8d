"""Incremental refresh: newly landed filings update the reports they touch.

Observations and reports live in keyed stores (see :mod:`finsieve.streaming.store`): the newest observation per company, tag,
period and form, and the newest report per company. A batch may run again after a failure. Only companies of the batch are
recomputed, and only their buckets are read, in a number of files that does not grow with the number of batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from finsieve.functions.text import pad_cik
from finsieve.operators import ingest
from finsieve.operators.panel import company_year, history
from finsieve.operators.scores import company_signals
from finsieve.plans.report import header
from finsieve.session import materialize
from finsieve.sources import facts as fx
from finsieve.streaming.store import Store

KEY = ("cik", "concept", "priority", "tag", "start", "end", "form")


def observation_store(spark: SparkSession, store: str) -> Store:
    return Store(spark, store, KEY, ("filed", "val"))


def report_store(spark: SparkSession, reports: str) -> Store:
    return Store(spark, reports, ("cik",), ("batch",))


def read_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Company-facts files as they land."""
    return (
        spark.readStream.schema(fx.facts_schema(fx.all_tags(fx.SINGLE)).add("_corrupt", "string")).option("multiLine", True)
        .option("columnNameOfCorruptRecord", "_corrupt").option("maxFilesPerTrigger", max_files).json(path)
        .withColumn("file", F.col("_metadata.file_name"))
    )


def land(batch: DataFrame, batch_id: int, store: str) -> tuple[DataFrame, list[int]]:
    """Lands the batch's observations; returns its companies and the buckets they are in.

    The key falls back to the digits of the file name, as in the batch reader.
    Files that cannot be read land in ``<store>-rejects``.
    """
    readable, bad = fx.split_rejects(batch.withColumn("cik", pad_cik(fx.company_key("file"))))
    bad.select("file", F.col("_corrupt").alias("content")).write.mode("overwrite").parquet(f"{store}-rejects/batch={batch_id}")
    obs = materialize(fx.observations(readable, fx.SINGLE), "stream-batch")
    return obs.select("cik").distinct(), observation_store(batch.sparkSession, store).append(obs, batch_id)


def refresh(spark: SparkSession, store: str, companies: DataFrame, buckets: list[int], master: DataFrame) -> DataFrame:
    """Report header of the given companies, from all their observations."""
    mine = observation_store(spark, store).read(buckets).join(companies, "cik", "left_semi")
    annual = fx.annual(mine, "single")
    long = ingest.with_ticker(ingest.pick_tags(ingest.latest_filed(annual)), master)
    return header(company_signals(history(company_year(long))))


def run_batch(master: Callable[[SparkSession], DataFrame], store: str, reports: str) -> Callable[[DataFrame, int], None]:
    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        companies, buckets = land(batch, batch_id, store)
        if buckets:
            made = refresh(spark, store, companies, buckets, master(spark)).withColumn("batch", F.lit(batch_id).cast("long"))
            report_store(spark, reports).append(made, batch_id)
        for kept in (observation_store(spark, store), report_store(spark, reports)):
            kept.fold()

    return process


def start(
    spark: SparkSession, incoming: str, store: str, reports: str, checkpoint: str,
    master: Callable[[SparkSession], DataFrame], once: bool = False,
) -> StreamingQuery:
    """Starts the refresh; ``once`` handles what has landed and stops."""
    writer = read_stream(spark, incoming).writeStream.foreachBatch(run_batch(master, store, reports)).option(
        "checkpointLocation", checkpoint
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def current_reports(spark: SparkSession, reports: str) -> DataFrame:
    """Newest report of every company."""
    return report_store(spark, reports).read().drop("batch")
