"""Writers. A path is never overwritten while it is being read.

A replaced table is a folder of versions and a pointer file that names the current one. A version is written whole before the
pointer is renamed into place in one step, so a writer that dies half-way leaves the earlier version readable; readers that have
begun on it can end, as the last ``KEPT`` versions stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEPT = 2
_POINTER = "_current"


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, conf, where, where.getFileSystem(conf)


def write_pointer(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a small text file in one step: written beside it, then renamed over it."""
    jvm, conf, where, fs = _files(spark, path)
    where = fs.makeQualified(where)
    fs.mkdirs(where.getParent())
    fresh = jvm.org.apache.hadoop.fs.Path(where.getParent(), f"_new-{uuid.uuid4().hex}")
    stream = fs.create(fresh, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), conf).rename(fresh, where, options)


def read_pointer(spark: SparkSession, path: str) -> str | None:
    """The text of a pointer file, None where there is none."""
    jvm, _, where, fs = _files(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, oldest first."""
    _, _, where, fs = _files(spark, path)
    if not fs.exists(where):
        return []
    found = [s for s in fs.listStatus(where) if s.isDirectory()]
    return [s.getPath().getName() for s in sorted(found, key=lambda s: (s.getModificationTime(), s.getPath().getName()))]


def drop_folder(spark: SparkSession, path: str) -> None:
    _, _, where, fs = _files(spark, path)
    fs.delete(where, True)


def _replace(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Writes a version by ``write(folder)`` and makes it the current one; returns its folder."""
    name = f"v-{uuid.uuid4().hex}"
    write(f"{path}/{name}")
    before = read_pointer(spark, f"{path}/{_POINTER}")
    write_pointer(spark, f"{path}/{_POINTER}", name)
    old = [v for v in folders(spark, path) if v.startswith("v-") and v not in (name, before)]
    for stale in old[:max(0, len(old) - (KEPT - 2))]:
        drop_folder(spark, f"{path}/{stale}")
    return f"{path}/{name}"


def current_folder(spark: SparkSession, path: str) -> str:
    """The folder that holds the current version of a replaced table."""
    name = read_pointer(spark, f"{path}/{_POINTER}")
    if name is None:
        raise FileNotFoundError(f"{path} holds no finished table")
    return f"{path}/{name}"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(current_folder(spark, path))


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """Parquet, replaced as a whole; returns the table read back."""
    writer = df.write
    if partition_by:
        # the rebalance hint splits a large value over tasks and packs small ones
        writer = df.hint("rebalance", F.col(partition_by)).write.partitionBy(partition_by)
    return df.sparkSession.read.parquet(_replace(df.sparkSession, path, writer.parquet))


def write_version(df: DataFrame, base: str, version: str) -> DataFrame:
    """A new version folder next to the old ones: safe when ``df`` reads one of them."""
    df.write.mode("errorifexists").parquet(f"{base}/version={version}")
    return df.sparkSession.read.parquet(f"{base}/version={version}")


def _swap(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Writes beside ``path`` and moves the finished folder to it; a writer that fails leaves ``path`` as it was."""
    jvm, _, where, fs = _files(spark, path)
    fresh = f"{path}-new-{uuid.uuid4().hex}"
    write(fresh)
    fs.delete(where, True)
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(fresh), where):
        raise OSError(f"{fresh} could not be moved to {path}")


def write_labels(df: DataFrame, path: str) -> None:
    """Label CSV with a header."""
    _swap(df.sparkSession, path, df.write.option("header", True).csv)


def write_results(results: dict[str, DataFrame], path: str) -> None:
    """One JSON folder per result table."""
    for name, df in results.items():
        _swap(df.sparkSession, f"{path}/{name}", df.write.json)


def as_json(df: DataFrame) -> DataFrame:
    """Rows as JSON text, for a single result document."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
