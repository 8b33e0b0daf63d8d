"""Session set-up and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(app: str = "finsieve", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library is tuned for.

    Nothing here is required by the operators; a cluster session with its own
    sizes works as well. Shuffle partitions are left to AQE, which coalesces
    small ones and splits skewed join partitions.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only where the session names none (local runs, tests) a temporary folder
    is chosen, and only when the master is local.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
    chosen = tempfile.mkdtemp(prefix="finsieve-")
    spark.conf.set(CHECKPOINT_DIR, chosen)
    return chosen


#: Bytes of rows that travel to a Python worker, and are held there, at once.
_BATCH_BYTES = str(4 << 20)
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """From now on rows travel to Python workers in batches of about 4 MB, unless the session has a limit of its own.

    Spark's default of 10,000 rows knows no bytes: with texts of a few KB a batch is held several times over, by the JVM outside
    its heap and by the worker. The setting stays, as a returned table is read after its query has been built.
    """
    if spark.conf.get(_BATCH_LIMIT, None) is None:
        spark.conf.set(_BATCH_LIMIT, _BATCH_BYTES)


#: The JVM compiles no method of more bytes than this, it interprets it.
_COMPILED_BYTES = "8000"
_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


@contextmanager
def _held(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def compiled_methods(spark: SparkSession):
    """While it holds, a wide projection whose fused method would be too long to be compiled is split into short ones."""
    return _held(spark, _METHOD_LIMIT, _COMPILED_BYTES)


@contextmanager
def file_by_file(spark: SparkSession) -> Iterator[None]:
    """Tables of small files that are planned while it holds have one partition per file."""
    with _held(spark, "spark.sql.files.maxPartitionBytes", str(1 << 30)), _held(spark, "spark.sql.files.openCostInBytes", str(1 << 31)):
        yield


#: Shuffle files of a finished query go at its end, not when the driver next collects garbage.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Cuts lineage without depending on executor-local blocks: a lost executor
    costs a re-read of files, not a re-run of the plan. Used where a result is
    consumed by several jobs (quantile fitting, model training, rank metrics).
    What was shuffled for it is removed once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _landed.append(path)
    scopes = _scopes.get(threading.get_ident())
    if scopes:
        scopes[-1].append(path)
    with compiled_methods(spark), _held(spark, _SHUFFLE_CLEANUP, "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._landed_at = path
    return out


_landed: list[str] = []
#: What each open :func:`scratch` of a thread has landed, the innermost last; plain values, as modules travel with the job.
_scopes: dict[int, list[list[str]]] = {}


def remove(spark: SparkSession, name: str) -> None:
    """Removes a folder of the shared store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for name in paths:
        if name in _landed:
            remove(spark, name)
            _landed.remove(name)


def drop(*tables: DataFrame) -> None:
    """Removes tables that :func:`materialize` returned, once nothing reads them any more."""
    for table in tables:
        _delete(table.sparkSession, [table._landed_at])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables landed while it holds are removed at its end, but for those its value was called with; these must be
    landed themselves, not just read landed tables."""
    scopes = _scopes.setdefault(threading.get_ident(), [])
    mine, kept = [], []
    scopes.append(mine)

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table._landed_at)
        return table

    try:
        yield keep
    finally:
        scopes.pop()
        if scopes:
            scopes[-1].extend(kept)
        else:
            del _scopes[threading.get_ident()]
        _delete(spark, [path for path in mine if path not in kept])


def drop_landed(spark: SparkSession, label: str = "") -> int:
    """Removes the tables :func:`materialize` has landed so far, or those of one label; call it when no result that reads
    them is needed any more."""
    chosen = [p for p in _landed if not label or f"/{label}-" in p]
    _delete(spark, chosen)
    return len(chosen)


def with_checkpoint_dir(spark: SparkSession) -> None:
    """Point RDD checkpoints (used by tree training) at the shared folder, unless
    the session already has a checkpoint folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_dir(spark)}/rdd")
