"""A keyed store that takes batches and is read by key: the newest row per key, from base files and the batches since.

A batch lands as a delta, by bucket of the owner column; a replayed batch replaces its own delta, and one already folded into the
base changes nothing. After ``FOLD_AFTER`` deltas they are folded: the buckets they touch are rewritten, the others stay where
they are, and one pointer that names each bucket's base folder moves everything over in one step. So a reader of some owners opens
one base part and at most ``FOLD_AFTER`` deltas per bucket, however many batches there were. Buckets are as many as the owners
need and are dealt anew when these have outgrown them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from finsieve.sources import sinks

FOLD_AFTER = 8
PER_BUCKET = 512
LEAST_BUCKETS = 16


@dataclass
class Store:
    """Rows of ``path``; ``keys`` tell rows apart, ``newest`` orders rows of one key, ``owner`` is what is read by."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    newest: tuple[str, ...]
    owner: str = "cik"

    def state(self) -> dict:
        """buckets, folded (last batch in the base), base (bucket to folder)."""
        text = sinks.read_pointer(self.spark, f"{self.path}/_state")
        return json.loads(text) if text else {"buckets": LEAST_BUCKETS, "folded": -1, "base": {}, "schema": None}

    def bucket_of(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.owner), F.lit(buckets)).cast("int")

    def _deltas(self, state: dict) -> list[int]:
        found = [int(f.removeprefix("batch-")) for f in sinks.folders(self.spark, f"{self.path}/delta") if f.startswith("batch-")]
        return sorted(b for b in found if b > state["folded"])

    def append(self, batch: DataFrame, batch_id: int) -> list[int]:
        """Lands a batch; returns the buckets it touches."""
        state = self.state()
        if state["schema"] is None:
            state["schema"] = batch.schema.jsonValue()
            sinks.write_pointer(self.spark, f"{self.path}/_state", json.dumps(state))
        where = f"{self.path}/delta/batch-{batch_id}"
        self._newest(batch).withColumn("bucket", self.bucket_of(state["buckets"])).repartition("bucket").sortWithinPartitions(
            "bucket", self.owner
        ).write.mode("overwrite").partitionBy("bucket").parquet(where)
        return sorted(int(f.removeprefix("bucket=")) for f in sinks.folders(self.spark, where) if f.startswith("bucket="))

    def _newest(self, rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c not in self.keys]
        best = rows.groupBy(*self.keys).agg(F.max(F.struct(*self.newest, *[c for c in values if c not in self.newest])).alias("r"))
        return best.select(*[c if c in self.keys else F.col(f"r.{c}").alias(c) for c in rows.columns])

    def files_of(self, buckets: list[int] | None = None) -> list[str]:
        """The folders a read of these buckets opens."""
        state = self.state()
        base = [folder for b, folder in state["base"].items() if buckets is None or int(b) in buckets]
        deltas = []
        for batch in self._deltas(state):
            where = f"{self.path}/delta/batch-{batch}"
            deltas += [f"{where}/{f}" for f in sinks.folders(self.spark, where) if f.startswith("bucket=") and (
                buckets is None or int(f.removeprefix("bucket=")) in buckets)]
        return base + deltas

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """Newest row per key in the given buckets, or in all."""
        schema = StructType.fromJson(self.state()["schema"])
        files = self.files_of(buckets)
        return self._newest(self.spark.read.schema(schema).parquet(*files)) if files else self.spark.createDataFrame([], schema)

    def fold(self, force: bool = False) -> bool:
        """Folds the deltas into the base if there are enough of them."""
        state = self.state()
        deltas = self._deltas(state)
        if not deltas or (len(deltas) < FOLD_AFTER and not force):
            return False
        touched = sorted({int(f.rsplit("bucket=", 1)[1]) for f in self.files_of() if "/delta/" in f})
        # outgrown buckets show in those touched; a new deal rewrites all, which growth fourfold pays for
        owners = self.read(touched).select(self.owner).distinct().count()
        anew = owners > 2 * PER_BUCKET * len(touched)
        buckets = 4 * state["buckets"] if anew else state["buckets"]
        touched = None if anew else touched
        where = f"{self.path}/base/{uuid.uuid4().hex}"
        self.read(touched).withColumn("bucket", self.bucket_of(buckets)).repartition("bucket").sortWithinPartitions(
            "bucket", self.owner
        ).write.partitionBy("bucket").parquet(where)
        written = {f.removeprefix("bucket="): f"{where}/{f}" for f in sinks.folders(self.spark, where) if f.startswith("bucket=")}
        base = written if anew else {**state["base"], **written}
        sinks.write_pointer(self.spark, f"{self.path}/_state", json.dumps({**state, "buckets": buckets, "folded": deltas[-1], "base": base}))
        self._drop_unused(base, deltas[-1])
        return True

    def _drop_unused(self, base: dict[str, str], folded: int) -> None:
        """Deltas in the base and base folders that no bucket points to any more."""
        for f in sinks.folders(self.spark, f"{self.path}/delta"):
            if int(f.removeprefix("batch-")) <= folded:
                sinks.drop_folder(self.spark, f"{self.path}/delta/{f}")
        used = {folder.rsplit("/", 2)[1] for folder in base.values()}
        for f in sinks.folders(self.spark, f"{self.path}/base"):
            if f not in used:
                sinks.drop_folder(self.spark, f"{self.path}/base/{f}")
