"""Exact deduplication against history through minimal perfect hash functions.

``history`` is what was kept before, ``incoming`` what arrives now. The distinct digests of the history are dealt to buckets by
their leading bits; each bucket gets a minimal perfect hash of its own (hash and displace), so n digests take n slots. A slot
holds the full 32-byte digest, its number of copies and its winner. Incoming digests are counted per digest before they move
and looked up in their bucket; the slot's digest is compared byte by byte, so a digest that is not a member (which such a hash
sends to some slot as well) never takes another's place and forms a group of its own.

Equal means identical after lower-casing A-Z; a missing text is the empty text. Of equal texts the row with the largest
``doc_id`` stays; rows that share that id stay together, a missing id loses against any other and, if all are missing, all stay.
Empty tables give an empty result. Columns other than ``doc_id`` and ``text`` are ignored by ``dedup_groups`` and kept by
``keep_unique``; the columns made here are prefixed while they could clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsieve.llm.sequences import may_hold
from finsieve.llm.shared import folded, ranged
from finsieve.llm.tokens import mix
from finsieve.session import materialize

#: Digests per bucket on average, and keys per displacement group within a bucket.
BUCKET_KEYS = 256
GROUP_KEYS = 4
_TRIES = 512


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 of the normalised text."""
    return docs.select("doc_id", F.unhex(F.sha2(folded().cast("binary"), 256)).alias("digest"))


def _words(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), ">u8").reshape(len(keys), 4).astype(np.uint64)


def _group_of(words: np.ndarray, groups: int) -> np.ndarray:
    return (words[:, 1] % np.uint64(groups)).astype(np.int64)


def _slots(words: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    return (mix(words[:, 2] ^ mix(pilots.astype(np.uint64) + words[:, 3])) % np.uint64(n)).astype(np.int64)


def build_mphf(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(pilot of every group, slot of every key) for distinct 32-byte keys: a bijection onto 0..n-1.

    Groups are placed from the largest to the smallest; a group's pilot is the first number that sends all its keys to free,
    different slots.
    """
    n = len(keys)
    words = _words(keys)
    groups = -(-n // GROUP_KEYS)
    group = _group_of(words, groups)
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(groups + 1))
    taken = np.zeros(n, bool)
    pilots = np.zeros(groups, np.int64)
    slots = np.zeros(n, np.int64)
    for g in np.argsort(-np.diff(bounds), kind="stable"):
        members = order[bounds[g]:bounds[g + 1]]
        if len(members) == 0:
            continue
        start = 0
        while True:
            tried = np.arange(start, start + _TRIES)
            spots = np.stack([
                _slots(np.broadcast_to(words[m], (_TRIES, 4)), tried, n) for m in members
            ])
            free = ~taken[spots].any(axis=0)
            if len(members) > 1:
                ordered = np.sort(spots, axis=0)
                free &= (ordered[1:] != ordered[:-1]).all(axis=0)
            hit = int(free.argmax())
            if free[hit]:
                pilots[g] = tried[hit]
                slots[members] = spots[:, hit]
                taken[spots[:, hit]] = True
                break
            start += _TRIES
    return pilots, slots


def lookup_mphf(pilots: np.ndarray, keys: list[bytes], n: int) -> np.ndarray:
    """The slot each key would have; only a member's slot holds its own digest."""
    words = _words(keys)
    return _slots(words, pilots[_group_of(words, len(pilots))], n)


def _bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    lead = F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long")
    return groups.withColumn("bucket", (lead % buckets).cast("int"))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pilots, slots = build_mphf([bytes(x) for x in pdf["digest"]])
    pdf = pdf.iloc[np.argsort(slots)]
    return pd.DataFrame({
        "bucket": pdf["bucket"].to_numpy()[:1], "pilots": [pilots.tolist()], "slots": [list(map(bytes, pdf["digest"]))],
        "winners": [pdf["winner"].tolist()], "copies": [pdf["copies"].tolist()],
    })


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket: pilots, and per slot the digest, the winning ``doc_id`` and the number of copies.

    ``history`` holds (digest, winner, copies) with distinct digests. A bucket has about ``BUCKET_KEYS`` digests whatever the
    size of the history, and digests are uniform, so no bucket grows.
    """
    return _bucketed(history, buckets).groupBy("bucket").applyInPandas(
        _build, "bucket int, pilots array<long>, slots array<binary>, winners array<long>, copies array<long>"
    )


def _probe(index: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    """All groups of one bucket: members of the history with their new copies, and groups only the new rows have."""
    out = []
    keys = [bytes(x) for x in new["digest"]]
    found = np.full(len(keys), -1)
    if len(index):
        row = index.iloc[0]
        held = [bytes(x) for x in row["slots"]]
        winners, copies = np.array(row["winners"], np.int64), np.array(row["copies"], np.int64)
        if keys:
            slots = lookup_mphf(np.array(row["pilots"], np.int64), keys, len(held))
            member = np.array([held[s] == k for s, k in zip(slots, keys, strict=True)], bool)
            found = np.where(member, slots, -1)
            np.maximum.at(winners, slots[member], new["winner"].to_numpy()[member])
            np.add.at(copies, slots[member], new["copies"].to_numpy()[member])
        out.append(pd.DataFrame({"digest": held, "keep_id": winners, "group_size": copies}))
    alone = np.flatnonzero(found < 0)
    out.append(pd.DataFrame({
        "digest": [keys[i] for i in alone], "keep_id": new["winner"].to_numpy()[alone].astype(np.int64),
        "group_size": new["copies"].to_numpy()[alone].astype(np.int64),
    }))
    return pd.concat(out, ignore_index=True)


_NO_ID = -(1 << 63)


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(
        F.coalesce(F.max("doc_id").cast("long"), F.lit(_NO_ID)).alias("winner"), F.count(F.lit(1)).alias("copies")
    )


def groups_of(history: DataFrame, incoming: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of all distinct texts, from (doc_id, digest) rows."""
    old = materialize(_counted(history), "dedup-history")
    buckets = ranged(old.count(), BUCKET_KEYS, 64)
    index = materialize(build_index(old, buckets), "dedup-index")
    new = _bucketed(_counted(incoming), buckets)
    return index.groupBy("bucket").cogroup(new.groupBy("bucket")).applyInPandas(
        _probe, "digest binary, keep_id long, group_size long"
    )


def split_history(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Earlier and later half by the range of ``doc_id``; rows without an id are new."""
    lo, hi = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = 0 if lo is None else (int(lo) + int(hi)) // 2
    old = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    return rows.filter(old), rows.filter(~old)


def dedup_groups(history: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Digests are landed once, so texts are read once. The last join is on the digest with both sides exchanged as they are
    read, which lets Spark split the partition of a text that a large part of the corpus repeats.
    """
    marked = digests(history).withColumn("old", F.lit(True)).unionByName(digests(incoming).withColumn("old", F.lit(False)))
    rows = materialize(marked, "dedup-digests")
    groups = materialize(groups_of(rows.filter("old"), rows.filter("not old")), "dedup-groups")
    return _answer(rows, groups)


def _answer(rows: DataFrame, groups: DataFrame) -> DataFrame:
    keep = F.when(F.col("keep_id") != _NO_ID, F.col("keep_id"))
    return rows.join(groups, "digest").select(
        "doc_id", keep.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def classes(docs: DataFrame) -> DataFrame:
    """``dedup_groups`` of one table: its earlier half by ``doc_id`` is the history of its later half."""
    rows = materialize(digests(docs), "dedup-digests")
    old, new = split_history(rows)
    return _answer(rows, materialize(groups_of(old, new), "dedup-groups"))


def keep_unique(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows alike in id and text one stays.

    Decided on (id, digest) rows. A bitmap over those that go, or occur more than once, lets all other rows stay in place; what
    it passes is made single within each task before it moves, and moves once.
    """
    key = ["__id", "__digest"]
    changed = materialize(
        classes(docs.select("doc_id", "text")).filter("group_size > 1").groupBy(
            F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("__id"), F.unhex("text_sha256").alias("__digest")
        ).agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n")).filter("not kept or n > 1"), "dedup-changed",
    )
    chosen = may_hold(changed.select("__id", F.xxhash64("__digest").alias("__mark")), changed.count())

    @F.pandas_udf("boolean")
    def travels(ids: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series(chosen(pa.RecordBatch.from_arrays([pa.array(ids), pa.array(marks)], names=["__id", "__mark"])))

    keyed = docs.withColumns({
        "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), "__digest": F.unhex(F.sha2(folded().cast("binary"), 256))
    })
    perhaps = travels("__id", F.xxhash64("__digest"))
    some = keyed.filter(perhaps).dropDuplicates(key).join(changed.filter("not kept").select(*key), key, "left_anti")
    return keyed.filter(~perhaps).unionByName(some).drop(*key)
