"""Exact deduplication against an immutable snapshot.

A snapshot is a set of earlier rows.  It is written once: its members (key, id, digest), its exact buckets (each distinct
text under its digest, with the first of its rows and their number) and, per bucket, one static binary-fuse filter over the
digests (8-bit fingerprints, about 1.13 bytes a digest).  All three can be loaded again for later batches.

The rows of a new batch are first grouped among themselves, then screened by the filter of their bucket.  Only positives
are joined with the exact buckets, where the texts themselves are compared; what the filter rules out never takes part in
that join.  Texts are grouped under digest and whole text, so equal digests of different texts stop the job: nothing is
merged on the word of a digest.

Defined results: a null text counts as empty; empty texts equal one another; of equal texts the row of the smallest id
stays, a null id coming after all others, and of rows that share that id one, so each group keeps exactly one row; keep_id
is the id of that row; very long texts are read whole; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm._common import SPACE_RUN, keyed, settled, shuffle_partitions, small, written

#: Digests in one filter at most, on average: a filter is built in one task (about 40 MB while building).
BUCKET_KEYS = 250_000


def normalised(text: str) -> F.Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE_RUN, " ")


# ---------------------------------------------------------------- binary-fuse filter


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser (public constants of the splitmix64 generator)."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class BinaryFuse:
    """A static 3-wise binary-fuse filter over 64-bit keys: no false negatives, one false positive in 256."""

    def __init__(self, seed: int, segment: int, segments: int, prints: np.ndarray):
        self.seed, self.segment, self.segments, self.prints = seed, segment, segments, prints

    @staticmethod
    def _shape(n: int) -> tuple[int, int]:
        segment = 1 << max(2, min(18, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
        capacity = int(np.ceil(n * factor)) + 8
        return segment, max(1, -(-capacity // segment) - 2)

    @staticmethod
    def _slots(hashed: np.ndarray, segment: int, segments: int) -> np.ndarray:
        """Three slots per key, in three neighbouring segments."""
        high = (hashed >> np.uint64(32)).astype(np.uint64)
        first = ((high * np.uint64(segments)) >> np.uint64(32)).astype(np.int64)
        mask = np.uint64(segment - 1)
        inner = [(hashed >> np.uint64(s)) & mask for s in (0, 14, 28)]
        inner[2] ^= high & mask
        return np.stack([(first + i) * segment + inner[i].astype(np.int64) for i in range(3)], axis=1)

    @staticmethod
    def _print(hashed: np.ndarray) -> np.ndarray:
        return ((hashed ^ (hashed >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        """Peels in rounds: all slots that hold a single key go at once, and are filled in reverse order."""
        keys = np.unique(keys.astype(np.uint64))
        segment, segments = cls._shape(len(keys))
        for seed in range(1, 1000):
            if seed % 20 == 0:
                segments += max(1, segments // 10)
            hashed = _mix(keys, seed)
            slots = cls._slots(hashed, segment, segments)
            size = (segments + 2) * segment
            count = np.bincount(slots.ravel(), minlength=size)
            xored = np.zeros(size, np.int64)
            for i in range(3):
                np.bitwise_xor.at(xored, slots[:, i], np.arange(len(keys)))
            alone, order, left = np.flatnonzero(count == 1), [], len(keys)
            while len(alone):
                owner, where = np.unique(xored[alone], return_index=True)
                order.append((owner, alone[where]))
                left -= len(owner)
                touched = slots[owner]
                np.subtract.at(count, touched.ravel(), 1)
                np.bitwise_xor.at(xored, touched.ravel(), np.repeat(owner, 3))
                touched = np.unique(touched)
                alone = touched[count[touched] == 1]
            if left:
                continue
            prints, own = np.zeros(size, np.uint8), cls._print(hashed)
            for owner, slot in reversed(order):
                s = slots[owner]
                others = prints[s[:, 0]] ^ prints[s[:, 1]] ^ prints[s[:, 2]] ^ prints[slot]
                prints[slot] = own[owner] ^ others
            return cls(seed, segment, segments, prints)
        raise RuntimeError("no seed peels this key set")

    def has(self, keys: np.ndarray) -> np.ndarray:
        hashed = _mix(keys.astype(np.uint64), self.seed)
        s = self._slots(hashed, self.segment, self.segments)
        return (self.prints[s[:, 0]] ^ self.prints[s[:, 1]] ^ self.prints[s[:, 2]]) == self._print(hashed)


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(d)[:8] for d in digests), np.uint64)


def build_filters(exact: DataFrame) -> DataFrame:
    """One filter per bucket of (bucket, digest): bucket, seed, segment, segments, prints."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = BinaryFuse.build(_keys(pdf["digest"]))
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "seed": [f.seed], "segment": [f.segment], "segments": [f.segments], "prints": [f.prints.tobytes()]})

    return exact.select("bucket", "digest").groupBy("bucket").applyInPandas(build, "bucket int, seed int, segment int, segments int, prints binary")


def screen(batch: DataFrame, filters: DataFrame) -> DataFrame:
    """bucket, digest, maybe of a batch (bucket, digest): false where the snapshot surely lacks the digest."""

    def ask(new: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if len(new) and len(found):
            r = found.iloc[0]
            new["maybe"] = BinaryFuse(int(r["seed"]), int(r["segment"]), int(r["segments"]), np.frombuffer(r["prints"], np.uint8)).has(_keys(new["digest"]))
        else:
            new["maybe"] = False
        return new

    return batch.select("bucket", "digest").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(ask, "bucket int, digest binary, maybe boolean")


# ---------------------------------------------------------------- rows and texts


def _digested(docs: DataFrame, id_col: str, text_col: str, key_col: str | None, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(rows: key, id, bucket, digest; texts: bucket, digest, body) of docs.

    Without key_col, a row's key is made while rows is written.  Read rows from a written table.
    """
    key = F.monotonically_increasing_id() if key_col is None else F.col(key_col)
    body = docs.select(key.cast("long").alias("key"), F.col(id_col).cast("long").alias("id"), normalised(text_col).alias("body"))
    known = body.withColumn("digest", F.unhex(F.sha2(F.col("body").cast("binary"), 256)))
    known = known.withColumn("bucket", F.pmod(F.crc32("digest"), F.lit(buckets)).cast("int"))
    return known.select("key", "id", "bucket", "digest"), known.select("bucket", "digest", "body")


def _first() -> F.Column:
    """Of some rows, the one of the smallest id (null ids last), then of the smallest key."""
    return F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))


def _grouped(rows: DataFrame) -> DataFrame:
    """bucket, digest, first, n: groups of rows, summed before they travel."""
    return rows.groupBy("bucket", "digest").agg(_first().alias("first"), F.count("*").alias("n"))


def _distinct(texts: DataFrame) -> DataFrame:
    """bucket, digest, body: each distinct text once; the job stops where two of them share a digest."""
    once = written(texts.groupBy("bucket", "digest", "body").agg(F.count("*").alias("n")).select("bucket", "digest", "body"), "texts")
    clash = once.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1")
    if not clash.isEmpty():
        raise ValueError("two texts share a SHA-256 digest")
    return once


@dataclass
class Snapshot:
    """members: key, id, bucket, digest; groups: bucket, digest, first, n; texts: bucket, digest, body; filters: one a bucket."""

    members: DataFrame
    groups: DataFrame
    texts: DataFrame
    filters: DataFrame
    buckets: int

    PARTS = ("members", "groups", "texts", "filters")

    @classmethod
    def create(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None, buckets: int | None = None) -> Snapshot:
        if buckets is None:
            buckets = max(shuffle_partitions(docs.sparkSession), -(-docs.select(id_col).count() // BUCKET_KEYS))
        rows, texts = _digested(docs, id_col, text_col, key_col, buckets)
        members, texts = written(rows, "members"), _distinct(texts)
        groups = written(_grouped(members), "groups")
        return cls(members, groups, texts, written(build_filters(groups), "filters"), buckets)

    def save(self, path: str) -> None:
        for part in self.PARTS:
            getattr(self, part).write.parquet(f"{path.rstrip('/')}/{part}")
        self.members.sparkSession.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.parquet(f"{path.rstrip('/')}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Snapshot:
        read = lambda part: spark.read.parquet(f"{path.rstrip('/')}/{part}")
        return cls(*(read(p) for p in cls.PARTS), read("meta").first()["buckets"])


# ---------------------------------------------------------------- the operator


def repeated(snapshot: Snapshot, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """digest, first, n of the texts that snapshot and batch (rows: written; texts: distinct, written) hold more than once together."""
    new = written(_grouped(rows), "new-groups")
    maybe = written(screen(new, snapshot.filters).filter("maybe").select("bucket", "digest"), "positives")
    hits, key = small(maybe), ["bucket", "digest"]
    old = snapshot.texts.join(hits, key, "left_semi").select(*key, F.col("body").alias("old_body"))
    same = F.when(F.col("body") != F.col("old_body"), F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("boolean")).otherwise(True)
    met = written(texts.join(hits, key, "left_semi").join(old, key).filter(same).select(*key), "met")
    met_hits = small(met)
    held = snapshot.groups.join(met_hits, key, "left_semi").select(*key, F.col("first").alias("old_first"), F.col("n").alias("old_n"))
    both = new.join(met_hits, key, "left_semi").join(small(held), key).select("digest", F.least("first", "old_first").alias("first"), (F.col("n") + F.col("old_n")).alias("n"))
    alone = lambda groups: groups.filter("n > 1").join(met_hits, key, "left_anti").select("digest", "first", "n")
    return both.unionByName(alone(new)).unionByName(alone(snapshot.groups))


def dedup_batch(snapshot: Snapshot, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """One row per row of snapshot and batch: key, doc_id, keep_id, group_size, kept, text_sha256, is_new.

    The row of the smallest id of equal texts stays, wherever it came from.  Keys tell rows apart within either side.
    """
    rows, texts = _digested(batch, id_col, text_col, key_col, snapshot.buckets)
    if key_col is None:  # past the keys of the snapshot
        most = snapshot.members.agg(F.coalesce(F.max("key"), F.lit(-1))).first()[0]
        rows = rows.withColumn("key", F.col("key") + F.lit(most + 1))
    rows = written(rows, "rows")
    found = settled(rows.sparkSession, "repeated", lambda: repeated(snapshot, rows, _distinct(texts)))
    every = snapshot.members.withColumn("is_new", F.lit(False)).unionByName(rows.withColumn("is_new", F.lit(True)))
    alone = F.col("first").isNull()
    return every.join(small(found), "digest", "left").select(
        "key",
        F.col("id").alias("doc_id"),
        F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("first.key") == F.col("key"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "is_new",
    )


def dedup_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """A whole table: half of its rows (by a hash of the id) stand as the snapshot, the other half as the new batch."""
    late = F.coalesce(F.pmod(F.xxhash64(F.col(key_col or id_col)), F.lit(2)) == 1, F.lit(False))
    return dedup_batch(Snapshot.create(docs.filter(~late), id_col, text_col, key_col), docs.filter(late), id_col, text_col, key_col)


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one row of each text: that of the smallest id (null ids last), and one where rows share it; the columns stay as they are.

    Rows are known by keys of their own, so rows that share an id, or have none, keep texts of their own.
    """
    rows, key = keyed(docs)
    gone = settled(docs.sparkSession, "copies", lambda: dedup_table(rows, key_col=key).filter("not kept").select(F.col("key").alias(key)))
    return rows.join(small(gone), key, "left_anti").select(docs.columns)
