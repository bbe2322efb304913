"""Exact deduplication of a batch against an immutable snapshot with static binary-fuse filters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tradewind.llm.shared import join_groups, settled, stored, without_ids
from tradewind.llm.words import GOLDEN, mix

DIGESTS = "doc_id long, digest long, text_sha256 string, n_bytes long, incoming boolean"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.ascii_lower(pc.fill_null(batch.column("text").cast(pa.large_string()), ""))
        digests, hexes, sizes = [], [], []
        data = memoryview(texts.buffers()[2] or b"")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1].tolist() if len(texts) else [0]
        for a, b in zip(ends, ends[1:]):
            sha = hashlib.sha256(data[a:b])
            digests.append(int.from_bytes(sha.digest()[:8], "little", signed=True))
            hexes.append(sha.hexdigest())
            sizes.append(b - a)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(digests, pa.int64()), pa.array(hexes, pa.string()), pa.array(sizes, pa.int64()), batch.column("incoming")],
            names=["doc_id", "digest", "text_sha256", "n_bytes", "incoming"],
        )


class BinaryFuse:
    """A static set filter of three 8-bit cells a key in neighbouring segments; it never misses a key it was built from."""

    def __init__(self, keys: np.ndarray | None = None, state: tuple[int, int, int, bytes] | None = None):
        if state is not None:
            self.seed, self.segment, self.segments, cells = state
            self.cells = np.frombuffer(cells, np.uint8)
            return
        keys = np.unique(keys)
        n = max(2, len(keys))
        self.segment = 1 << int(min(18, max(2, np.floor(np.log(n) / np.log(3.33) + 2.25))))
        slots = n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))
        self.segments = max(1, int(np.ceil(slots / self.segment)) - 2)
        for self.seed in range(1000):
            if self._fill(keys):
                return
        raise ValueError("no seed gives a filter")

    def _cells_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The three cells (3, keys) and the fingerprint of each key."""
        with np.errstate(over="ignore"):
            h = mix(keys + np.uint64(self.seed + 1) * GOLDEN)
        low = np.uint64(self.segment - 1)
        first = ((h >> np.uint64(32)) * np.uint64(self.segments * self.segment)) >> np.uint64(32)
        second = (first + np.uint64(self.segment)) ^ ((h >> np.uint64(18)) & low)
        third = (first + np.uint64(2 * self.segment)) ^ (h & low)
        return np.stack([first, second, third]).astype(np.int64), ((h ^ (h >> np.uint64(40))) & np.uint64(255)).astype(np.uint8)

    def _fill(self, keys: np.ndarray) -> bool:
        """Peels keys off cells that only they use, round by round, and sets the cells in the reverse order."""
        at, marks = self._cells_of(keys)
        size = (self.segments + 2) * self.segment
        count = np.bincount(at.ravel(), minlength=size)
        who = np.zeros(size, np.int64)
        np.bitwise_xor.at(who, at.ravel(), np.tile(np.arange(len(keys)), 3))
        rounds, left, free = [], len(keys), np.flatnonzero(count == 1)
        while len(free):
            key, place = np.unique(who[free], return_index=True)
            rounds.append((key, free[place]))
            left -= len(key)
            touched = at[:, key].ravel()
            np.subtract.at(count, touched, 1)
            np.bitwise_xor.at(who, touched, np.tile(key, 3))
            touched = np.unique(touched)
            free = touched[count[touched] == 1]
        self.cells = np.zeros(size, np.uint8)
        for key, own in reversed(rounds):
            self.cells[own] = 0
            self.cells[own] = marks[key] ^ np.bitwise_xor.reduce(self.cells[at[:, key]], axis=0)
        return left == 0

    def may_contain(self, keys: np.ndarray) -> np.ndarray:
        at, marks = self._cells_of(keys)
        return np.bitwise_xor.reduce(self.cells[at], axis=0) == marks


def _build(group: pd.DataFrame) -> pd.DataFrame:
    f = BinaryFuse(group["digest"].to_numpy(np.int64).view(np.uint64))
    return pd.DataFrame({"bucket": group["bucket"].iloc[:1], "seed": f.seed, "segment": f.segment, "segments": f.segments, "cells": [f.cells.tobytes()]})


def _screen(incoming: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    out = incoming[["digest"]].copy()
    out["positive"] = False
    for f in filters.itertuples():
        fuse = BinaryFuse(state=(f.seed, f.segment, f.segments, f.cells))
        out["positive"] |= fuse.may_contain(incoming["digest"].to_numpy(np.int64).view(np.uint64))
    return out


def build_filters(snapshot: DataFrame, bucket_keys: int = 8192, arriving: int = 0) -> tuple[DataFrame, int]:
    """One filter per bucket of the snapshot's distinct `digest`s, and the number of buckets.

    It follows their count or that of the `arriving` digests, whichever is larger, so that neither fills a bucket too full.
    """
    digests = stored(snapshot.select("digest").distinct(), "snapshot_digests")
    buckets = max(1, -(-max(digests.count(), arriving) // bucket_keys))
    keyed = digests.withColumn("bucket", F.pmod("digest", F.lit(buckets)))
    built = keyed.groupBy("bucket").applyInPandas(_build, "bucket long, seed long, segment long, segments long, cells binary")
    return stored(built, "fuse_filters"), buckets


def exact_duplicates(
    docs: DataFrame, incoming: Column, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = 8192
) -> DataFrame:
    """Groups of equal texts over a snapshot (`incoming` false) and the batch that arrives (`incoming` true).

    Texts are equal when they are identical after lower-casing A-Z; a null text is the empty text, and empty texts are
    copies of each other. The row with the largest id stays; rows that share that id stay together. A group without
    any id keeps all its rows. Columns other than the two named are not read; an empty table gives no rows.

    The snapshot's distinct digests are hashed into buckets, each with a static filter; a bucket holds about `bucket_keys`
    digests of the snapshot and of the batch, whichever has more. Incoming
    digests (one row per text and side, so copies are counted before anything is shuffled) that a filter rejects are
    new and form groups of the batch alone. The others join the exact bucket of their digest, where the bytes decide:
    the 256-bit hash and the length of the whole normalised text. A false positive falls back to the batch's groups.
    """
    named = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.coalesce(incoming, F.lit(True)).alias("incoming"),
    )
    rows = stored(named.mapInArrow(_digests, DIGESTS), "digests")
    key = ["digest", "text_sha256", "n_bytes"]
    groups = stored(rows.groupBy("incoming", *key).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n")), "groups")
    total = rows.count()
    old, new = groups.where(~F.col("incoming")).drop("incoming"), groups.where("incoming").drop("incoming")
    filters, buckets = build_filters(old, bucket_keys, new.count())
    arriving = new.select("digest").distinct().withColumn("bucket", F.pmod("digest", F.lit(buckets)))
    screened = stored(
        arriving.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(_screen, "digest long, positive boolean"),
        "screened",
    )
    positive = new.join(screened.where("positive").select("digest"), "digest", "left_semi")
    fresh = new.join(screened.where("not positive").select("digest"), "digest", "left_semi")
    merged = (
        old.withColumns({"old_n": F.col("n"), "new_n": F.lit(0)})
        .unionByName(positive.withColumns({"old_n": F.lit(0), "new_n": F.col("n")}))
        .groupBy(*key)
        .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), (F.sum("old_n") > 0).alias("in_snapshot"))
    )
    alone = fresh.select(*key, "keep_id", F.col("n").alias("group_size"), F.lit(False).alias("in_snapshot"))
    resolved = stored(merged.unionByName(alone), "resolved")
    out = join_groups(rows, resolved, key, "group_size", total)
    return out.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("keep_id").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
        "n_bytes",
        "incoming",
        "in_snapshot",
    )


def half_of(id_col: str = "doc_id") -> Column:
    """Deals a table into a snapshot and a batch by a hash of the id."""
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(2)) == 1


def drop_exact_duplicates(docs: DataFrame, incoming: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""

    def dropped() -> DataFrame:
        decided = exact_duplicates(docs, incoming, id_col, text_col)
        fate = decided.where("doc_id is not null").groupBy(F.col("doc_id").alias(id_col)).agg(F.max("kept").alias("kept"))
        return fate.where("not kept").select(id_col)

    return without_ids(docs, settled(docs.sparkSession, dropped, "dropped"), id_col)
