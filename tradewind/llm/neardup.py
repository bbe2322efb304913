"""Near-duplicate groups by SuperMinHash signatures, banding, exact verification and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tradewind.llm.shared import connected_components, join_groups, settled, stored, with_ids, without_ids
from tradewind.llm.words import GOLDEN, mix, shingle_sets, text_chunks

EMPTY = np.uint32(0xFFFFFFFF)
FEATURES = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


def super_minhash(sets: list[np.ndarray], slots: int = 128) -> np.ndarray:
    """SuperMinHash signatures (rows, slots) of sets of 64-bit hashes; an empty set has EMPTY in every slot.

    Element x visits the slots in an order of its own, a random permutation, and at its j-th step offers the rank
    j + r with a fresh r in [0, 1); a slot keeps the smallest rank offered. All elements take their j-th step together:
    ranks only rise, so a row is finished as soon as each of its slots holds a rank, and its elements stop there.
    A rank is stored as j in the upper 7 bits and r in the lower 25.
    """
    out = np.full((len(sets), slots), EMPTY, np.uint32)
    flat = out.reshape(-1)
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return out
    with np.errstate(over="ignore"):
        x = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), sizes)
        h = mix(x ^ GOLDEN)
        slot = (h & np.uint64(0xFFFF)).astype(np.int64) % slots
        np.minimum.at(flat, row * slots + slot, (h >> np.uint64(39)).astype(np.uint32))
        going = (out == EMPTY).any(1)[row]
        x, row, slot = x[going], row[going], slot[going]
        order = np.tile(np.arange(slots, dtype=np.uint8), (len(x), 1))
        at = np.arange(len(x))
        order[at, slot], order[:, 0] = order[:, 0], slot
        for j in range(1, slots):
            if not len(x):
                break
            h = mix(x + np.uint64(j) * GOLDEN)
            pick = j + (h & np.uint64(0xFFFF)).astype(np.int64) % (slots - j)
            slot = order[at, pick].astype(np.int64)
            order[at, pick] = order[:, j]
            np.minimum.at(flat, row * slots + slot, (h >> np.uint64(39)).astype(np.uint32) | np.uint32(j << 25))
            going = (out == EMPTY).any(1)[row]
            if not going.all():
                x, row, order = x[going], row[going], order[going]
                at = np.arange(len(x))
    return out


def band_hashes(signatures: np.ndarray, bands: int) -> np.ndarray:
    rows = signatures.shape[1] // bands
    parts = signatures[:, : bands * rows].reshape(len(signatures), bands, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * GOLDEN
        for k in range(rows):
            h = mix(h ^ parts[:, :, k]) + GOLDEN
    return h.view(np.int64)


def _features(width: int, slots: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in text_chunks(batch.column("text")):
                sets = shingle_sets(data, offsets, width)
                keys = band_hashes(super_minhash(sets, slots), bands)
                with np.errstate(over="ignore"):
                    marks = [[int(mix(s ^ np.uint64(c)).sum(dtype=np.uint64).view(np.int64)) for s in sets] for c in (11, 77)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(marks[0], pa.int64()),
                        pa.array(marks[1], pa.int64()),
                        pa.array([k if len(s) else None for k, s in zip(keys, sets)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands"],
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in text_chunks(batch.column("text")):
                sets = [s.view(np.int64) for s in shingle_sets(data, offsets, width)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(sets)), pa.array(sets, pa.list_(pa.int64()))],
                    names=["doc_id", "shingles"],
                )

    return run


def shingle_table(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles) of the documents whose ids are given."""
    return with_ids(docs, ids, "doc_id").mapInArrow(_sets(width), "doc_id long, shingles array<long>")


def prefix_pairs(sets: DataFrame, components: DataFrame, part: int, whole: int) -> DataFrame:
    """All pairs (id, other) in different components, `from` and `to`, that could still reach `part`/`whole`.

    In whatever order all shingles are sorted, the smaller set of such a pair has one of its first
    size - ceil(2 * size * part / (whole + part)) + 1 shingles among the first size - ceil(size * part / whole) + 1 of
    the larger. Rare shingles come first, so a passage that many texts share pairs only those that could be near copies:
    after the first shingle that two sets share, what is left of both must still be enough.
    """
    held = sets.join(components, "doc_id").select("doc_id", "component", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    held = stored(held, "open_shingles")
    known = held.join(held.groupBy("shingle").agg(F.count("*").alias("held_by")), "shingle")
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("held_by", "shingle"))
    first = known.withColumn("place", place).where(
        (F.col("place") <= F.col("size") - F.ceil(F.col("size") * part / whole) + 1) & (F.col("held_by") > 1)
    )
    first = stored(first.select("shingle", "doc_id", "component", "size", "place"), "prefixes")
    short = F.col("place") <= F.col("size") - F.ceil(F.col("size") * 2 * part / (whole + part)) + 1
    small = first.where(short).select("shingle", F.col("doc_id").alias("id"), F.col("component").alias("a"), F.col("size").alias("m"), F.col("place").alias("i"))
    large = first.select("shingle", F.col("doc_id").alias("other"), F.col("component").alias("b"), F.col("size").alias("n"), F.col("place").alias("j"))
    enough = f"(1 + least(m - i, n - j)) * {whole + part} >= {part} * (m + n)"
    near = small.join(large, "shingle").where(f"a <> b and m * {whole} >= n * {part} and (m < n or m = n and id < other) and {enough}")
    ends = [F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other")]
    return near.select(*ends, F.col("a").alias("from"), F.col("b").alias("to")).distinct()


def verified_links(pairs: DataFrame, docs: DataFrame, width: int, part: int, whole: int) -> DataFrame:
    """The pairs (id, other) with `whole` * intersection >= `part` * union of their full shingle sets."""
    ids = pairs.select(F.col("id").alias("doc_id")).unionByName(pairs.select(F.col("other").alias("doc_id"))).distinct()
    sets = stored(shingle_table(docs, stored(ids, "candidate_ids"), width), "candidate_sets")
    return confirmed(pairs, sets, part, whole)


def confirmed(pairs: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """The pairs, with what else their rows have, that hold on the full sets of `sets`."""
    rest = [c for c in pairs.columns if c not in ("id", "other")]
    left = sets.select(F.col("doc_id").alias("id"), F.col("shingles").alias("a"))
    right = sets.select(F.col("doc_id").alias("other"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return (
        pairs.join(left, "id")
        .join(right, "other")
        .select("id", "other", *rest, both.alias("both"), (F.size("a") + F.size("b")).alias("sum"))
        .where(F.col("both") * whole >= (F.col("sum") - F.col("both")) * part)
        .select("id", "other", *rest)
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    part: int = 75,
    whole: int = 100,
    slots: int = 128,
    bands: int = 32,
) -> DataFrame:
    """Connected groups of documents whose sets of `width`-word shingles overlap by `part`/`whole` or more.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. A text of fewer words is one shingle; a null text or one
    without words has an empty set and is linked with nothing, not even its copies. Ids are expected to be unique:
    rows that share an id are taken for one document and share a fate; rows without an id are linked with nothing and
    kept. Other columns are not read; an empty table gives no rows.

    1. Rows with equal sets collapse into a class named by its smallest id, however many they are.
    2. Each class spreads the hashes of its `bands` bands. A bucket links its members to two hubs: the member with the
       lowest id and the one that meets most others over all its buckets, which in a group of variants is the text
       they vary. So a group of thousands gives a few pairs per member, not all its pairs.
    3. Links are confirmed on the full sets; components are found by star contraction.
    4. The members of buckets that still hold several components are compared across components by a prefix filter over
       their full sets, which loses no link, and confirmed in the same way; the components that meet so are joined.

    With 32 bands of 4 slots a pair at the limit of 0.75 shares no bucket with a probability of 5e-6.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    features = stored(named.mapInArrow(_features(width, slots, bands), FEATURES), "features")
    plain = features.select("doc_id", "n_shingles", "set_a", "set_b")
    real = plain.where("n_shingles > 0 and doc_id is not null")
    classes = stored(
        real.groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_rows")), "classes"
    )
    # a class of one row is its own representative; the others are named by one row each
    shown = features.where("n_shingles > 0 and doc_id is not null").join(
        classes.select("n_shingles", "set_a", "set_b", F.col("class_id").alias("doc_id")),
        ["n_shingles", "set_a", "set_b", "doc_id"],
        "left_semi",
    )
    shown = stored(shown.select(F.col("doc_id").alias("id"), "bands"), "representatives")
    spread = shown.select("id", F.explode("bands").alias("key"))
    buckets = spread.groupBy("key").agg(F.min("id").alias("lowest"), F.count("*").alias("n")).where("n > 1")
    members = stored(spread.join(buckets, "key"), "bucket_members")
    degrees = members.groupBy("id").agg(F.sum("n").alias("degree"))
    central = members.join(degrees, "id").groupBy("key").agg(F.max(F.struct("degree", "id")).alias("top"))
    hubs = members.join(central.select("key", F.col("top.id").alias("central")), "key")
    stars = hubs.select("id", F.explode(F.array("central", "lowest")).alias("other")).where("id <> other")
    stars = stars.select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other")).distinct()
    stars = stored(stars, "star_pairs")
    links = stored(verified_links(stars, named, width, part, whole), "star_links")
    components = connected_components(links, "id", "other")

    placed = members.join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = stored(placed.select("key", "id", "component"), "placed_members")
    mixed = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
    unsettled = placed.join(mixed.select("key"), "key", "left_semi").select(F.col("id").alias("doc_id"), "component").distinct()
    unsettled = stored(unsettled, "unsettled")
    sets = stored(shingle_table(named, unsettled.select("doc_id"), width), "unsettled_sets")
    likely = stored(prefix_pairs(sets, unsettled, part, whole).join(stars, ["id", "other"], "left_anti"), "likely_pairs")
    more = stored(confirmed(likely, sets, part, whole), "more_links")
    # components that a further link joins: only they are contracted again, each as one node
    merged = connected_components(more.select("from", "to").distinct(), "from", "to")

    class_of = classes.select("n_shingles", "set_a", "set_b", "class_id", "n_rows").join(
        components.select(F.col("id").alias("class_id"), "component"), "class_id", "left"
    )
    class_of = class_of.withColumn("component", F.coalesce("component", "class_id"))
    class_of = class_of.join(merged.select(F.col("id").alias("component"), F.col("component").alias("joined")), "component", "left")
    class_of = stored(
        class_of.select("n_shingles", "set_a", "set_b", F.coalesce("joined", "component").alias("component_id"), "n_rows"), "class_components"
    )
    out = join_groups(real, class_of, ["n_shingles", "set_a", "set_b"], "n_rows", real.count()).select("doc_id", "n_shingles", "component_id")
    lone = plain.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(lone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all its columns."""

    def dropped() -> DataFrame:
        decided = near_duplicates(docs, id_col, text_col)
        fate = decided.where("doc_id is not null").groupBy(F.col("doc_id").alias(id_col)).agg(F.max("kept").alias("kept"))
        return fate.where("not kept").select(id_col)

    return without_ids(docs, settled(docs.sparkSession, dropped, "dropped"), id_col)
