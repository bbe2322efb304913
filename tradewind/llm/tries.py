"""The trie of conversation prefixes: nodes by digest, totals of subtrees through slots of a perfect hash."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tradewind.functions.ranking import split_long_groups
from tradewind.llm.shared import join_groups, stored, text_or_empty
from tradewind.llm.words import GOLDEN, mix

WORD = r"[^\x20\x09-\x0D]+"
LIGHT = (
    "p1 long, p2 long, conv long, depth long, n_convs long, parent_conv long, top boolean, "
    "n_children long, n_leaves long, saved long"
)


def number_turns(
    turns: DataFrame,
    id_col: str = "conv_id",
    order_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    slice_rows: int = 100_000,
) -> DataFrame:
    """(conv, at, c1, c2, words): the place of each turn in its conversation, from 1 on, two hashes of role and text, and the words of the text.

    Turns are ordered by `order_col`, null first, then by their hashes. A conversation of more than `slice_rows` turns is numbered in
    slices, each in its own task. Null roles and texts are empty; rows without a conversation are left out.
    """
    role, text = text_or_empty(role_col), text_or_empty(text_col)
    rows = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"),
        F.col(order_col).alias("turn"),
        F.xxhash64(role, text).alias("c1"),
        F.xxhash64(F.lit(7), text, role).alias("c2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    rows = stored(rows.withColumn("key", F.struct("turn", "c1", "c2")).drop("turn"), "turns")
    sliced = split_long_groups(rows, "conv", "key", "key", slice_rows)
    before = W.partitionBy("conv").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        sliced.where(F.size("_slice") > 0)
        .groupBy("conv", "_slice")
        .agg(F.count("*").alias("n"))
        .select("conv", "_slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_carried"))
    )
    at = F.row_number().over(W.partitionBy("conv", "_slice").orderBy("key")) + F.coalesce("_carried", F.lit(0))
    return sliced.join(carried, ["conv", "_slice"], "left").select("conv", at.cast("long").alias("at"), "c1", "c2", "words")


def running(
    rows: DataFrame,
    group: str,
    place: str,
    names: list[str],
    fold: Callable[[str], Column],
    join: Callable[[Column, Column], Column],
    slice_rows: int,
    backward: bool = False,
) -> DataFrame:
    """Each of `names` folded over the rows of the group up to this one by the whole number `place`, or `backward` from this one on.

    Groups are cut into slices of `slice_rows` places; only groups with several slices carry totals from slice to slice.
    """
    rows = rows.withColumn("_part", F.expr(f"{place} div {slice_rows}"))

    def by(c: str) -> Column:
        return F.col(c).desc() if backward else F.col(c).asc()

    inside = W.partitionBy(group, "_part").orderBy(by(place)).rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumns({n: fold(n).over(inside) for n in names})
    long = rows.where("_part > 0").select(group).distinct()
    if long.isEmpty():
        return out.drop("_part")
    parts = rows.join(long, group, "left_semi").groupBy(group, "_part").agg(*[fold(n).alias(n) for n in names])
    before = W.partitionBy(group).orderBy(by("_part")).rowsBetween(W.unboundedPreceding, -1)
    carried = parts.select(group, "_part", *[fold(n).over(before).alias(f"_{n}") for n in names])
    whole = {n: F.when(F.col(f"_{n}").isNull(), F.col(n)).otherwise(join(F.col(n), F.col(f"_{n}"))) for n in names}
    return out.join(carried, [group, "_part"], "left").withColumns(whole).drop("_part", *[f"_{n}" for n in names])


class SlotTable:
    """A minimal perfect hash of distinct 128-bit digests (n, 2): each has one of n slots of flat arrays.

    Every level has a bit array; digests that are alone at their bit settle there, the others go on to the next level. A slot is the
    number of bits set before. The digests themselves lie in the slots, so one that is not in the table is noticed.
    """

    def __init__(self, digests: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, before = digests, 0
        while len(left):
            bit = self._bit(left, len(self.levels), 2 * len(left))
            count = np.bincount(bit, minlength=2 * len(left))
            alone = count == 1
            self.levels.append((alone, before + np.cumsum(alone) - alone))
            before += int(alone.sum())
            left = left[count[bit] > 1]
        self.digests = np.zeros_like(digests)
        self.digests[self._slots(digests)] = digests

    @staticmethod
    def _bit(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = mix(mix(digests[:, 0] + np.uint64(level + 1) * GOLDEN) ^ digests[:, 1])
        return (h % np.uint64(size)).astype(np.int64)

    def _slots(self, digests: np.ndarray) -> np.ndarray:
        out = np.full(len(digests), -1)
        for level, (alone, rank) in enumerate(self.levels):
            open_ = np.flatnonzero(out < 0)
            bit = self._bit(digests[open_], level, len(alone))
            out[open_[alone[bit]]] = rank[bit[alone[bit]]]
        return out

    def find(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for one that is not in the table."""
        if not self.levels:
            return np.full(len(digests), -1)
        slot = self._slots(digests)
        held = (slot >= 0) & (self.digests[slot] == digests).all(axis=1)
        return np.where(held, slot, -1)


def _accumulate(nodes: pd.DataFrame) -> pd.DataFrame:
    """Totals of whole subtrees: counts are scattered into arrays by slot and added to the parent's slot, deepest nodes first."""
    digests = nodes[["p1", "p2"]].to_numpy(np.int64).view(np.uint64)
    table = SlotTable(digests)
    slot = table.find(digests)
    parent = np.full(len(nodes), -1)
    depth, convs, saved = (np.zeros(len(nodes), np.int64) for _ in range(3))
    parent[slot] = table.find(nodes[["q1", "q2"]].to_numpy(np.int64).view(np.uint64))
    depth[slot], convs[slot] = nodes["depth"], nodes["conv"]
    saved[slot] = (nodes["n_convs"] - 1) * nodes["words"]
    parent[depth == 0] = -1
    inner = parent >= 0
    children = np.bincount(parent[inner], minlength=len(nodes))
    leaves = (children == 0).astype(np.int64)
    order = np.argsort(-depth, kind="stable")
    order = order[inner[order]]
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    out = nodes[["p1", "p2", "conv", "depth", "n_convs"]].copy()
    out["parent_conv"] = pd.arrays.IntegerArray(convs[parent][slot], ~inner[slot])
    out["top"] = ~inner[slot]
    out["n_children"], out["n_leaves"], out["saved"] = children[slot], leaves[slot], saved[slot]
    return out


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lists that follow each other for one node; only the running hash is held."""
    node, running_hash = None, None

    def row() -> pa.RecordBatch:
        values = [pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([running_hash.hexdigest()])]
        return pa.RecordBatch.from_arrays(values, names=["p1", "p2", "ends_sha256"])

    for batch in batches:
        for p1, p2, ids in zip(*(batch.column(c).to_pylist() for c in ("p1", "p2", "ids"))):
            if node != (p1, p2):
                if node is not None:
                    yield row()
                node, running_hash = (p1, p2), hashlib.sha256()
            else:
                running_hash.update(b",")
            running_hash.update(ids.encode())
    if node is not None:
        yield row()


def ends_by_node(ends: DataFrame, slice_rows: int) -> DataFrame:
    """(p1, p2, ends_sha256): hash of the ascending ids of the conversations that end at a node, comma-joined.

    Ids are sorted and written out in slices of at most `slice_rows`; the hash itself can only be computed in order, from these texts.
    """
    sliced = split_long_groups(ends.select(F.struct("p1", "p2").alias("node"), "conv"), "node", "conv", "conv", slice_rows)
    texts = sliced.groupBy("node", "_slice").agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    texts = texts.select("node.p1", "node.p2", "_slice", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    in_order = texts.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "_slice").select("p1", "p2", "ids")
    return in_order.mapInArrow(_ends, "p1 long, p2 long, ends_sha256 string")


def prefix_nodes(
    turns: DataFrame, conversations: DataFrame, light_rows: int = 4096, shard_nodes: int = 16384, slice_rows: int = 100_000
) -> DataFrame:
    """One row per distinct prefix of the conversations.

    `turns` has (conv, at, c1, c2, words) with places 1, 2, ... in each conversation; `conversations` has one row `conv` each, also for
    those without turns. Columns: `conv_id`, the smallest member; `depth`; `parent_conv_id`, that of the parent; `n_convs`;
    `n_children`; `n_leaves` and `saved_tokens` over the subtree; `ends_sha256`.

    A prefix's digest is the exclusive or of the hashes of its turns with their places, 128 bits; so it runs through long conversations
    slice by slice, and the parent's digest is one step away. Nodes with at most `light_rows` turns below them hang in whole subtrees
    under larger ones. Such subtrees are dealt into shards of about `shard_nodes`; each enumerates its digests into slots and adds
    counts up through parent slots. A larger node gets the totals of the subtrees and large nodes below it by grouped sums
    along the conversations that own them, where the owner of a node is its smallest member.
    """
    hashed = [F.xxhash64("at", "c1", "c2").alias("p1"), F.xxhash64(F.lit(3), "c2", "c1", "at").alias("p2")]
    steps = stored(turns.select("conv", "at", "words", *hashed), "steps")
    chained = steps.withColumns({"x1": F.col("p1"), "x2": F.col("p2")})
    chained = running(chained, "conv", "at", ["p1", "p2"], F.bit_xor, lambda a, b: a.bitwiseXOR(b), slice_rows)
    own_ends = steps.groupBy("conv").agg(F.max("at").alias("len"), F.bit_xor("p1").alias("p1"), F.bit_xor("p2").alias("p2"))
    ends = conversations.select(F.col("conv").cast("long").alias("conv")).distinct().join(own_ends, "conv", "left")
    ends = stored(ends.na.fill(0, ["len", "p1", "p2"]), "ends")
    total = steps.count()
    turns_of = chained.select(
        "conv", F.col("at").alias("depth"), "words", "p1", "p2", F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("q2")
    )
    turns_of = join_groups(turns_of, ends.select("conv", "len"), ["conv"], "len", total)
    zero = F.lit(0).cast("long")
    roots = ends.select("conv", *[zero.alias(c) for c in ("depth", "words", "p1", "p2", "q1", "q2")], "len")
    rows = stored(turns_of.unionByName(roots), "prefixes")
    total = rows.count()
    nodes = rows.groupBy("p1", "p2").agg(
        F.min("conv").alias("owner"),
        F.count("*").alias("n_convs"),
        F.max("words").alias("node_words"),
        F.sum(F.col("len") - F.col("depth") + 1).alias("weight"),
    )
    nodes = stored(nodes, "nodes")
    placed = join_groups(rows.drop("words"), nodes.withColumnRenamed("node_words", "words"), ["p1", "p2"], "n_convs", total)
    light, owned = F.col("weight") <= light_rows, F.col("owner") == F.col("conv")
    # a conversation has at most `light_rows` of these
    top = F.first(F.xxhash64("p1", "p2")).over(W.partitionBy("conv").orderBy("depth"))
    below = stored(placed.where(light).withColumn("top", top).where(owned).drop("owner", "len", "weight"), "light_nodes")
    shards = max(1, -(-below.count() // shard_nodes))
    summed = below.withColumn("shard", F.pmod(F.xxhash64("top"), F.lit(shards))).drop("top").groupBy("shard").applyInPandas(_accumulate, LIGHT)
    summed = stored(summed, "summed")

    heavy = stored(placed.where(~light).select("conv", "depth", "p1", "p2", "owner", "n_convs", "words"), "heavy_prefixes")
    large = heavy.where(owned).drop("owner")
    # a child stands one step after its parent on the way of the child's owner
    before = heavy.select("conv", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent_conv"), "p1", "p2")
    hanging = large.select("conv", "depth").unionByName(summed.where("top").select("conv", "depth")).join(before, ["conv", "depth"], "left")
    hanging = stored(hanging, "hanging")
    children = hanging.groupBy("p1", "p2").agg(F.count("*").alias("n_children"))
    large = stored(large.join(children, ["p1", "p2"], "left").na.fill(0, ["n_children"]), "large_nodes")
    leaf = (F.col("n_children") == 0).cast("long")
    sources = large.select("conv", "depth", leaf.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    # the totals of a subtree enter at its parent, on the way of the conversation that owns its top
    entering = summed.where("top").select("conv", (F.col("depth") - 1).alias("depth"), "n_leaves", "saved")
    sources = sources.unionByName(entering).groupBy("conv", "depth").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    ways = heavy.select("conv", "depth", "p1", "p2").join(sources, ["conv", "depth"], "left").na.fill(0, ["n_leaves", "saved"])
    ways = running(stored(ways, "ways"), "conv", "depth", ["n_leaves", "saved"], F.sum, lambda a, b: a + b, slice_rows, backward=True)
    sums = ways.groupBy("p1", "p2").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    large = large.join(sums, ["p1", "p2"]).select("p1", "p2", "conv", "depth", "n_convs", "n_children", "n_leaves", "saved")

    tops = summed.where("top").drop("parent_conv", "top").unionByName(large)
    tops = tops.join(hanging.select("conv", "depth", "parent_conv"), ["conv", "depth"], "left")
    every = summed.where("not top").drop("top").unionByName(tops).join(ends_by_node(ends, slice_rows), ["p1", "p2"], "left")
    return every.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent_conv").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(
    turns: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text", **sizes: int
) -> DataFrame:
    """`prefix_nodes` of a table of turns, ordered by `order_col`, null first, then by a hash of role and text.

    Two turns are the same if role and text are, null counting as empty. Rows without a conversation are left out; repeated rows are
    turns of their own. Other columns are not read; an empty table gives no rows.
    """
    numbered = stored(number_turns(turns, id_col, order_col, role_col, text_col), "numbered")
    return prefix_nodes(numbered, numbered.select("conv"), **sizes)
