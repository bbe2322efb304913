"""Removal of repeated word windows: rolling hashes of every window, counted in Spark, merged into intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tradewind.llm.shared import id_bitmap, may_be_in, stored, text_or_empty
from tradewind.llm.words import GOLDEN, SPACE, Rolling, hashes_of, kept_text, mix, text_chunks, word_starts

#: Bytes of text that one step of a task holds as arrays.
CHUNK = 1 << 22
ANCHORS = "anchor long, n long, anchors long"
STRETCHES = "doc_id long, mark int, anchor long, start int, length int, hashes array<long>"
KEPT = "doc_id long, n_words long, n_removed long, text string"


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """`pick` (minimum or maximum) of every `width` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = pick(x[:-step], x[step:]) if len(x) > step else x[:0]
        have += step
    return x


def firsts(sorted_values: np.ndarray) -> np.ndarray:
    """True where a value differs from the one before it."""
    out = np.ones(len(sorted_values), bool)
    out[1:] = sorted_values[1:] != sorted_values[:-1]
    return out


class Windows:
    """The windows of a chunk that lie in one row: row, start in it, hash and anchor.

    The anchor of a window is the least hash of the `gram`-word pieces in it, so equal windows have the same anchor and
    neighbours mostly share one.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int, gram: int):
        starts, rows = word_starts(SPACE[data], offsets)
        rolling = Rolling(hashes_of(data, starts))
        n = max(0, len(starts) - width + 1)
        row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        self.at = np.flatnonzero(row[:n] == row[len(row) - n :])
        self.row = row[self.at]
        self.start = self.at - rows[self.row]
        self.hash = mix(rolling.at(self.at, width))
        pieces = mix(rolling.at(np.arange(max(0, len(starts) - gram + 1)), gram))
        self.anchor = sliding(pieces, width - gram + 1, np.minimum)[self.at]


def _frequent(width: int, gram: int, share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in text_chunks(batch.column("text"), CHUNK):
                anchor = Windows(data, offsets, width, gram).anchor
                value, n = np.unique(anchor[firsts(anchor)], return_counts=True)
                often = n * share > n.sum()
                total = np.zeros(int(often.sum()), np.int64)
                total[:1] = n.sum()  # once a chunk
                columns = [value[often].view(np.int64), n[often].astype(np.int64), total]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names(ANCHORS))

    return run


def hot_anchors(docs: DataFrame, width: int, gram: int, share: int) -> np.ndarray:
    """Anchors with more than 1/`share` of all, fewer than `share`: such a one is frequent in some chunk too.

    They only decide how windows are dealt out, never what is found.
    """
    found = stored(docs.select("text").mapInArrow(_frequent(width, gram, share), ANCHORS), "frequent_anchors")
    total = found.agg(F.sum("anchors")).first()[0] or 0
    hot = found.groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") * share > total).select("anchor")
    return np.sort(np.array([r.anchor for r in hot.collect()], np.int64).view(np.uint64))  # fewer than `share`


def _stretches(width: int, gram: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            null = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            _, rank = np.unique(ids, return_inverse=True)
            rank[null] = -1  # null comes first
            shared_ids = len(np.unique(rank)) < len(rank)
            for first_row, data, offsets in text_chunks(batch.column("text"), CHUNK):
                w = Windows(data, offsets, width, gram)
                row = w.row + first_row
                # of equal windows the first by (id, start); all that start later are known to repeat
                if shared_ids:
                    order = np.lexsort((w.start, rank[row], w.hash))
                else:
                    order = np.argsort(rank[row], kind="stable")
                    order = order[np.argsort(w.hash[order], kind="stable")]
                head = firsts(w.hash[order])
                head = order[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(order) else order
                known = np.zeros(len(row), bool)
                known[order] = (rank[row[order]] != rank[row[head]]) | (w.start[order] != w.start[head])
                # a stretch: neighbours of one row with one anchor; windows of a hot anchor go by their own hash
                hot_one = hot[np.minimum(np.searchsorted(hot, w.anchor), len(hot) - 1)] == w.anchor if len(hot) else np.zeros(len(row), bool)
                anchor = np.where(hot_one, w.hash, w.anchor)
                begin = firsts(w.at - np.arange(len(row))) | firsts(row) | firsts(known) | (~known & firsts(anchor))
                begins = np.flatnonzero(begin)
                length = np.diff(begins, append=len(row))
                done = known[begins]
                with np.errstate(over="ignore"):
                    spread = mix(ids[row[begins]].astype(np.uint64) * GOLDEN + begins.astype(np.uint64))
                anchors = np.where(done, spread, anchor[begins])
                bounds = np.concatenate([[0], np.cumsum(np.where(done, 0, length))]).astype(np.int32)
                hashes = pa.ListArray.from_arrays(pa.array(bounds), pa.array(w.hash[~known].view(np.int64)), mask=pa.array(done))
                columns = [pa.array(ids[row[begins]], mask=null[row[begins]]), batch.column("mark").take(pa.array(row[begins]))]
                columns += [pa.array(anchors.view(np.int64)), pa.array(w.start[begins], pa.int32()), pa.array(length, pa.int32()), hashes]
                yield pa.RecordBatch.from_arrays(columns, names=names(STRETCHES))

    return run


def repeated_windows(docs: DataFrame, width: int = 20, gram: int = 8, share: int = 10_000) -> DataFrame:
    """(doc_id, mark, start, length): `length` neighbouring windows whose words also start earlier.

    `docs` has doc_id, mark (a number that tells the rows of one id apart) and text. Earlier means a smaller id, null first, or
    the same id and a smaller start.

    Every window has a rolling (Rabin-Karp) hash. A task reduces the equal windows of a chunk to the first, so a window that
    stands in a third of all documents is one row a chunk. Windows are dealt out by their anchor, a piece that equal windows
    share, so neighbours travel as one row; those of hot anchors, by their own hash. What shares an anchor with nothing is
    unique; the others are ranked within (anchor, hash), 128 bits together.
    """
    hot = hot_anchors(docs, width, gram, share)
    stretches = docs.select("doc_id", "mark", "text").mapInArrow(_stretches(width, gram, hot), STRETCHES)
    met = stretches.repartition("anchor").withColumn("n", F.count("*").over(W.partitionBy("anchor")))
    opened = met.where("n > 1 or hashes is null").select("doc_id", "mark", "anchor", "start", "length", F.posexplode_outer("hashes").alias("nth", "hash"))
    in_order = W.partitionBy("anchor", "hash").orderBy(F.col("doc_id").asc_nulls_first(), F.col("start") + F.coalesce("nth", F.lit(0)))
    ranked = opened.withColumn("rank", F.rank().over(in_order)).where("hash is null or rank > 1")
    alone = F.col("hash").isNotNull()
    return ranked.select(
        "doc_id", "mark", F.when(alone, F.col("start") + F.col("nth")).otherwise(F.col("start")).alias("start"), F.when(alone, 1).otherwise(F.col("length")).alias("length")
    )


def covered(rows: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which words lie in an interval [start, end) of their row; `rows` has where each row's words begin (rows + 1)."""
    depth = np.zeros(rows[-1] + 1, np.int64)
    np.add.at(depth, rows[row] + start, 1)
    np.add.at(depth, rows[row] + end, -1)
    return np.cumsum(depth)[:-1] > 0


def _remove(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = batch.column("cuts")
            if isinstance(cuts, pa.ChunkedArray):
                cuts = cuts.combine_chunks()
            cuts = pa.compute.fill_null(cuts, pa.scalar([], cuts.type)) if cuts.null_count else cuts
            bounds, flat = cuts.offsets.to_numpy(), cuts.values
            begin, length = flat.field("start").to_numpy(), flat.field("length").to_numpy()
            for at, data, offsets in text_chunks(batch.column("text"), CHUNK):
                n = len(offsets) - 1
                starts, rows = word_starts(SPACE[data], offsets)
                here = slice(bounds[at], bounds[at + n])
                row = np.repeat(np.arange(n), np.diff(bounds[at : at + n + 1]))
                keep = ~covered(rows, row, begin[here], begin[here] + length[here] - 1 + width)
                gone = np.diff(np.concatenate([[0], np.cumsum(~keep)])[rows])
                columns = [batch.column("doc_id").slice(at, n), pa.array(np.diff(rows)), pa.array(gone), kept_text(data, offsets, starts, rows, keep).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=names(KEPT))

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, gram: int = 8, share: int = 10_000
) -> DataFrame:
    """Per row its id, number of words `[^\\x20\\x09-\\x0D]+`, number of words removed and what is left, joined by one space.

    A window is `width` consecutive words of one text, as they are. A word goes if a window that covers it also starts
    earlier: in a text of smaller id (null is the smallest) or earlier in the same one. All windows are judged on the
    input. Repeated windows are merged into intervals per text before the text is read again.

    A null text is empty; texts without words, or with fewer than `width`, lose nothing. Rows of one id are told apart by
    their text; a window at the same start of another row of the same id is not earlier. Repeated rows fare alike. Other columns are
    not read; an empty table gives no rows.
    """
    if not 0 < gram <= width:
        raise ValueError("a piece of a window has between one and all of its words")
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    named = named.select("doc_id", F.hash("text").alias("mark"), "text")
    repeats = repeated_windows(named, width, gram, share)
    cuts = repeats.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "length")).alias("cuts"))
    cuts = stored(cuts, "cuts")  # per text at most one start a word
    marked = may_be_in(named, id_bitmap(cuts, "doc_id"), "doc_id")
    none = F.lit(None).cast(cuts.schema["cuts"].dataType)
    clear = marked.where(~F.col("_maybe")).select("doc_id", "text", none.alias("cuts"))
    maybe = marked.where("_maybe").select("doc_id", "mark", "text").alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.mark") == F.col("c.mark"))
    joined = maybe.join(cuts.alias("c"), same, "left").select("d.doc_id", "d.text", "c.cuts")
    return clear.unionByName(joined).mapInArrow(_remove(width), KEPT)
