"""Packing documents into token sequences along a space-filling curve."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tradewind.llm.shared import text_or_empty
from tradewind.llm.words import GOLDEN, mix, text_chunks, word_hashes

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long, curve_key long"
)


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer coordinates in [0, 2**bits)."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    side = 1 << (bits - 1)
    while side > 1:  # undo the turns of the curve from the coarsest cell to the finest
        low = side - 1
        for i in range(n):
            flip = (x[i] & side) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        side >>= 1
    for i in range(1, n):  # Gray code across the axes
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    side = 1 << (bits - 1)
    while side > 1:
        turn = np.where((x[n - 1] & side) != 0, turn ^ (side - 1), turn)
        side >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def projection(features: int, dimensions: int) -> np.ndarray:
    """A fixed matrix of signs, so that every task projects alike."""
    with np.errstate(over="ignore"):
        h = mix(np.arange(features * dimensions, dtype=np.uint64) * GOLDEN + np.uint64(5))
    return np.where(h & np.uint64(1), 1.0, -1.0).reshape(features, dimensions)


def curve_keys(texts: pa.Array, features: int = 512, dimensions: int = 3, bits: int = 12) -> np.ndarray:
    """Hilbert keys of texts: word counts hashed to a vector, damped, scaled to length one and projected."""
    axes = projection(features, dimensions)
    keys = np.zeros(len(texts), np.int64)
    for at, data, offsets in text_chunks(texts):
        words, rows = word_hashes(data, offsets)
        n = len(offsets) - 1
        cell = np.repeat(np.arange(n), np.diff(rows)) * features + (words % np.uint64(features)).astype(np.int64)
        vectors = np.log1p(np.bincount(cell, minlength=n * features).reshape(n, features))
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        places = np.clip((vectors @ axes + 4.0) / 8.0, 0, 1 - 1e-9) * (1 << bits)
        keys[at : at + n] = hilbert_keys(places.astype(np.int64), bits)
    return keys


class _Odd(Exception):
    """White space beside a space: the text is not cut at its spaces."""


class _Parts(dict):
    """Ids of what stands after a space, as little-endian bytes; filled as parts come up, emptied when it has grown large."""

    def __init__(self, encode, lead: str, most: int = 300_000):
        super().__init__()
        self.encode, self.lead, self.most = encode, lead, most

    def __missing__(self, part: str) -> bytes:
        if not part or part[0].isspace() or part[-1].isspace():
            raise _Odd
        ids = self.encode(self.lead + part)
        if len(part) <= 48:
            if len(self) >= self.most:
                self.clear()
            self[part] = ids
        return ids


class Encoder:
    """Ids of the byte-level vocabulary `json_path`, as unsigned little-endian 32-bit bytes.

    A single space between two characters that are no white space always begins a token of this vocabulary, so a text
    is cut there and the ids of each part are looked up. With `ranks_path`, the same vocabulary as ranks, parts of
    Latin letters are encoded by the faster library; all others by the tokenizer of `json_path`.
    """

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        self.slow.encode_special_tokens = True  # their strings in a text are ordinary text
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.first, self.others = _Parts(self.whole, ""), _Parts(self.whole, " ")

    def whole(self, text: str) -> bytes:
        if self.fast is not None and (text.isascii() or max(text) < "ɀ"):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.slow.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        head, *rest = text.split(" ")
        if not rest:
            return self.whole(text)
        try:
            return self.first[head] + b"".join(map(self.others.__getitem__, rest))
        except _Odd:
            return self.whole(text)


def cut_tail(length: int) -> list[int]:
    """Powers of two that add up to `length`, largest first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def _pack(json_path: str, ranks_path: str | None, pattern: str | None, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(json_path, ranks_path, pattern)
        waiting: list[tuple] = []  # pieces of the sequence that is being filled
        fill, sequence = 0, None
        out: list[tuple] = []

        def table() -> pa.RecordBatch:
            columns = zip(*out)
            names = [c.split()[0] for c in PIECES.split(", ")]
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=names)
            out.clear()
            return batch

        def emit(pieces: list[tuple], length: int) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, total, key in pieces:
                out.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset, length, key))
                offset += len(ids) // 4
            sequence += 1

        for batch in batches:
            if sequence is None and batch.num_rows:
                sequence = batch.column("part")[0].as_py() << 40
            for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), batch.column("text")):
                ids = memoryview(encode(text.as_py()) + b"\0\0\0\0")
                total, at = len(ids) // 4, 0
                while at < total:
                    take = min(size - fill, total - at)
                    waiting.append((doc, at, ids[4 * at : 4 * (at + take)], total, key))
                    fill, at = fill + take, at + take
                    if fill == size:
                        emit(waiting, size)
                        waiting, fill = [], 0
                if len(out) >= 20_000:
                    yield table()
        for length in cut_tail(fill):
            pieces, room = [], length
            while room:
                doc, start, ids, total, key = waiting.pop(0)
                take = min(room, len(ids) // 4)
                pieces.append((doc, start, ids[: 4 * take], total, key))
                if 4 * take < len(ids):
                    waiting.insert(0, (doc, start + take, ids[4 * take :], total, key))
                room -= take
            emit(pieces, length)
        if out:
            yield table()

    return run


def pack_sequences(
    docs: DataFrame,
    json_path: str,
    ranks_path: str | None = None,
    pattern: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 1024,
    partitions: int | None = None,
) -> DataFrame:
    """Pieces of documents in sequences of at most `size` tokens, neighbours on the curve side by side.

    The rows are dealt into ranges of (curve key, id), so equal texts, whatever their number, fill many ranges. Each range
    is packed by itself as its rows stream by: tokens fill one sequence after the other, cut wherever one is full, and
    what is left at the end of the range is cut into sequences whose lengths are powers of two. So nothing is padded.

    A null or empty text is the separator id 0 alone. Rows that repeat an id, or have none, are packed like any other.
    Columns other than the two named are not read; an empty table gives no rows. Sequence ids are unique, not gapless;
    they hold the number of the range in their upper bits.
    """

    @F.arrow_udf("long")
    def key_of(texts: pa.Array) -> pa.Array:
        return pa.array(curve_keys(texts), pa.int64())

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    keyed = named.withColumn("key", key_of("text"))
    ranges = keyed.repartitionByRange(*([partitions] if partitions else []), "key", "doc_id")
    ordered = ranges.sortWithinPartitions("key", "doc_id", "text").select(
        F.spark_partition_id().cast("long").alias("part"), "doc_id", "key", "text"
    )
    return ordered.mapInArrow(_pack(json_path, ranks_path, pattern, size), PIECES)
