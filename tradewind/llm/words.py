"""Words and word shingles of Arrow text columns as 64-bit hashes, many documents at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


GOLDEN = np.uint64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    CODE = np.where(SPACE, np.uint64(0), mix(_BYTES.astype(np.uint64) * GOLDEN + np.uint64(1)))
    STEP = np.uint64(0xD6E8FEB86659FD93)
    POWER = np.cumprod(np.full(64, STEP, np.uint64))


def text_chunks(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them), about `size` bytes or one row at a time; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_starts(space: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words `[^\\x20\\x09-\\x0D]+` begin, and how many begin before each row and the end (rows + 1)."""
    begins = np.empty(len(space), bool)
    if len(space):
        begins[0] = True
        begins[1:] = space[:-1]
        begins[offsets[:-1][offsets[:-1] < len(space)]] = True
        begins &= ~space
    starts = np.flatnonzero(begins)
    return starts, np.searchsorted(starts, offsets)


def hashes_of(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each word; white space after a word does not count."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = np.diff(starts, append=len(data))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    longest = int(lengths.max())
    with np.errstate(over="ignore"):
        power = POWER if longest <= len(POWER) else np.cumprod(np.full(longest, STEP, np.uint64))
        return mix(np.add.reduceat(CODE[data[starts[0] :]] * power[place], starts - starts[0]))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z lower-cased, and where each row's words begin (rows + 1)."""
    low = LOWER[data]
    starts, rows = word_starts(SPACE[low], offsets)
    return hashes_of(low, starts), rows


#: An odd number, its powers and those of its inverse modulo 2**64 for rolling hashes of any window.
BASE, INVERSE = 0x9D39247E33776D41, pow(0x9D39247E33776D41, -1, 1 << 64)


class Rolling:
    """Rabin-Karp hashes of the windows of a row of word hashes, from one running sum: those of all widths cost alike."""

    def __init__(self, words: np.ndarray):
        with np.errstate(over="ignore"):
            n = len(words)
            up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE, np.uint64)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, INVERSE, np.uint64)]))
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:-1])])

    def at(self, starts: np.ndarray, width) -> np.ndarray:
        """Hashes of the windows of `width` words (one number or one a start)."""
        with np.errstate(over="ignore"):
            return (self.sums[starts + width] - self.sums[starts]) * self.down[starts]


def kept_text(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, rows: np.ndarray, keep: np.ndarray) -> pa.Array:
    """Per row its words marked in `keep`, joined by one space."""
    space = SPACE[data]
    taken = np.zeros(len(data) + 1, bool)
    if len(starts):
        lengths = np.diff(starts, append=len(data))
        taken[starts[0] : -1] = np.repeat(keep, lengths) & ~space[starts[0] :]
        # each kept word but the last of its row takes the white space that follows it along
        ends = starts + np.add.reduceat(~space, starts)
        row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))[keep]
        more = np.append(row[1:] == row[:-1], False) if len(row) else np.zeros(0, bool)
        taken[ends[keep][more]] = True
    taken = taken[:-1]
    out = np.where(space, np.uint8(32), data)[taken]
    bounds = np.concatenate([[0], np.cumsum(taken)])[offsets].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(out)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Per row its distinct shingles of `width` words, sorted; a shorter row is one shingle, a row without words none."""
    words, rows = word_hashes(data, offsets)
    out = []
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(width, np.uint64(0xA24BAED4963EE407), np.uint64))
        n = max(0, len(words) - width + 1)
        full = np.zeros(n, np.uint64)
        for k in range(width):
            full += words[k : k + n] * power[k]
        full = mix(full)
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
            if b - a >= width:
                s = np.sort(full[a : b - width + 1])
                out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            elif b > a:
                out.append(mix((words[a:b] * power[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
