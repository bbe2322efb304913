"""Periodic runs of words, found in a grammar of each text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tradewind.llm.shared import text_or_empty
from tradewind.llm.substrings import covered, firsts
from tradewind.llm.words import SPACE, Rolling, hashes_of, kept_text, mix, text_chunks, word_starts

RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, text string"
#: Comparisons that one step holds as arrays.
STEP = 1 << 21


def word_ids(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Small numbers for the words; equal words of different rows get different ones."""
    with np.errstate(over="ignore"):
        _, ids = np.unique(mix(hashes + mix(row.astype(np.uint64))), return_inverse=True)
    return ids.astype(np.int64)


class Grammar:
    """Re-Pair of many rows at a time.

    In each round every pair that occurs at least twice, and more often than the pairs it overlaps, becomes a
    nonterminal; a stretch of one symbol is paired from its left. `born` lists each nonterminal's places in the text, so
    no derivation has to be unfolded later. What is left has no pair twice: it is the start rule of each row.
    """

    def __init__(self, ids: np.ndarray, row: np.ndarray):
        n = len(ids)
        self.lengths = [np.ones(n and int(ids.max()) + 1, np.int64)]
        symbols = len(self.lengths[0])
        seq, place, seq_row = ids, np.arange(n), row
        done, born = [], []
        known, known_as = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(seq) > 1:
            pair = (seq[:-1] << 32) | seq[1:]
            order = np.argsort(pair, kind="stable")
            new = firsts(pair[order])
            group = np.empty(len(pair), np.int64)
            group[order] = np.cumsum(new) - 1
            count = np.diff(np.flatnonzero(new), append=len(pair))
            often = count[group] > 1
            # rows without a repeated pair are finished
            busy = np.zeros(int(seq_row[-1]) + 1, bool)
            busy[seq_row[:-1][often]] = True
            if not busy.any():
                break
            rank = np.where(often, count[group] * len(count) + group, -1)
            before, after = np.append(-1, rank[:-1]), np.append(rank[1:], -1)
            # a plateau is a stretch of one symbol; it counts as a whole and is paired at its even places
            begin = firsts(rank) | ~often
            heads = np.flatnonzero(begin)
            plateau = np.cumsum(begin) - 1
            ends = np.append(heads[1:], len(rank)) - 1
            wins = often[heads] & (before[heads] < rank[heads]) & (after[ends] < rank[heads])
            chosen = np.flatnonzero(wins[plateau] & ((np.arange(len(rank)) - heads[plateau]) % 2 == 0))
            # names: a pair that was named in an earlier round keeps its nonterminal
            value, nth = np.unique(pair[chosen], return_inverse=True)
            if len(known):
                at = np.minimum(np.searchsorted(known, value), len(known) - 1)
                old = known[at] == value
            else:
                at, old = np.zeros(len(value), np.int64), np.zeros(len(value), bool)
            name = np.empty(len(value), np.int64)
            name[old] = known_as[at[old]]
            name[~old] = symbols + np.arange(int((~old).sum()))
            sizes = np.concatenate(self.lengths)
            self.lengths.append(sizes[value[~old] >> 32] + sizes[value[~old] & 0xFFFFFFFF])
            symbols += int((~old).sum())
            known, known_as = np.concatenate([known, value[~old]]), np.concatenate([known_as, name[~old]])
            sort = np.argsort(known)
            known, known_as = known[sort], known_as[sort]
            left = sizes[seq[chosen]]
            born.append((name[nth], place[chosen], place[chosen] + left))
            seq = seq.copy()
            seq[chosen] = name[nth]
            stays = np.ones(len(seq), bool)
            stays[chosen + 1] = False
            idle = ~busy[seq_row]
            done.append((seq_row[idle], place[idle]))
            stays &= ~idle
            seq, place, seq_row = seq[stays], place[stays], seq_row[stays]
        done.append((seq_row, place))
        self.sizes = np.concatenate(self.lengths)
        #: (symbol, place, middle) of every occurrence of a nonterminal at its birth
        self.symbol, self.place, self.middle = (np.concatenate(x) if born else np.zeros(0, np.int64) for x in (zip(*born) if born else [()] * 3))
        top_row, top = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(top, kind="stable")
        #: where the symbols of the start rules stand
        self.top_row, self.top = top_row[order], top[order]

    def joints(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(low, middle, high, symbol) of every node to look at: one place of each nonterminal, and the start rules, whose
        symbols are paired level by level, with symbol -1."""
        _, one = np.unique(self.symbol, return_index=True)
        low, middle, symbol = self.place[one], self.middle[one], self.symbol[one]
        out = [(low, middle, low + self.sizes[symbol], symbol)]
        low, row = self.top, self.top_row
        high = np.append(low[1:], rows[-1]) if len(low) else low
        high = np.minimum(high, rows[row + 1]) if len(low) else high
        while len(low):
            number = np.arange(len(row)) - np.searchsorted(row, row)
            left = np.flatnonzero((number % 2 == 0) & np.append(row[1:] == row[:-1], False))
            if not len(left):
                break
            out.append((low[left], low[left + 1], high[left + 1], np.full(len(left), -1)))
            high = high.copy()
            high[left] = high[left + 1]
            low, high, row = low[number % 2 == 0], high[number % 2 == 0], row[number % 2 == 0]
        return tuple(np.concatenate(x) for x in zip(*out))


def extent(rolling: Rolling, i: np.ndarray, q: np.ndarray, room: np.ndarray, backward: bool) -> np.ndarray:
    """How many words from `i` on (or before `i`), at most `room`, equal those `q` further on."""
    least, most = np.zeros(len(i), np.int64), room.copy()
    while (least < most).any():
        half = (least + most + 1) // 2
        at = i - half if backward else i
        same = rolling.at(at, half) == rolling.at(at + q, half)
        least, most = np.where(same, half, least), np.where(same, most, half - 1)
    return least


def crossing_runs(ids: np.ndarray, rolling: Rolling, low, middle, high, powers: int, shortest: int):
    """(node, start, end, period): runs inside [low, high) that hold the words on both sides of `middle`.

    A run with period q holds the word before `middle` or the one q before it among those that equal the word q further on.
    So both are tried with all periods that fit `powers` times, and what agrees is extended to both sides.
    """
    room = (high - low) // powers
    room[high - low < shortest] = 0
    ends = np.cumsum(room)
    found = []
    for first in range(0, int(ends[-1]) if len(ends) else 0, STEP):
        index = np.arange(first, min(first + STEP, int(ends[-1])))
        node = np.searchsorted(ends, index, "right")
        q = index - (ends[node] - room[node]) + 1
        for before in (np.ones(len(q), np.int64), q):
            i = middle[node] - before
            fits = (i >= low[node]) & (i + q < high[node])
            fits &= ids[np.where(fits, i, 0)] == ids[np.where(fits, i + q, 0)]
            # more than one word in a row must agree
            some = np.flatnonzero(fits)
            a, b, lo, hi = i[some], q[some], low[node[some]], high[node[some]]
            up, down = np.minimum(a + 1, len(ids) - 1 - b), np.maximum(a - 1, 0)
            near = ((a + 1 + b < hi) & (ids[up] == ids[up + b])) | ((a - 1 >= lo) & (ids[down] == ids[down + b]))
            some, a, b, lo, hi = (x[near] for x in (some, a, b, lo, hi))
            right = extent(rolling, a, b, hi - b - a, False)
            left = extent(rolling, a, b, a - lo, True)
            start, end = a - left, a + right + b
            long = end - start >= np.maximum(shortest, powers * b)
            found.append((node[some][long], start[long], end[long], b[long]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    node, start, end, q = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((q, end, start, node))
    node, start, end, q = (x[order] for x in (node, start, end, q))
    smallest = firsts(node) | firsts(start) | firsts(end)  # the others are multiples of the smallest period
    return node[smallest], start[smallest], end[smallest], q[smallest]


def maximal_runs(ids: np.ndarray, hashes: np.ndarray, rows: np.ndarray, powers: int, shortest: int):
    """(row, start, end, period) of all runs, by row, start and period; `rows` has where each row's words begin (rows + 1)."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    grammar = Grammar(ids, row)
    low, middle, high, symbol = grammar.joints(rows)
    node, start, end, q = crossing_runs(ids, Rolling(hashes), low, middle, high, powers, shortest)
    # a run of a nonterminal stands at each of its places
    inner = symbol[node] >= 0
    order = np.argsort(grammar.symbol, kind="stable")
    by_symbol, places = grammar.symbol[order], grammar.place[order]
    first, last = (np.searchsorted(by_symbol, symbol[node[inner]], side) for side in ("left", "right"))
    times = last - first
    which = np.repeat(np.flatnonzero(inner), times)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    shift = places[np.repeat(first, times) + nth] - low[node[which]]
    start = np.concatenate([start[which] + shift, start[~inner]])
    end = np.concatenate([end[which] + shift, end[~inner]])
    q = np.concatenate([q[which], q[~inner]])
    # what a node cuts off lies inside the whole run, which a node above it holds
    order = np.lexsort((-end, start, q, row[start]))
    start, end, q = start[order], end[order], q[order]
    series = np.cumsum(firsts(row[start]) | firsts(q))
    far = np.maximum.accumulate(end + series * (len(ids) + 1)) if len(end) else end
    inside = np.append(False, far[:-1] >= (end + series * (len(ids) + 1))[1:]) if len(end) else np.zeros(0, bool)
    start, end, q = start[~inside], end[~inside], q[~inside]
    order = np.lexsort((q, start))
    return row[start[order]], start[order], end[order], q[order]


def _runs(powers: int, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in text_chunks(batch.column("text")):
                n = len(offsets) - 1
                starts, rows = word_starts(SPACE[data], offsets)
                hashes = hashes_of(data, starts)
                ids = word_ids(hashes, np.repeat(np.arange(n), np.diff(rows)))
                row, start, end, q = maximal_runs(ids, hashes, rows, powers, shortest)
                begin = start - rows[row]
                keep = ~covered(rows, row, begin + q, begin + (end - start))
                runs = pa.StructArray.from_arrays([pa.array(x) for x in (begin, end - start, q)], names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), runs)
                columns = [batch.column("doc_id").slice(at, n), pa.array(np.diff(rows)), lists, kept_text(data, offsets, starts, rows, keep).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "text"])

    return run


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", powers: int = 4, shortest: int = 6) -> DataFrame:
    """Per row its id, number of words `[^\\x20\\x09-\\x0D]+`, the periodic runs of words, and the text without repetitions.

    A run is a stretch of at least max(`shortest`, `powers` * q) consecutive words with smallest period q (words q apart are
    identical) that neither neighbour extends. Runs are listed by start, then period. A word is left out of `text` if some run
    holds it after that run's first q words; the others are joined by one space.

    Each text gets a Re-Pair grammar. Runs that cross the boundary between the two parts of a nonterminal are computed once
    and hold at all its places; those across symbols of the start rule are found on a balanced tree over them. Every run
    crosses the boundary of the lowest node that holds it whole, so nothing is missed, and pieces inside it are dropped.

    A null text is empty; texts without words have no runs and an empty text. Every row is judged by itself, rows that
    repeat an id too. Other columns are not read; an empty table gives no rows. No row is moved between tasks.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return named.mapInArrow(_runs(powers, shortest), RUNS)
