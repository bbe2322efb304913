"""Prefix trie, repeated windows and periodic runs against brute-force versions, on whole small tables and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewind.llm import periodic, queries, substrings, tries
from tradewind.llm.words import Rolling

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words_of(text):
    return re.findall(WORD, text or "")


def crc(number):
    return zlib.crc32(str(number).encode())


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]


# ---- windows


def without_repeats(rows, width=20):
    """(words, removed, kept text) of each row by ascending id, from a table of all windows."""
    first = {}
    cuts = {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = words_of(text)
        gone = set()
        for a in range(len(w) - width + 1):
            if first.setdefault(tuple(w[a : a + width]), (i, a)) != (i, a):
                gone.update(range(a, a + width))
        cuts[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return cuts


def removed(frame, **options):
    rows = substrings.remove_repeats(frame, **options).collect()
    return {r.doc_id: (r.n_words, r.n_removed, sha(r.text)) for r in rows}


def test_query_of_windows_matches_brute_force(spark, texts):
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.repeated_windows(spark, SF).collect()}
    expected = without_repeats(texts)
    assert found == expected and any(n for _, n, _ in expected.values())


def shared_passages(seed):
    """Texts that share passages, repeat themselves and overlap, with white space of all kinds."""
    rng = np.random.default_rng(seed)
    pool = [[f"w{x}" for x in rng.integers(0, 60, rng.integers(5, 70))] for _ in range(8)]
    rows = []
    for i in rng.permutation(60).tolist():
        parts = [pool[k] if k < 8 else [f"é{x}" for x in rng.integers(0, 4, 30)] for k in rng.integers(0, 11, rng.integers(0, 6))]
        w = [x for p in parts for x in p]
        rows.append((i, "".join(x + rng.choice([" ", "\n", "\t ", "  ", " "]) for x in w)))
    return rows


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("share", [2, 10_000])
def test_windows_match_brute_force(spark, seed, share):
    """With `share` = 2 no anchor is hot; with 10,000 nearly all of so few are."""
    rows = shared_passages(seed)
    frame = spark.createDataFrame(rows, DOCS).repartition(5)
    assert removed(frame, share=share) == without_repeats(rows)


def test_one_passage_in_every_text(spark):
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [(i, f"own{i} start {passage} own{i} end") for i in range(500)] + [(900, "same " * 300)]
    frame = spark.createDataFrame(rows, DOCS).repartition(7)
    assert removed(frame) == without_repeats(rows)


def test_windows_of_odd_rows(spark):
    long = " ".join(f"word{i % 7000}" for i in range(40_000))
    short = " ".join(f"s{i}" for i in range(19))
    rows = [(1, None), (2, ""), (3, " \t\n\x0b"), (4, short), (5, short), (6, short + " end"), (7, short + " end"), (8, long), (None, short + " end")]
    frame = spark.createDataFrame(rows, DOCS).select("*", *[F.lit("x").alias(c) for c in ("mark", "cuts", "anchor", "start", "_maybe", "n")])
    expected = without_repeats(rows)
    assert removed(frame) == expected and expected[6][1] == 20 and expected[None][1] == 0 and expected[8][1] > 32_000
    twice = substrings.remove_repeats(spark.createDataFrame([(1, short + " end")] * 2, DOCS)).collect()
    assert [r.n_removed for r in twice] == [0, 0]
    assert substrings.remove_repeats(frame.where("false")).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(frame, width=4, gram=5)


def test_rolling_hashes_depend_on_the_window_alone():
    x = np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64)
    twice = Rolling(np.concatenate([x, x]))
    for width in (1, 7, 50):
        a, b = twice.at(np.arange(51 - width), width), twice.at(np.arange(50, 101 - width), width)
        assert (a == b).all() and len(np.unique(a)) == len(a)


# ---- runs


def plain_runs(w, powers=4, shortest=6):
    """All maximal runs by trying every period."""
    found = {}
    for q in range(1, len(w) // powers + 1):
        a = 0
        while a + q < len(w):
            b = a
            while b + q < len(w) and w[b] == w[b + q]:
                b += 1
            if b > a and b + q - a >= max(shortest, powers * q):
                found.setdefault((a, b + q - a), q)
            a = b + 1
    return sorted((a, n, q) for (a, n), q in found.items())


def collapsed(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def planted(i, text):
    w = words_of(text)
    h, n = crc(i), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
    return w


def runs_digest(w):
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    exponent = 1000 * best[1] // best[2] if runs else None
    return (len(runs), *best, exponent, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(collapsed(w, runs)))


def test_query_of_runs_matches_brute_force(spark, texts):
    found = {r.doc_id: tuple(r)[1:] for r in queries.periodic_runs(spark, SF).collect()}
    short = {i: t for i, t in texts if len(words_of(t)) <= 3000}
    expected = {i: runs_digest(planted(i, t)) for i, t in short.items()}
    assert len(found) == len(texts) and {i: found[i] for i in short} == expected
    assert sum(e[0] > 0 for e in expected.values()) > 5


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_runs_match_brute_force(spark, letters):
    rng = np.random.default_rng(letters)
    rows = []
    for i in range(150):
        w = []
        while len(w) < rng.integers(0, 120):
            block = [f"x{k}" for k in rng.integers(0, letters, rng.integers(1, 9))]
            w += block * int(rng.integers(1, 7))
        rows.append((i, "\n ".join(w)))
    found = periodic.find_runs(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    for r in found:
        w = words_of(dict(rows)[r.doc_id])
        runs = plain_runs(w)
        assert [(x.start, x.length, x.period) for x in r.runs] == runs and r.text == collapsed(w, runs) and r.n_words == len(w)


def test_runs_of_odd_rows(spark):
    fibonacci = ["a", "a b"]
    while len(fibonacci) < 18:
        fibonacci.append(fibonacci[-1] + " " + fibonacci[-2])
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a " * 5), (5, "a " * 6), (6, "é b " * 40_000), (7, fibonacci[-1]), (None, "b " * 9), (8, "a " * 9), (8, "a " * 9)]
    frame = spark.createDataFrame(rows, DOCS).select("*", F.lit("x").alias("runs"), F.lit(1).alias("n_words"))
    found = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.text) for r in periodic.find_runs(frame).collect()), key=lambda r: r[0] or 0)
    assert [r[0] for r in found] == [None, 1, 2, 3, 4, 5, 6, 7, 8, 8]
    by = {r[0]: r[1:] for r in found}
    assert by[1] == by[2] == by[3] == (0, [], "") and by[4] == (5, [], "a a a a a")
    assert by[5] == (6, [(0, 6, 1)], "a") and by[6] == (80_000, [(0, 80_000, 2)], "é b") and by[8][1] == [(0, 9, 1)]
    # no word of this sequence is repeated four times in a row
    assert by[7][1] == plain_runs(fibonacci[-1].split()) == []
    assert periodic.find_runs(frame.where("false")).count() == 0


# ---- prefixes


def rebuilt(rows):
    own = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = crc(c) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def plain_trie(conversations):
    """The contract's row of every prefix."""
    members, ends = {}, {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not children[p]
        saved[p] += (len(members[p]) - 1) * len(words_of(p[-1][1])) if p else 0
        if p:
            children[p[:-1]] += 1
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    return Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(",".join(map(str, sorted(ends.get(p, []))))))
        for p, m in members.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string"


def nodes(frame):
    return Counter(tuple(r) for r in frame.select(COLUMNS).collect())


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.01"])
def test_query_of_prefixes_matches_brute_force(spark, folder):
    rows = [tuple(r) for r in queries.table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(queries.conversation_trie(spark, folder)) == plain_trie(rebuilt(rows))


@pytest.mark.parametrize("sizes", [{}, {"light_rows": 3, "shard_nodes": 5, "slice_rows": 4}, {"light_rows": 40, "shard_nodes": 1, "slice_rows": 7}])
def test_prefixes_match_brute_force(spark, sizes):
    """Small sizes send nodes through every way: large ones, subtrees of several shards, sliced conversations and ends."""
    rng = np.random.default_rng(4)
    conversations = {}
    for c in range(120):
        old = conversations[int(rng.integers(0, c))] if c else []
        conversations[c * 3 - 50] = []
        keep = old[: rng.integers(0, 15)]
        conversations[c] = keep + [("user", f"say {x}  {x}") for x in rng.integers(0, 3, rng.integers(0, 6))]
    conversations = {c: t for c, t in conversations.items() if t}
    rows = [(c, k, *turn) for c, turns in conversations.items() for k, turn in enumerate(turns)]
    frame = spark.createDataFrame(rows, TURNS).repartition(3)
    assert nodes(tries.prefix_trie(frame, **sizes)) == plain_trie(conversations)


def test_prefixes_of_odd_rows(spark):
    long = [(7, k, "user", f"t{k % 5}") for k in range(3000)]
    rows = [(1, None, None, None), (1, 0, "user", "a b"), (2, None, "", ""), (2, 5, "user", "a b"), (3, 1, "user", ""), (3, 1, "user", ""), (None, 1, "user", "x"), *long, *[(8, k, r, t) for _, k, r, t in long]]
    frame = spark.createDataFrame(rows, TURNS).select("*", *[F.lit("x").alias(c) for c in ("conv", "at", "words", "p1", "key", "top")])
    plain = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        plain.setdefault(c, []).append((role or "", text or ""))
    assert nodes(tries.prefix_trie(frame)) == plain_trie(plain)
    assert nodes(tries.prefix_trie(frame, light_rows=100, slice_rows=64)) == plain_trie(plain)
    assert tries.prefix_trie(frame.where("false")).count() == 0


def test_rebuilt_conversations_of_odd_rows(spark):
    """Openings that are shorter than asked, families without a first conversation, conversations left without turns."""
    rows = [(c, k, "user", f"{c % 3} {k}") for c in range(20, 60) if c != 40 for k in range(1 + c % 5)] + [(41, None, None, None)]
    expected = rebuilt(rows)
    assert any(not t for t in expected.values())
    frame = spark.createDataFrame(rows, TURNS)
    assert nodes(tries.prefix_nodes(*queries.rebuilt_turns(frame))) == plain_trie(expected)
    assert tries.prefix_nodes(*queries.rebuilt_turns(frame.where("false"))).count() == 0


def test_slots_are_a_minimal_perfect_hash():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 5000):
        digests = rng.integers(0, 2**63, (n, 2)).astype(np.uint64)
        table = tries.SlotTable(digests)
        assert sorted(table.find(digests).tolist()) == list(range(n))
        assert (table.find(rng.integers(0, 2**63, (100, 2)).astype(np.uint64)) == -1).all()
