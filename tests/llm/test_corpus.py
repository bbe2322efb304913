"""The corpus operators against brute-force versions, on whole small tables and on rows with every oddity."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

import corpus_pipeline
from tradewind.llm import exact, language, licenses, mixing, neardup, packing, private, queries, rules, shared, sites, toxicity
from tradewind.llm.shared import connected_components
from tradewind.llm.words import shingle_sets

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
LONG = " ".join(f"word{i % 7000}" for i in range(40_000))
PROSE = "the quick brown fox jumps over the lazy dog and runs far away from here"
ODD = [
    (1, PROSE, "en", "a", 9), (2, PROSE.upper(), "en", "a", 9), (3, PROSE + " now", "en", None, 9), (4, None, None, None, None),
    (5, "", "de", "b", 0), (6, " \t\n", None, "b", 3), (7, LONG, "en", "c", None), (8, LONG, "en", "a", 1), (8, LONG, "en", "a", 1),
    (None, PROSE, None, None, None), (9, "12 34", "xx", "", 1), (10, "a  b\tc <|endoftext|> é漢字 x", "fr", "a", 2),
]
#: Names that the operators use themselves.
CLASHES = ["size", "key", "source_size", "n", "text__", "keep_id", "component", "label", "row", "p"]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return queries.table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame(ODD, schema)
    return frame.select("*", *[F.lit("x").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def word_sets(texts):
    out = {}
    for i, text in texts.items():
        w = re.findall(WORD, lower(text))
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def components(sets):
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates_match_all_pairs(docs, texts):
    sets = word_sets(texts)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    expected = {i: (len(sets[i]), c, c == i) for i, c in components(sets).items()}
    assert found == expected


def test_near_duplicates_of_odd_rows(odd, empty):
    found = {r.doc_id: r for r in neardup.near_duplicates(odd).collect()}
    assert found[2].component_id == 1 and found[3].component_id == 1 and found[8].component_id == 7
    assert found[5].n_shingles == 0 and found[5].kept and found[4].kept and found[None].kept
    assert neardup.near_duplicates(odd).count() == len(ODD) and neardup.near_duplicates(empty).count() == 0


def test_group_of_variants_is_one_component(spark):
    """Variants that are too far from each other but near the text they vary, beside texts that share a passage only."""
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for v in range(1, 41):
        rows.append((v, " ".join(f"v{v}x{i}" if i % 67 == v % 67 and i else w for i, w in enumerate(base))))
    rows += [(100 + k, " ".join([f"own{k}y{i}" for i in range(40)] + base[:150])) for k in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    expected = components(word_sets(dict(rows)))
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(frame).collect()} == expected


def test_components_are_the_smallest_ids_reachable(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 30)]
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    centers = set(root.values())
    assert {r.id: r.component for r in found} == {n: c for n, c in root.items() if n not in centers}


def test_super_minhash_estimates_overlap():
    rng = np.random.default_rng(3)
    for n in (5, 60, 900):
        x = rng.integers(1, 2**63, 2 * n).astype(np.uint64)
        a, b = neardup.super_minhash([x[: n + n // 2], x[n // 2 :]], 128)
        assert abs((a == b).mean() - len(set(x[: n + n // 2]) & set(x[n // 2 :])) / (2 * n)) < 0.25
    assert (neardup.super_minhash([np.zeros(0, np.uint64)]) == neardup.EMPTY).all()


def test_exact_groups_match_brute_force(docs, texts):
    groups = {}
    for i, text in texts.items():
        groups.setdefault(lower(text), []).append(i)
    expected = {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    found = exact.exact_duplicates(docs, exact.half_of(), bucket_keys=16).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found} == expected


def test_exact_groups_of_odd_rows(odd, empty):
    found = exact.exact_duplicates(odd, exact.half_of()).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == len(ODD) and by[1].keep_id == 2 and by[1].group_size == 3 and by[4].keep_id == 5 and by[8].group_size == 3
    assert exact.exact_duplicates(empty, exact.half_of()).count() == 0
    assert exact.drop_exact_duplicates(odd, exact.half_of()).columns == odd.columns


def test_binary_fuse_never_misses():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 100, 20_000):
        keys = rng.integers(0, 2**64, n, dtype=np.uint64)
        fuse = exact.BinaryFuse(keys)
        assert fuse.may_contain(keys).all()
        assert fuse.may_contain(rng.integers(0, 2**64, 5000, dtype=np.uint64)).mean() < 0.02


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_packing_gives_back_every_id(which, request):
    from tokenizers import Tokenizer

    frame = request.getfixturevalue(which)
    slow = Tokenizer.from_file(queries.TOKENIZER["json_path"])
    slow.encode_special_tokens = True
    pieces = packing.pack_sequences(frame, partitions=3, **queries.TOKENIZER).toPandas()
    whole = Counter()
    for r in frame.collect():
        ids = np.array(slow.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        whole[(r.doc_id, len(ids))] += len(ids)
        part = pieces[(pieces.doc_id == r.doc_id) & (pieces.doc_tokens == len(ids))] if r.doc_id is not None else pieces[pieces.doc_id.isna()]
        for p in part.itertuples():
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    assert pieces.length.sum() == sum(whole.values())
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all()
        total = int(g.length.sum())
        assert total <= 1024 and total & (total - 1) == 0


def test_fast_and_slow_tokenizers_agree():
    fast, slow = packing.Encoder(**queries.TOKENIZER), packing.Encoder(queries.TOKENIZER["json_path"], None, None)
    latin = "".join(map(chr, range(1, 0x240)))
    samples = [latin, " ".join(latin), "a".join(latin), " x".join(latin), "it's  two\n\n lines \t end ", "漢字 и кириллица 😀 " + PROSE, ""]
    for text in samples:
        assert fast(text) == slow.whole(text)


def test_hilbert_curve_visits_neighbours():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = side[np.argsort(packing.hilbert_keys(side, 3))]
    assert sorted(packing.hilbert_keys(side, 3).tolist()) == list(range(512))
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_mix_meets_its_targets(which, request):
    frame = request.getfixturevalue(which)
    found = mixing.mix_sources(frame, shard_words=5000, block_words=4).toPandas()
    rows = frame.select("doc_id", "text", "source").collect()
    assert len(found) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(re.findall(WORD, r.text or ""))
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(ordered)}
    goal, capped = 1.5 * sum(sizes.values()), set()
    while True:  # water-filling, one round of capping after the other
        free = [s for s in sizes if s not in capped]
        level = (goal - sum(2 * sizes[s] for s in capped)) / max(1, sum(weights[s] for s in free))
        over = [s for s in free if weights[s] * level > 2 * sizes[s]]
        if not over:
            break
        capped |= set(over)
    target = {s: 2.0 * sizes[s] if s in capped else weights[s] * level for s in sizes}
    found["source"] = found["source"].astype(object).where(found["source"].notna(), None)
    assert (found.taken <= 2 * found["size"]).all() and (found.taken >= 0).all()
    for r in found.itertuples():
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
    for s in sizes:
        own = found[found.source.isna()] if s is None else found[found.source == s]
        assert abs(own.taken.sum() - target[s]) <= 4 * (1 + own.shard.nunique())


def test_sainte_lague_gives_highest_quotients(spark):
    votes = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.0}
    frame = spark.createDataFrame([(0, p, v, 7) for p, v in votes.items()], "g int, party string, votes double, seats int")
    best = sorted(((-v / (2 * j - 1), p) for p, v in votes.items() if v for j in range(1, 8)))[:7]
    expected = Counter(p for _, p in best)
    assert {r.party: r.quota for r in mixing.sainte_lague(frame, ["g"], ["party"], "votes", "seats").collect()} == {p: expected[p] for p in votes}


def test_language_is_found_without_the_declared_one(docs, odd, empty):
    model = language.fit_language_model(docs, "text", "lang", "doc_id")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    found = language.identify_language(docs, model, hosts=(F.col("source"),)).collect()
    assert np.mean([truth[r.doc_id] == r.language for r in found]) > 0.97 and all(r.kept for r in found)
    by = {r.doc_id: r for r in language.identify_language(odd, model, declared=F.col("lang"), hosts=(F.col("source"),)).collect()}
    assert by[1].language == "en" and not by[4].kept and not by[5].kept and by[6].language is None and by[6].probability == 0
    assert language.identify_language(empty, model).count() == 0
    strange = [(1, "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια"), (2, "Все люди рождаются свободными и равными в своем достоинстве"), (3, "xkqj zvwq pfxz kjqv wzxq vbnq xzjk qqwx jzkv fqxw zvbk")]
    frame = docs.sparkSession.createDataFrame(strange, "doc_id long, text string")
    assert all(r.language is None and not r.kept and r.n_grams > 0 for r in language.identify_language(frame, model).collect())
    nothing = language.fit_language_model(empty, "text", "lang", "doc_id")
    assert nothing.languages == () and all(r.kept for r in language.identify_language(odd, nothing).collect())


def test_every_label_has_a_model(spark):
    word = lambda i: f"{chr(97 + i // 9)}{chr(107 + i % 9)}" * 4
    tail = spark.createDataFrame([(i, f"{word(i)} {word(i)[::-1]} " * 3, f"l{i}") for i in range(70)], "doc_id long, text string, lang string")
    bulk = spark.range(100, 20_000).select(F.col("id").alias("doc_id"), F.lit(PROSE).alias("text"), F.lit("en").alias("lang"))
    model = language.fit_language_model(bulk.unionByName(tail), "text", "lang", "doc_id")
    assert set(model.languages) == {"en", *(f"l{i}" for i in range(70))}
    found = {r.doc_id: r.language for r in language.identify_language(tail, model).collect()}
    assert found == {i: f"l{i}" for i in range(70)}


def test_licenses_are_found_with_spans(spark, odd, empty):
    grant = licenses.TEMPLATES["MIT-text"]
    changed = grant.replace("without limitation ", "").replace("Software", "Program", 1)
    rows = [(1, f"é {grant} end"), (2, f"some words {changed}\nLicensed under CC BY-NC 4.0."), (3, "nothing under any license here"), (4, None)]
    found = licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license) for r in found) == [(1, "MIT-text"), (2, "CC-BY-NC-4.0"), (2, "MIT-text")]
    first = next(r for r in found if r.doc_id == 1)
    assert first.coverage == 1.0 and rows[0][1][first.start : first.end] == grant.rstrip(".")
    assert 0.9 < next(r for r in found if r.license == "MIT-text" and r.doc_id == 2).coverage < 1
    assert licenses.find_licenses(odd).count() == 0 and licenses.find_licenses(empty).count() == 0


def test_broken_and_repeated_licenses_are_found(spark):
    grant = licenses.TEMPLATES["MIT-text"].split()
    clause = " ".join(f"w{i}" for i in range(20))
    drift = " ".join(w + (" br br br br br" if i % 20 == 19 else "") for i, w in enumerate(grant))
    rows = [(1, " ".join([*grant[:45], clause, *grant[45:]])), (2, drift), (3, "Released under the MIT License.\n" * 40), (4, "Released under the MIT License. * " * 3 + "x Released under the MIT License.")]
    found = licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.license, r.coverage) for r in found) == {(1, "MIT-text", 1.0): 1, (2, "MIT-text", 1.0): 1, (3, "MIT", 1.0): 40, (4, "MIT", 1.0): 4}


def test_swapped_identity_terms_score_alike(spark, odd, empty):
    rows = [(i, f"the {'muslims' if i % 3 else 'christians'} are {'scum' if i % 2 and i % 3 else 'here'} today {i}") for i in range(300)]
    labels = spark.createDataFrame([(i, int("scum" in t)) for i, t in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    probe = spark.createDataFrame([(1, "the muslims are here"), (2, "the christians are here"), (3, "such scum"), (4, None)], "doc_id long, text string")
    gap = {}
    for fairness in (0.0, 5.0):
        model = toxicity.fit_toxicity(docs, labels, F.lit(True), fairness=fairness)
        score = {r.doc_id: r.score for r in toxicity.score_toxicity(probe, model).collect()}
        gap[fairness] = abs(score[1] - score[2])
        assert score[3] > 0.5 > score[1] and 0 <= score[4] <= 1
    assert gap[5.0] <= gap[0.0] and gap[5.0] < 0.05
    assert toxicity.score_toxicity(odd, model).count() == len(ODD) and toxicity.score_toxicity(empty, model).count() == 0
    blank = toxicity.fit_toxicity(docs, labels.where("false"), F.lit(True))
    assert {r.score for r in toxicity.score_toxicity(probe, blank).collect()} == {0.5}


def test_held_out_toxic_words_are_caught(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in queries.table(spark, folder, "labels").collect()}
    words = re.compile(r"\b(idiot|stupid|moron|trash|scum|loser|pathetic|worthless|clown|disgusting)\b")
    texts = {r.doc_id: r.text for r in queries.table(spark, folder, "documents").collect()}
    held = [r for r in queries.toxicity_scores(spark, folder).collect() if r.held_out and r.doc_id in labels]
    plain = [r for r in held if labels[r.doc_id] == 1 and words.search(texts[r.doc_id])]
    assert np.mean([r.predicted for r in plain]) > 0.9
    assert np.mean([r.predicted for r in held if labels[r.doc_id] == 0]) < 0.05


def test_site_posteriors_shrink(spark, docs, odd, empty):
    model = sites.fit_quality(docs, queries.table(spark, SF, "labels"))
    found = sites.site_quality(docs, model, F.col("source"), F.col("lang")).toPandas()
    labels = {r.doc_id: r.quality for r in queries.table(spark, SF, "labels").collect()}
    told = found[found.doc_id.isin(list(labels))]
    assert len(found) == docs.count() and (told.kept == told.doc_id.map(labels).astype(bool)).mean() > 0.9
    assert sites.site_quality(odd, model, F.col("source"), F.col("lang")).count() == len(ODD)
    assert sites.site_quality(empty, model, F.col("source"), F.col("lang")).count() == 0


def counts(text):
    w = re.findall(WORD, text or "")
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_rules_match_brute_force(which, request, spark):
    frame = request.getfixturevalue(which)
    good = queries.table(spark, SF, "labels").where("quality = 1").select("doc_id")
    found = rules.quality_rules(frame, good).collect()
    expected = Counter((r.doc_id, *counts(r.text)) for r in frame.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == expected
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def test_every_trusted_text_counts(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("alpha").alias("text"))
    good = docs.where("doc_id < 24000").select(F.col("doc_id").cast("int")).unionByName(spark.createDataFrame([(5,), (None,), (77_777,)], "doc_id int"))
    scores = {round(r.score, 9) for r in rules.quality_rules(docs, good).collect()}
    assert scores == {round(float(np.log(24_001 / (24_000 + 16_384)) - np.log(30_001 / (30_000 + 16_384))), 9)}


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def right(kind, value):
        d = re.sub("[^0-9]", "", value)
        luhn = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in value.split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]

    found = [(m.start(), k, m.end()) for k, p in enumerate(PLAIN.values()) for m in re.finditer(p, text) if right(list(PLAIN)[k], m[0])]
    return ",".join(f"{private.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_base_spans_match_plain_patterns(spark, docs):
    tricky = [
        "a@b.com+x@y.org z@q..com é4111 1111 1111 1111, +1 (377) 555-0271 1.2.3.4.5.6.7.8 300.1.1.1 010.0.0.255",
        "9" * 5000, "1 2 3 4 5 " * 3000, "a" * 4000, "a@" * 3000 + "b.c", "x@" + "a." * 5000 + "z", "+1" + "(" * 3000, None, "", "4111-1111-1111-1111 4111111111111111 5500005555555559",
    ]
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(tricky)], "doc_id long, text string")
    frame = docs.select("doc_id", "text").unionByName(extra)
    texts = {r.doc_id: r.text or "" for r in frame.collect()}
    for r in private.span_digest(private.find_private(frame)).collect():
        base = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), (r.doc_id, base, r.spans)
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_private_spans_of_odd_rows(odd, empty):
    assert private.find_private(odd).count() == len(ODD) and private.find_private(empty).count() == 0


@pytest.mark.parametrize("rate", [0.03, 0.5, 1.0])
def test_planted_wide_forms_are_added(spark, rate):
    wide = ["name{} (at) host dot com", "jo{}@mail (dot) org", "10 . 20 . {} . 7", "2001:db8:0:1:2:3:4:{}", "4111.1111/1111.1111", "(377) 555-02{:02}", "001 377 555 02{:02}"]
    base = ["n{}@host.com", "10.20.{}.7", "4111 1111 1111 1111", "+1 (377) 555-02{:02}"]
    rows, planted = [], {}
    for i in range(400):
        hit = i % 100 < 100 * rate
        form = (wide[i % 100 % 7] if hit else base[i % 4]).format(i % 90)
        rows.append((i, f"we wrote to {form} today, order 1700000{i:03} came @ 3.50 each"))
        planted[i] = (form, hit)
    found = private.span_digest(private.find_private(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    missed = [planted[r.doc_id] for r in found if not any(s.split(":")[1:] == ["12", str(12 + len(planted[r.doc_id][0]))] for s in r.spans.split(",") if s)]
    assert not missed and all(r.n_added == planted[r.doc_id][1] for r in found)


def test_private_spans_do_not_depend_on_layout(spark, docs):
    one, other = (private.span_digest(private.find_private(d.select("doc_id", "text"))) for d in (docs.coalesce(1), docs.repartition(7, "n_chars")))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))


def test_shingles_are_distinct_windows():
    data = np.frombuffer(b"a b c d e f a b c d eshort x", np.uint8)
    sets = shingle_sets(data, np.array([0, 21, 21, 28]), 5)
    assert [len(s) for s in sets] == [6, 0, 1]


def test_pipeline_keeps_what_brute_force_keeps(spark, docs, texts):
    frame, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:3]:
        frame = spark.createDataFrame(stage(spark, frame, SF).toPandas(), frame.schema)
        seen.append({r.doc_id for r in frame.select("doc_id").collect()})
    words = {i for i, t in texts.items() if re.search("[A-Za-z]", t or "")}
    assert seen[0] == words
    last = {}
    for i in sorted(seen[0]):
        last[lower(texts[i])] = i
    assert seen[1] == set(last.values())
    parts = components(word_sets({i: texts[i] for i in seen[1]}))
    assert seen[2] == {i for i, c in parts.items() if c == i}
    assert {"doc_id", "start", "sequence_id"} <= set(corpus_pipeline.run(spark, SF).columns)


def test_pipeline_takes_odd_rows(spark, odd, empty):
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for start in (plain, plain.where("false")):
        frame = start
        for name, stage in corpus_pipeline.STAGES:
            frame = spark.createDataFrame(out.collect(), out.schema) if (out := stage(spark, frame, SF)) is not None else frame
        assert isinstance(frame.schema, T.StructType)


def test_filters_tell_ids_apart(spark, monkeypatch):
    """With few bits most ids collide; the parts stay disjoint, whole and right."""
    monkeypatch.setattr(shared, "BITMAPS", 1)
    monkeypatch.setattr(shared, "BITS", 1024)
    rows = [(i, str(i)) for i in range(3000)] + [(7, "again"), (None, "none")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids = spark.createDataFrame([(i,) for i in range(0, 3000, 9)], "doc_id long")
    outside, inside, unsure = ([tuple(r) for r in part.collect()] for part in shared.told_by_filters(frame, ids, "doc_id"))
    assert Counter(outside + inside + unsure) == Counter(rows)
    assert inside and all(i is not None and i % 9 == 0 for i, _ in inside)
    assert outside and all(i is None or i % 9 for i, _ in outside)
    trusted = {r.doc_id: r.trusted for r in rules.with_trust(frame, ids).collect()}
    assert trusted == {i: i is not None and i % 9 == 0 for i, _ in rows}
    assert rules.with_trust(frame, ids.where("false")).where("trusted").count() == 0


def test_pipeline_hands_texts_to_python_by_bytes(spark, monkeypatch):
    """A batch that is too large ends the stage; 40 texts are over 1 MB, one batch by the number of rows."""
    monkeypatch.setattr(shared, "BATCH_BYTES", 1 << 18)
    most = 2 * shared.BATCH_BYTES

    def watched(run):
        def checked(batches):
            def small():
                for batch in batches:
                    assert batch.nbytes <= most, f"a batch of {batch.nbytes} bytes"
                    yield batch

            return run(small())

        return checked

    for module, name in ((language, "_likelihoods"), (neardup, "_features"), (packing, "_pack")):
        monkeypatch.setattr(module, name, lambda *a, make=getattr(module, name): watched(make(*a)))
    monkeypatch.setattr(exact, "_digests", watched(exact._digests))
    words = "the a of and to in is it on as with for that was by".split()
    rows = [(i, " ".join(f"{words[(i * j) % 15]} w{i}x{j}" for j in range(3400)), "en", "web") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)
    for name, stage in corpus_pipeline.STAGES:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        assert stage(spark, docs, SF).count() >= 40, name
