"""Toxicity scores from a word classifier that is held to equal answers when identity terms are swapped."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tradewind.llm.logistic import fit_sparse, sigmoid
from tradewind.llm.language import LETTER
from tradewind.llm.shared import stored
from tradewind.llm.words import text_chunks, word_hashes

#: Terms for groups of people, swapped within their set.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "natives", "refugees"), ("disabled", "deaf", "blind"), ("old", "young", "elderly"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)


TERMS = tuple(t for terms in IDENTITY_TERMS for t in terms)


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of the hashed words, then one of each identity term."""

    weights: np.ndarray
    intercept: float
    buckets: int


def _words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of the words, where each row's begin); a word is a run of letters, A-Z lower-cased."""
    for at, data, offsets in text_chunks(texts):
        yield at, *word_hashes(LETTER[data].astype(np.uint8), offsets)


def _columns(words: np.ndarray, buckets: int) -> np.ndarray:
    """The column of each word: an identity term has one of its own, all other words share `buckets` by their hash."""
    terms = next(_words(pa.array([" ".join(TERMS)])))[1]
    order = np.argsort(terms)
    at = np.minimum(np.searchsorted(terms[order], words), len(terms) - 1)
    own = terms[order][at] == words
    return np.where(own, buckets + order[at], (words % np.uint64(buckets)).astype(np.int64))


def swaps(sets: list[np.ndarray], buckets: int) -> dict[tuple[int, int], int]:
    """How many texts change from term `a` to `b` when each identity term is swapped for each other one of its set.

    `sets` has the columns of each text. Where the other term stands in the text already, the swap takes `a` away: (a, -1).
    """
    group_of = {buckets + TERMS.index(t): [buckets + TERMS.index(o) for o in terms if o != t] for terms in IDENTITY_TERMS for t in terms}
    changes: dict[tuple[int, int], int] = {}
    for columns in sets:
        held = set(columns[columns >= buckets].tolist())
        for a in held:
            for b in group_of[a]:
                change = (a, -1) if b in held else (a, b)
                changes[change] = changes.get(change, 0) + 1
    return changes


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = 20_000,
    buckets: int = 1 << 18,
    features: int = 4096,
    l2: float = 2e-5,
    fairness: float = 1.0,
) -> ToxicityModel:
    """A model from at most `max_rows` labelled rows (ids that hash lowest, whole texts) for which `usable` holds.

    Features are the words a text has: identity terms, each in a column of its own, and other words, hashed. Of these at most
    `features` are kept, those least likely to differ between the labels by chance; they are counted and picked in Spark, and only
    they reach the driver, for `max_rows` texts at most. Each labelled text with an identity term is also read with the term swapped
    for every other of its set; the squared change of the log-odds, `fairness` times, is added to the loss, as a mean over the
    texts. Terms of a set that no text mentions are held together by an even small share, so their weights stay together
    too. An id with several labels counts as toxic if one of them says so. Rows without label, id or text are not used;
    without any label the score is 0.5 throughout.
    """
    told = labels.where(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    told = told.groupBy(F.col(id_col).alias("id__")).agg(F.max(label_col).cast("double").alias("label__"))
    told = told.orderBy(F.xxhash64("id__", F.lit(23)), "id__").limit(max_rows)
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id__"), F.col(text_col).cast("string").alias("text__"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, words, starts in _words(batch.column("text__")):
                columns = _columns(words, buckets)
                sets = [np.unique(columns[a:b]) for a, b in zip(starts[:-1], starts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id__").slice(at, len(sets)).cast(pa.string()), batch.column("label__").slice(at, len(sets)), pa.array(sets, pa.list_(pa.int64()))],
                    names=["id", "label", "words"],
                )

    sample = rows.join(F.broadcast(told), "id__").mapInArrow(extract, "id string, label double, words array<long>")
    sample = stored(sample, "labelled_words")
    size = sample.agg(F.count("*").alias("n"), F.avg("label").alias("share")).first()
    if not size["n"]:
        return ToxicityModel(np.zeros(buckets + len(TERMS), np.float32), 0.0, buckets)
    counted = sample.select("label", F.explode("words").alias("word")).where(F.col("word") < buckets)
    counted = counted.groupBy("word").agg(F.count("*").alias("n"), F.sum("label").alias("n1")).where("n >= 3")
    by_chance = F.sqrt(F.greatest(F.col("n") * float(size["share"] * (1 - size["share"])), F.lit(1e-9)))
    telling = counted.withColumn("z", F.abs(F.col("n1") - F.col("n") * float(size["share"])) / by_chance).where("z > 4")
    best = [r["word"] for r in telling.orderBy(F.col("z").desc(), "word").limit(features).select("word").collect()]
    used = np.sort(np.array(best + [buckets + i for i in range(len(TERMS))], np.int64))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [words[np.isin(words, used)] for words in batch.column("words").to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "label", "words"])

    table = sample.mapInArrow(chosen, sample.schema).orderBy("id", "label", "words").toArrow()
    y = table.column("label").to_numpy()
    lists = table.column("words").combine_chunks()
    columns, bounds = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    place = {int(c): i for i, c in enumerate(used)}
    sets = [columns[a:b] for a, b in zip(bounds[:-1] - bounds[0], bounds[1:] - bounds[0])]
    ties = [(place[a], place.get(b, -1), fairness * n / len(y)) for (a, b), n in sorted(swaps(sets, buckets).items())]
    mentioned = set(columns[columns >= buckets].tolist())
    for terms in IDENTITY_TERMS:
        group = [buckets + TERMS.index(t) for t in terms]
        if not mentioned & set(group):
            ties += [(place[a], place[b], fairness * 1e-3) for i, a in enumerate(group) for b in group[i + 1 :]]
    starts = bounds[:-1] - bounds[0]
    w, b = fit_sparse(np.searchsorted(used, columns), starts, y, len(used), l2, ties)
    weights = np.zeros(buckets + len(TERMS), np.float32)
    weights[used] = w
    return ToxicityModel(weights, float(b), buckets)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): the model's probability for each whole text; a null, empty or wordless text has no word.

    Repeated rows get equal scores; other columns are not read; an empty table gives no rows.
    """
    weights, intercept, buckets = model.weights, model.intercept, model.buckets

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, hashed, starts in _words(batch.column("text")):
                n, words = len(starts) - 1, _columns(hashed, buckets)
                row = np.repeat(np.arange(n), np.diff(starts))
                told = weights[words] != 0
                has = np.unique(row[told] * len(weights) + words[told])
                sums = np.bincount(has // len(weights), weights[has % len(weights)], n)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, n), pa.array(sigmoid(sums + intercept))], names=["doc_id", "score"])

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return named.mapInArrow(score, "doc_id long, score double")
