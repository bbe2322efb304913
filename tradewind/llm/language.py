"""Language identification: text likelihoods fused with declared language, address suffix and host priors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tradewind.llm.shared import settled, stored, without_ids
from tradewind.llm.words import LOWER, text_chunks

_B = np.arange(256)
#: ASCII that is no letter counts as a gap; every byte of other characters counts as itself.
LETTER = np.where((_B < 128) & ~((LOWER >= 97) & (LOWER <= 122)), 32, LOWER).astype(np.uint32)


@dataclass(frozen=True)
class LanguageModel:
    """Log-probabilities of hashed byte trigrams, (buckets, languages)."""

    languages: tuple[str, ...]
    logp: np.ndarray


def trigrams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram that has a letter, and its row."""
    c = LETTER[data]
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
    inside = (code != 0x202020)
    ends = offsets[1:-1]
    for back in (1, 2):
        at = ends - back
        inside[at[(at >= 0) & (at < len(inside))]] = False
    place = np.flatnonzero(inside)
    code = code[place] * np.uint32(2654435761)
    return (code >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int64), np.searchsorted(offsets, place, "right") - 1


def fit_language_model(
    labelled: DataFrame, text_col: str, lang_col: str, id_col: str, max_rows: int = 8192, buckets: int = 1 << 15, alpha: float = 0.05, least_rows: int = 64
) -> LanguageModel:
    """A model of every label, from whole texts of about `max_rows` labelled rows, an equal part of them for each label.

    A label has `least_rows` in any case, or all its rows if they are fewer. Of the others' rows those are taken whose
    id and text hash below the wanted share, so no row is sorted. Trigrams are counted where the rows are; what reaches
    the driver is one number per language and bucket at most.
    """
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    rows = usable.select(F.col(id_col).alias("pick"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sizes = stored(rows.groupBy("lang").agg(F.count("*").alias("rows")), "labelled_rows")
    quota = max(max_rows // max(sizes.count(), 1), least_rows)
    wanted = sizes.select("lang", (F.lit(float(quota)) / F.col("rows")).alias("share"))
    place = F.pmod(F.xxhash64("pick", "text", F.lit(7)), F.lit(1 << 31)) / float(1 << 31)
    rows = rows.join(F.broadcast(wanted), "lang").where(place < F.col("share")).select("lang", "text")  # one row a label

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for at, data, offsets in text_chunks(batch.column("text")):
                bucket, row = trigrams(data, offsets, buckets)
                here = langs[at : at + len(offsets) - 1]
                for lang in set(here):
                    n = np.bincount(bucket[(here == lang)[row]], minlength=buckets)
                    sums[lang] = sums.get(lang, 0) + n
        for lang, n in sums.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(n[used], pa.int64())], names=["lang", "bucket", "n"]
            )

    counts = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(counts["lang"].unique()))
    table = np.zeros((buckets, len(languages)))
    for i, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        table[own["bucket"].to_numpy(np.int64), i] = own["n"]
    logp = np.log((table + alpha) / (table.sum(0) + alpha * buckets)) if len(languages) else table
    return LanguageModel(languages, logp.astype(np.float32))


def _likelihoods(model: LanguageModel, evidence: float, unknown: float, novel: float):
    """Per row its number of trigrams, the chance that it is in any language of the model, and the posterior of the text
    alone among these, for even priors."""
    buckets, width = model.logp.shape
    # against a text of no known language, in which any bucket is as likely as any other
    against = np.logaddexp(model.logp + np.log(buckets) + np.log1p(-novel), np.log(novel)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in text_chunks(batch.column("text__"), 1 << 19):
                n = len(offsets) - 1
                bucket, row = trigrams(data, offsets, buckets)
                grams = np.bincount(row, minlength=n)
                sums = np.stack([np.bincount(row, model.logp[bucket, i], n) for i in range(width)], 1).astype(float)
                weigh = np.minimum(1.0, evidence / np.maximum(grams, 1))
                sums *= weigh[:, None]
                sums -= sums.max(1, keepdims=True)
                parts = np.exp(sums)
                parts /= parts.sum(1, keepdims=True)
                odds = np.stack([np.bincount(row, against[bucket, i], n) for i in range(width)], 1) * weigh[:, None]
                odds = np.logaddexp.reduce(odds, axis=1) - np.log(width)
                known = 1.0 / (1.0 + unknown / (1.0 - unknown) * np.exp(-np.clip(odds, -500.0, 500.0)))
                rest = [batch.column(i).slice(at, n) for i in range(batch.num_columns) if batch.schema.names[i] != "text__"]
                names = [c for c in batch.schema.names if c != "text__"]
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array(grams, pa.int64()), pa.array(known), *[pa.array(parts[:, i]) for i in range(width)]],
                    names=[*names, "n_grams", "known__", *[f"q{i}" for i in range(width)]],
                )

    return run


def identify_language(
    docs: DataFrame,
    model: LanguageModel,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared: Column | None = None,
    suffix: Column | None = None,
    hosts: tuple[Column, ...] = (),
    evidence: float = 60.0,
    declared_strength: float = 5.0,
    prior_strength: float = 20.0,
    least: float = 0.5,
    unknown: float = 0.001,
    novel: float = 0.2,
) -> DataFrame:
    """Language of each row, with its probability, from four kinds of evidence.

    Text: hashed byte trigrams under `model`, counted as at most `evidence` independent ones. `declared` (markup
    language), `suffix` (of the address) and `hosts` (coarse to fine) are columns; each is optional, and null in a row
    says nothing there. What a value v says about language l is how often rows with v have l by their text,
    (n(v, l) - own + strength * parent(l)) / (n(v) - 1 + strength), without the row itself and smoothed towards its
    parent: the whole table for declared language and suffix, the next coarser level for a host. All these are grouped
    sums over all rows. The log ratios to the parents are added to the log-likelihoods and the table's own prior.

    Beside the model's languages stands an unknown one, in which all buckets are as likely, with the prior `unknown`. Against
    it, every language gives a share `novel` of its trigrams to words that were not learned, so new words of a known
    language are no strangers. The chance of the unknown one, from the text alone, is taken off the probability; where it
    is a half or more, the language is null.

    Returns id, language, probability, text_language, n_grams, kept. A row is kept if its probability is `least` or
    more. Null, empty and letterless texts have no text evidence: language null, probability 0, not kept. A model
    without languages rejects nothing else. Repeated rows are judged each by itself; an empty table gives no rows;
    other columns are not read.
    """
    width = len(model.languages)
    none = F.lit(None).cast("string")
    attributes = {"declared__": none if declared is None else declared.cast("string"), "suffix__": none if suffix is None else suffix.cast("string")}
    attributes |= {f"host{i}__": h.cast("string") for i, h in enumerate(hosts)}
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text__"), *[c.alias(n) for n, c in attributes.items()])
    if not width:
        return named.select("doc_id", none.alias("language"), F.lit(0.0).alias("probability"), none.alias("text_language"), F.lit(0).cast("long").alias("n_grams"), F.lit(True).alias("kept"))
    kept_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema if f.name != "text__")
    q = [f"q{i}" for i in range(width)]
    scored = named.mapInArrow(_likelihoods(model, evidence, unknown, novel), f"{kept_types}, n_grams long, known__ double, " + ", ".join(f"{c} double" for c in q))
    scored = stored(scored, "text_scores")
    told = scored.where("n_grams > 0")

    totals = told.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in q]).first()
    world = [((totals[c] or 0.0) + 1.0) / (totals["n"] + width) for c in q]
    out = told
    parents = {n: [F.lit(p) for p in world] for n in ("declared__", "suffix__")}
    strength = {"declared__": declared_strength, "suffix__": prior_strength}
    ratios = [[F.log(F.col(c)) + float(np.log(p)) for c, p in zip(q, world)]]
    before = [F.lit(p) for p in world]
    for name in attributes:
        sums = told.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias(f"{name}n"), *[F.sum(c).alias(f"{name}{c}") for c in q])
        out = out.join(stored(sums, f"by_{name.strip('_')}"), name, "left")
        parent = parents.get(name, before)
        k = strength.get(name, prior_strength)
        smooth = [
            F.when(F.col(f"{name}n").isNull(), p).otherwise(
                (F.greatest(F.col(f"{name}{c}") - F.col(c), F.lit(0.0)) + k * p) / (F.col(f"{name}n") - 1 + k)
            )
            for c, p in zip(q, parent)
        ]
        ratios.append([F.log(s / p) for s, p in zip(smooth, parent)])
        if name.startswith("host"):
            out = out.withColumns({f"p{name}{i}": s for i, s in enumerate(smooth)})
            ratios[-1] = [F.log(F.col(f"p{name}{i}") / p) for i, p in enumerate(parent)]
            before = [F.col(f"p{name}{i}") for i in range(width)]
    logs = [sum(parts[1:], parts[0]) for parts in zip(*ratios)]
    out = out.withColumns({f"l{i}": x for i, x in enumerate(logs)})
    top = F.greatest(*[F.col(f"l{i}") for i in range(width)], F.lit(-1e300))
    norm = sum([F.exp(F.col(f"l{i}") - F.col("top")) for i in range(width)], F.lit(0.0))
    pick = lambda columns, best: F.coalesce(*[F.when(F.col(c) == best, F.lit(name)) for c, name in zip(columns, model.languages)])
    judged = out.withColumn("top", top).select(
        "doc_id",
        F.when(F.col("known__") > 0.5, pick([f"l{i}" for i in range(width)], F.col("top"))).alias("language"),
        (F.col("known__") / norm).alias("probability"),
        pick(q, F.greatest(*q, F.lit(-1.0))).alias("text_language"),
        "n_grams",
    )
    blank = scored.where("n_grams = 0").select("doc_id", none.alias("language"), F.lit(0.0).alias("probability"), none.alias("text_language"), "n_grams")
    return judged.unionByName(blank).withColumn("kept", F.col("probability") >= least)


def drop_unidentified(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents whose language is settled, with all their columns; rows without an id stay."""

    def rejected() -> DataFrame:
        decided = identify_language(docs, model, id_col, **options)
        fate = decided.where("doc_id is not null").groupBy(F.col("doc_id").alias(id_col)).agg(F.max("kept").alias("kept"))
        return fate.where("not kept").select(id_col)

    return without_ids(docs, settled(docs.sparkSession, rejected, "rejected"), id_col)
