"""Quality rules: fixed counts and a hashed n-gram log-likelihood ratio against a trusted corpus; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tradewind.llm.shared import stored, text_or_empty, told_by_filters

WORD = r"[^\x20\x09-\x0D]+"


def neighbours(words: Column) -> Column:
    """Hashes of all pairs of neighbours. No lambda refers to `words`: were it inlined there, it would be split again for each word."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b))


def word_windows(words: Column) -> Column:
    """Hashes of all windows of three words."""
    n = F.greatest(F.size(words) - 2, F.lit(0))
    return F.zip_with(F.slice(neighbours(words), 1, n), F.slice(words, 3, n), lambda pair, w: F.xxhash64(pair, w))


def covered(windows: Column) -> Column:
    """How many words the windows that occur twice or more cover."""
    placed = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def twice(placed: Column) -> Column:
        same = lambda e, i: F.coalesce(F.get(placed, i)["x"] == e["x"], F.lit(False))
        return F.filter(placed, lambda e, i: same(e, i - 1) | same(e, i + 1))

    # a one-element array holds the sorted windows, so that they are sorted once
    found = F.flatten(F.transform(F.array(placed), lambda p: F.array_sort(F.transform(twice(p), lambda e: e["i"]))))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"))
    return F.aggregate(found, start, step, lambda a: a["n"])


def grams(words: Column, buckets: int) -> Column:
    """Buckets of all single words and pairs of neighbours, in two bytes each where that is enough."""
    kind = "smallint" if buckets <= 1 << 15 else "int"
    single = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast(kind))
    pairs = F.transform(neighbours(words), lambda h: F.pmod(h, F.lit(buckets)).cast(kind))
    return F.concat(single, pairs)


def with_trust(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """`docs` with `trusted`: whether the id is among `trusted_ids` (one column, distinct). Few rows are shuffled."""
    outside, inside, unsure = told_by_filters(docs, trusted_ids, "doc_id")
    joined = unsure.join(trusted_ids.withColumn("trusted", F.lit(True)), "doc_id", "left")
    told = outside.withColumn("trusted", F.lit(False)).unionByName(inside.withColumn("trusted", F.lit(True)))
    return told.unionByName(joined.withColumn("trusted", F.coalesce("trusted", F.lit(False))))


def ratio_weights(spread: DataFrame, buckets: int, alpha: float) -> DataFrame:
    """One row `weights`: per bucket log P(trusted) - log P(raw), from all n-grams of all rows; a table of fixed size."""
    listed = spread.select("trusted", F.explode("grams").alias("bucket"))
    both = stored(listed.groupBy(F.col("bucket").cast("int").alias("bucket")).agg(F.count("*").alias("raw"), F.count_if("trusted").alias("good")), "gram_counts")
    filled = F.broadcast(both)  # one row a bucket at most
    every = spread.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(filled, "bucket", "left")
    raw, good = (F.coalesce(c, F.lit(0)) for c in ("raw", "good"))
    sums = both.agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).first()
    n_raw, n_good = (float(sums[c] or 0) + alpha * buckets for c in ("raw", "good"))
    weight = F.log((good + alpha) / n_good) - F.log((raw + alpha) / n_raw)
    if not sums["good"]:
        weight = F.lit(0.0)
    listed = every.select(F.struct("bucket", weight.alias("weight")).alias("w")).agg(F.array_sort(F.collect_list("w")).alias("w"))
    return stored(listed.select(F.col("w.weight").alias("weights")), "gram_weights")


def quality_rules(
    docs: DataFrame,
    trusted_ids: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = 1 << 14,
    alpha: float = 1.0,
    least: float = -0.15,
) -> DataFrame:
    """Counts of each whole text, two fixed rules and the verdict of a likelihood ratio.

    `trusted_ids` has one column of ids; the documents of all of them make the trusted target. Single words and pairs of neighbours are hashed to `buckets`; the target's and the raw corpus's multinomials are
    smoothed by `alpha`. A text's score is the mean log ratio of its n-grams, 0 without any. Kept: neither rule fails
    (fewer than 50 words; more than half of the words in repeated windows) and the score is `least` or more.

    A text is read and split once: its counts and the buckets of its n-grams are stored, and both the multinomials and the
    scores come from that table. Only ids and buckets meet the trusted ids, never texts.

    Null texts are empty: no words, not kept. Without a trusted text every score is 0. Repeated rows are judged each by
    itself; other columns are not read; an empty table gives no rows.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    split = named.select("doc_id", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    trusted = trusted_ids.toDF("doc_id").select(F.col("doc_id").cast(named.schema["doc_id"].dataType)).where("doc_id is not null").distinct()
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = split.select(
        "doc_id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        word_windows(F.col("words")).alias("windows"),
    ).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) == F.size("windows"), 0).otherwise(covered(F.col("windows"))).cast("long").alias("n_repeat_words"),
        grams(F.col("words"), buckets).alias("grams"),
    )
    counted = stored(counted, "counts")
    spread = with_trust(counted.select("doc_id", "grams"), stored(trusted, "trusted_ids"))
    weights = ratio_weights(spread, buckets, alpha).scalar()
    total = F.aggregate("grams", F.lit(0.0), lambda a, g: a + F.get("weights", g))
    mean = F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(0.0)
    scored = counted.withColumn("weights", weights).withColumn("score", mean).drop("grams", "weights")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least))
