"""Mixing sources to target weights: Sainte-Lague quotas of equal blocks, then a seeded choice of blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tradewind.functions.ranking import order_statistics
from tradewind.llm.shared import settled, stored

WORD = r"[^\x20\x09-\x0D]+"


def seeded(*parts) -> Column:
    """60 bits of the MD5 of the parts, as a long; any engine can repeat it."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """Adds `nr`, the place of each row in `order` from 1 on. Rows are sorted in ranges; only the sizes of ranges meet."""
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    laid = stored(laid, "ordered").withColumns({"_range": F.shiftright("_id", 33), "_place": F.expr("_id & 8589934591")})
    sizes = laid.groupBy("_range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_range", before.alias("_before"))  # a row per range
    return laid.join(F.broadcast(sizes), "_range").withColumn("nr", F.col("_before") + F.col("_place") + 1).drop("_id", "_range", "_place", "_before")


def water_level(sources: DataFrame, goal: float, steps: int = 32) -> float:
    """The level at which least(limit, weight * level) adds up to `goal`; infinite if even the limits do not.

    A source is full at limit / weight. The level lies between two such points, which are narrowed by `steps` points at a
    time: two aggregations over the sources for each narrowing, and `steps` numbers on the driver.
    """
    low, high = 0.0, float("inf")
    while True:
        inside = sources.where((F.col("full_at") > low) & (F.col("full_at") < high))
        points = inside.agg(F.percentile_approx("full_at", [(i + 1) / steps for i in range(steps)], 10_000)).first()[0]
        if not points:
            full = F.col("full_at") <= low
            row = sources.agg(F.sum(F.when(full, F.col("limit"))), F.sum(F.when(~full, F.col("weight")))).first()
            return (goal - (row[0] or 0)) / row[1] if row[1] else float("inf")
        points = sorted(set(points))
        held = sources.agg(*[F.sum(F.least(F.col("limit").cast("double"), F.col("weight") * p)) for p in points]).first()
        low = max([p for p, h in zip(points, held) if h < goal], default=low)
        high = min([p for p, h in zip(points, held) if h >= goal], default=high)


def source_targets(sources: DataFrame, weights: tuple[int, ...], part: int, whole: int, cap: int) -> DataFrame:
    """Adds `weight`, `limit`, `target` to one row per source (`source`, `source_size`).

    Weights repeat over the sources in code-point order, null last. Targets share `part`/`whole` of all sizes by weight;
    none exceeds `cap` times its size, and what that cuts off is shared by weight among the others until nothing is
    above: target = least(limit, weight * level), with the one level at which the targets add up.
    """
    ordered = numbered(sources, F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.expr(f"cast((nr - 1) % {len(weights)} + 1 as int)"))
    listed = ordered.withColumns({"weight": weight, "limit": F.col("source_size") * cap}).drop("nr")
    listed = stored(listed.withColumn("full_at", F.col("limit") / F.col("weight")), "weighted")
    size = listed.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(listed, size * (part / whole))
    return listed.withColumn("target", F.least(F.col("limit").cast("double"), F.col("weight") * F.lit(level))).drop("full_at")


def highest(rows: DataFrame, order: Column, amount: str, wanted: int) -> DataFrame:
    """Adds `got`: the first rows by `order` get their whole `amount`, one the rest of `wanted`, the others nothing.

    The row at which the amounts reach `wanted` is selected by narrowing ranges, so nothing is sorted as a whole.
    """
    keyed = stored(rows.withColumns({"_key": order, "_all": F.lit("all")}), "ranked")
    if wanted <= 0:
        return keyed.withColumn("got", F.lit(0).cast("long")).drop("_key", "_all")
    values = keyed.where(F.col(amount) > 0)
    last = order_statistics(values, {"last": F.least(F.lit(wanted), F.col("n"))}, "_all", "_key", amount)
    keyed = keyed.withColumn("_last", stored(last, "last").select("_key").scalar())  # null if there is no amount
    first = F.col("_key") < F.col("_last")
    given = F.coalesce(keyed.agg(F.sum(F.when(first, F.col(amount)))).scalar(), F.lit(0))
    got = F.when(first, F.col(amount)).when(F.col("_key") == F.col("_last"), F.least(F.col(amount), F.lit(wanted) - given)).otherwise(0)
    return keyed.withColumn("got", got.cast("long")).drop("_key", "_all", "_last")


def source_words(sources: DataFrame, block: int) -> DataFrame:
    """Adds `words`: what each source gives to the mix, in all the rounded sum of the targets.

    A source whose target is its limit gives exactly that. The others get blocks by highest quotients target / 1, 3, 5, ...; the
    last block of a source may be cut by its limit. Words left over by that go to those that are furthest below their
    target, as far as they have room.
    """
    full = F.col("target") >= F.col("limit")
    sums = sources.agg(
        F.sum("target"), F.sum(F.when(full, F.col("limit"))), F.sum(F.when(~full, F.col("target"))), F.count_if(~full)
    ).first()
    rest_words = math.floor((sums[0] or 0.0) + 0.5) - (sums[1] or 0)
    seats, votes, half = rest_words // block, sums[2] or 0.0, (sums[3] or 0) / 2
    # a divisor a little too large gives each source a first share that it holds in any case
    share = F.col("target") / votes if votes else F.lit(0.0)
    base = F.floor(F.lit(max(seats - half, 0.0)) * share + 0.5).cast("long")
    rest = sources.where(~full).withColumn("base", base)
    rest = rest.withColumn("upper", F.greatest(F.floor(F.lit(seats + half) * share + 0.5).cast("long") + 1, F.col("base") + 1))
    left = seats - (rest.agg(F.sum("base")).first()[0] or 0)
    quotients = rest.where("target > 0").select("key", "target", F.explode(F.expr("sequence(base + 1, upper)")).alias("nth"))
    order = F.struct((-F.col("target") / (F.col("nth") * 2 - 1)).alias("quotient"), F.col("key"), F.col("nth"))
    won = highest(quotients.withColumn("one", F.lit(1).cast("long")), order, "one", left)
    won = won.groupBy("key").agg(F.sum("got").alias("more"))
    blocks = (F.col("base") + F.coalesce("more", F.lit(0))) * block
    rest = stored(rest.join(won, "key", "left").withColumn("words", F.least(blocks, F.col("limit"))).drop("base", "upper", "more"), "blocks")
    left = rest_words - (rest.agg(F.sum("words")).first()[0] or 0)
    below = F.struct((F.col("words") - F.col("target")).alias("below"), F.col("key"))
    topped = highest(rest.withColumn("room", F.col("limit") - F.col("words")), below, "room", left)
    topped = topped.withColumn("words", F.col("words") + F.col("got")).drop("room", "got")
    return sources.where(full).withColumn("words", F.col("limit")).unionByName(topped)


def sainte_lague(parties: DataFrame, group: list[str], party: list[str], votes: str, seats: str) -> DataFrame:
    """Adds `quota`: the `seats` of each group go to its parties by the highest quotients votes / 1, 3, 5, ...

    A divisor a little too large gives each party a first share that it holds in any case; of the quotients that follow,
    at most about three a party, the highest take what is left. Ties go by the party's own columns.
    """
    all_of = W.partitionBy(*group)
    half = F.count("*").over(all_of) / 2
    total = F.sum(F.col(votes).cast("double")).over(all_of)
    share = F.when(total > 0, F.col(votes) / total).otherwise(0.0)
    based = (
        parties.withColumn("base", F.floor(F.greatest(F.col(seats) - half, F.lit(0.0)) * share + 0.5).cast("long"))
        .withColumn("base", F.when(F.col(seats) > half, F.col("base")).otherwise(0))
        .withColumn("upper", F.floor((F.col(seats) + half) * share + 0.5).cast("long") + 1)
    ).withColumn("left", F.col(seats) - F.sum("base").over(all_of))
    quotients = based.where(F.col(votes) > 0).withColumn("nth", F.explode(F.expr("sequence(base + 1, greatest(upper, base + 1))")))
    rank = F.row_number().over(all_of.orderBy((F.col(votes) / (F.col("nth") * 2 - 1)).desc(), *party))
    won = quotients.withColumn("rank", rank).where("rank <= left").groupBy(*group, *party).agg(F.count("*").alias("more"))
    return (
        based.join(won, [*group, *party], "left")
        .withColumn("quota", F.col("base") + F.coalesce("more", F.lit(0)))
        .drop("base", "upper", "left", "more")
    )


def shard_words_of(shards: DataFrame, block: int, cap: int) -> DataFrame:
    """Adds `length`: the words that each shard (`key`, `shard`, `shard_size`) gives of its source's `words`, exactly those in all.

    Blocks go to the shards by highest quotients; one cut by its limit, `cap` times its size, and the words beyond the last
    whole block go on to the shards furthest below their share.
    """
    own = W.partitionBy("key")
    limit = F.col("shard_size") * cap
    seated = sainte_lague(shards.withColumn("seats", F.expr(f"words div {block}")), ["key"], ["shard"], "shard_size", "seats")
    part = seated.withColumns({"limit": limit, "part": F.least(F.col("quota") * block, limit)})
    part = part.withColumn("left", F.col("words") - F.sum("part").over(own)).withColumn("room", F.col("limit") - F.col("part"))
    fair = F.col("words") * F.try_divide(F.col("shard_size"), F.sum("shard_size").over(own))
    order = own.orderBy(F.col("part") - fair, "shard").rowsBetween(W.unboundedPreceding, -1)
    more = F.greatest(F.lit(0), F.least("room", F.col("left") - F.coalesce(F.sum("room").over(order), F.lit(0))))
    return part.withColumn("length", F.col("part") + more).drop("seats", "quota", "limit", "part", "left", "room")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    part: int = 150,
    whole: int = 100,
    cap: int = 2,
    block_words: int = 16,
    shard_words: int = 1_000_000,
    shard_rows: int = 20_000,
    seed: int = 17,
) -> DataFrame:
    """How many of its words each document gives to a mix of sources with target weights; DataFrame functions only.

    A document's size is its number of words `[^\\x20\\x09-\\x0D]+`, none for a null or empty text. The targets of
    `source_targets` are counted in blocks of `block_words`; the blocks go to the sources, and those of a source to its
    shards, by highest quotients. A source or shard at its limit gives exactly that, its last block cut, and what the cut
    leaves goes to others. A source is dealt by a hash of the id into shards of about `shard_words` words or
    `shard_rows` rows, so a source with a third of all rows is many shards. In a shard the documents lie on a ring in an
    order given by the seed; the shard's blocks are taken one after the other from a block chosen by the seed, round the
    ring as often as the quota asks, at most `cap` times. So `taken` is at most `cap` times the size, the words of all
    sources add up to the rounded sum of their targets, those of each differ from its target by a block or two, and every
    run gives the same. Nothing is ranked over all sources or documents in one task.

    A null source is a source of its own. Repeated rows count each by itself. A table without words takes nothing; an
    empty table gives no rows. Other columns are not read.
    """
    sizes = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
    ).withColumn("key", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))))
    sizes = stored(sizes, "sizes")
    sources = sizes.groupBy("key").agg(
        F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n_rows")
    )
    targets = source_words(stored(source_targets(stored(sources, "sources"), weights, part, whole, cap), "source_targets"), block_words)
    targets = targets.select(
        "key",
        "source_size",
        "target",
        "words",
        F.greatest(
            F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("n_rows") / shard_rows), F.lit(1)
        ).cast("long").alias("shards"),
    )
    targets = stored(targets, "targets")
    dealt = sizes.join(targets.select("key", "shards"), "key").withColumns(
        {"shard": F.pmod(seeded(seed, F.col("doc_id")), F.col("shards")), "place": seeded(seed + 1, F.col("doc_id"))}
    )
    shards = dealt.groupBy("key", "shard").agg(F.sum("size").alias("shard_size")).join(targets.select("key", "words"), "key")
    blocks = F.greatest(F.ceil(F.col("shard_size") / block_words), F.lit(1)).cast("long")
    shards = shard_words_of(shards, block_words, cap).select(
        "key",
        "shard",
        "shard_size",
        (F.pmod(seeded(seed + 2, F.col("key"), F.col("shard")), blocks) * block_words).alias("begin"),
        "length",
    )
    shards = stored(shards, "shards")
    ring = W.partitionBy("key", "shard").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    laid = dealt.withColumn("at", F.sum("size").over(ring) - F.col("size")).join(shards, ["key", "shard"])
    end = F.col("begin") + F.col("length")
    rounds = []
    for lap in range(cap + 1):
        low = F.col("at") + F.col("shard_size") * lap
        rounds.append(F.greatest(F.lit(0), F.least(end, low + F.col("size")) - F.greatest(F.col("begin"), low)))
    taken = sum(rounds[1:], rounds[0]).cast("long").alias("taken")
    return laid.select("doc_id", "size", "key", "shard", taken).join(targets.select("key", "source_size", "target"), "key").select(
        "doc_id", "size", "source_size", "target", "taken", F.when(F.col("key") != "n", F.expr("substring(key, 2)")).alias("source"), "shard"
    )


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus with the columns of `docs`: a document stands in it as often as the mix takes its words, in whole
    documents, rounded half up, so one cut by the end of the chosen blocks is in or out as a whole."""

    def copies() -> DataFrame:
        taken = mix_sources(docs, id_col, text_col, source_col, **options)
        times = F.max(F.expr("cast(floor(taken / size + 0.5) as int)"))
        return taken.where("size > 0").groupBy(F.col("doc_id").alias("id")).agg(times.alias("n")).where("n > 0")

    # the columns of `docs` stand in a struct, so none of their names can clash
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    mixed = whole.join(settled(docs.sparkSession, copies, "copies"), F.col(f"doc.`{id_col}`").eqNullSafe(F.col("id")))
    return mixed.select("doc", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).select("doc.*")
