"""Exact order statistics without sorting everything in one task.

`F.median` and `F.percentile` merge a map of all distinct values in one task, and a rank over an
unpartitioned window sorts all rows in one task. Here values are cut into slices at sampled edges, counting per slice
shows which slice holds a wanted rank, and that slice is cut again until it is small; only then is it sorted. Long
groups are cut into ordered slices in the same way. The edges decide how even the slices are, never what comes out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tradewind.functions.durable import durable
from tradewind.functions.reshape import with_row

#: Most rows of a slice that is sorted in one task, and edges by which a larger one is cut at a time.
SLICE_ROWS = 100_000
EDGES = 256
BLOCK = 16


def edge_columns(keys: Column) -> list[Column]:
    """Sorted edges, and every `BLOCK`-th of them for a two-step search."""
    edges = F.sort_array(keys)
    return [edges.alias("_edges"), F.filter(edges, lambda _, i: (i + 1) % BLOCK == 0).alias("_blocks")]


def slice_of(key: Column) -> Column:
    """Number of edges below `key`: whole blocks first, then the edges of the next block."""
    blocks = F.size(F.filter("_blocks", lambda edge: edge < key))
    inside = F.slice("_edges", blocks * BLOCK + 1, F.lit(BLOCK))
    return blocks * BLOCK + F.size(F.filter(inside, lambda edge: edge < key))


def sampled(seed: Column, rows: Column) -> Column:
    """True for about four times `EDGES` of `rows` rows, by the hash of `seed`: the same rows on every run."""
    return F.pmod(F.xxhash64(seed), F.lit(1 << 30)) / float(1 << 30) * rows < 4 * EDGES


def even_edges(sample: Column, least: Column) -> Column:
    """At most `EDGES` evenly spaced keys of a sample, and the least key, so that a cut always splits off something."""
    keys = F.sort_array(sample)
    step = F.ceil(F.greatest(F.size(keys), F.lit(1)) / (EDGES - 1))
    return F.array_distinct(F.array_append(F.filter(keys, lambda _, i: i % step == 0), least))


def narrow_slices(
    values: DataFrame, ranks: Mapping[str, Column], group: str, key: str, weight: str, target: int
) -> list[dict]:
    """For each wanted rank a key range (low, high] of its group with at most `target` rows or a single key.

    One row per group and label is held on the driver: as many as the arguments ask for. Every level of cutting is two
    aggregations over the ranges that are still too large, whose number of rows falls by about `EDGES` a level.
    """
    wanted = [F.struct(F.lit(label).alias("label"), rank.cast("long").alias("offset")) for label, rank in ranks.items()]
    sizes = values.groupBy(group).agg(F.sum(weight).alias("n"), F.count("*").alias("rows"))
    found = sizes.select(group, "n", "rows", F.inline(F.array(*wanted))).where("offset between 1 and n").collect()
    slices = [{"group": r[group], "label": r.label, "offset": r.offset, "rows": r.rows, "low": None, "high": None} for r in found]
    while True:
        large = {(s["group"], s["low"], s["high"]): s["rows"] for s in slices if s["rows"] > target}
        if not large:
            return slices
        inside = _within(values, [(*k, n) for k, n in large.items()], group, key)
        sample = F.collect_set(F.when(sampled(F.col(key), F.col("_rows")), F.col(key)))
        cuts = inside.groupBy("_nr").agg(F.min(key).alias("_least"), F.max(key).alias("_most"), sample.alias("_keys"))
        cuts = cuts.where("_least < _most").select("_nr", *edge_columns(even_edges(F.col("_keys"), F.col("_least")))).collect()
        edges = {r["_nr"]: list(r["_edges"]) for r in cuts}
        ranges = list(large)
        for nr, one in enumerate(ranges):
            if nr not in edges:  # a single key
                for s in slices:
                    if (s["group"], s["low"], s["high"]) == one:
                        s["rows"] = 1
        if not edges:
            continue
        schema = T.StructType([T.StructField("_nr", T.IntegerType()), T.StructField("_keys", T.ArrayType(values.schema[key].dataType))])
        by_range = values.sparkSession.createDataFrame(list(edges.items()), schema).select("_nr", *edge_columns(F.col("_keys")))
        parts = (
            inside.join(F.broadcast(by_range), "_nr")  # the ranges above with their edges
            .groupBy("_nr", slice_of(F.col(key)).alias("_part"))
            .agg(F.sum(weight).alias("n"), F.count("*").alias("rows"))
            .collect()
        )
        counts = {(r["_nr"], r["_part"]): (r["n"], r["rows"]) for r in parts}
        for s in slices:
            one = (s["group"], s["low"], s["high"])
            nr = ranges.index(one) if one in large else -1
            if nr not in edges:
                continue
            for part in range(len(edges[nr]) + 1):
                n, rows = counts.get((nr, part), (0, 0))
                if s["offset"] <= n:
                    s["rows"] = rows
                    s["low"] = edges[nr][part - 1] if part else s["low"]
                    s["high"] = edges[nr][part] if part < len(edges[nr]) else s["high"]
                    break
                s["offset"] -= n


def _within(values: DataFrame, ranges: Sequence[tuple], group: str, key: str) -> DataFrame:
    """Rows of `values` inside each of the ranges (group, low, high, rows), with the range's number `_nr`."""
    kind = values.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField("_nr", T.IntegerType()),
            T.StructField("_group", values.schema[group].dataType),
            T.StructField("_low", kind),
            T.StructField("_high", kind),
            T.StructField("_rows", T.LongType()),
        ]
    )
    listed = values.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(ranges)], schema)
    held = (F.col("_low").isNull() | (F.col(key) > F.col("_low"))) & (F.col("_high").isNull() | (F.col(key) <= F.col("_high")))
    same = F.col(group).eqNullSafe(F.col("_group")) & held
    return values.join(F.broadcast(listed), same).drop("_group", "_low", "_high")  # a row per wanted rank at most


def order_statistics(
    values: DataFrame,
    ranks: Mapping[str, Column],
    group: str = "series",
    key: str = "key",
    weight: str = "weight",
    target: int = SLICE_ROWS,
) -> DataFrame:
    """The element at each wanted 1-based rank, per group.

    `values` has (group, key, weight), each key of a group once: `key` can be any orderable type, also a struct, and
    `weight` says how often the key counts. `ranks` maps a label to an expression over `n`, the group's total weight.
    Returns (group, label, key); labels with a rank outside 1..n are absent. Groups and labels should be few: `values` is
    read about twice a level of `narrow_slices`, and once more for the slices it finds.
    """
    slices = narrow_slices(values, ranks, group, key, weight, target)
    ranges = list(dict.fromkeys((s["group"], s["low"], s["high"]) for s in slices))
    if not ranges:
        return values.select(group, F.lit("").alias("label"), key).where("false")
    targets = [(ranges.index((s["group"], s["low"], s["high"])), s["label"], s["offset"]) for s in slices]
    targets = values.sparkSession.createDataFrame(targets, "_nr int, label string, _offset long")
    targets = targets.groupBy("_nr").agg(F.collect_list(F.struct("label", "_offset")).alias("_targets"))
    upto = Window.partitionBy("_nr").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return (
        _within(values, [(*r, 0) for r in ranges], group, key)
        .groupBy("_nr", group, key)
        .agg(F.sum(weight).alias("_weight"))  # at most `target` rows a range
        .withColumn("_upto", F.sum("_weight").over(upto))
        .join(F.broadcast(targets), "_nr")
        .select(group, key, "_weight", "_upto", F.inline("_targets"))
        .where((F.col("_offset") <= F.col("_upto")) & (F.col("_offset") > F.col("_upto") - F.col("_weight")))
        .select(group, "label", key)
    )


def percentiles(counts: DataFrame, points: Mapping[str, float], group: str = "series") -> DataFrame:
    """Linearly interpolated percentiles, one row (group, <one column per point>) per group.

    `counts` has (group, value, weight) with one row per distinct value.
    """
    ranks: dict[str, Column] = {}
    for name, p in points.items():
        position = (F.col("n") - 1) * F.lit(float(p))
        ranks[f"{name}|low"] = F.floor(position) + 1
        ranks[f"{name}|high"] = F.ceil(position) + 1
    found = order_statistics(counts.select(group, F.col("value").alias("key"), "weight"), ranks, group)
    sizes = counts.groupBy(group).agg(F.sum("weight").alias("n"))
    by_label = found.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("label", "key"))).alias("at"))

    def interpolate(name: str, p: float) -> Column:
        low, high = F.col("at")[f"{name}|low"], F.col("at")[f"{name}|high"]
        position = (F.col("n") - 1) * F.lit(float(p))
        return (low + (high - low) * (position - F.floor(position))).cast("double")

    return by_label.join(F.broadcast(sizes), group).select(
        group, *[interpolate(name, p).alias(name) for name, p in points.items()]
    )


def percentile_of(df: DataFrame, value: str, points: Mapping[str, float]) -> DataFrame:
    """Percentiles of one column as a one-row frame."""
    counts = durable(
        df.where(F.col(value).isNotNull())
        .groupBy(F.col(value).cast("double").alias("value"))
        .agg(F.count("*").alias("weight"))
        .withColumn("series", F.lit(value))
    )
    row = percentiles(counts, points)
    # An aggregate always gives one row, also for empty input.
    return row.agg(*[F.max(name).alias(name) for name in points])


def quintiles(df: DataFrame, identity: str, metrics: Sequence[str], buckets: int = 5) -> DataFrame:
    """Adds `<metric>_quintile` (1 = smallest) for each metric, ties broken by `identity`.

    The quintile is ceil(buckets * rank / n). It is found from the four elements that end the first four
    quintiles, so no row is moved: `df` is read, its elements are selected, and each row is compared with them.
    `df` should be durable.
    """

    def element(metric: str) -> Column:
        return F.struct(F.col(metric).cast("double").alias("value"), F.col(identity).alias("identity"))

    one = F.lit(1).cast("long").alias("weight")
    cells = [F.struct(F.lit(m).alias("series"), element(m).alias("key"), one) for m in metrics]
    elements = df.select(F.inline(F.array(*cells)))
    ranks = {str(k): F.floor(F.col("n") * k / buckets) for k in range(1, buckets)}
    cuts = (
        order_statistics(elements, ranks)
        .agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "series", "label"), "key"))).alias("at"))
    )

    def quintile(metric: str) -> Column:
        """One more than the number of cuts below the row; a cut at rank 0 does not exist and is below all rows."""
        out = F.lit(1)
        for k in range(1, buckets):
            cut = F.try_element_at("_cuts.at", F.lit(f"{metric}|{k}"))
            out = out + F.coalesce((cut < element(metric)).cast("int"), F.lit(1))
        return out

    return with_row(df, cuts, "_cuts").withColumns({f"{m}_quintile": quintile(m) for m in metrics}).drop("_cuts")


def split_long_groups(df: DataFrame, group: str, key: str, seed: str, target: int = SLICE_ROWS) -> DataFrame:
    """Adds `_slice`, an array that orders the slices of a group like its keys: empty for groups of at most `target` rows.

    Groups are counted first. Only a longer one is cut, at keys sampled from it alone, and what is still too long is
    cut again, until no slice has more than `target` rows or more than one key. `seed` should tell the rows of a
    group apart. Without a long group `df` is read once for the count.
    """
    sliced = df.withColumn("_slice", F.array().cast("array<int>"))
    while True:
        parts = (
            sliced.groupBy(group, "_slice")
            .agg(F.count("*").alias("_rows"), F.min(key).alias("_least"), F.max(key).alias("_most"))
            .where((F.col("_rows") > target) & (F.col("_least") < F.col("_most")))
            .drop("_most")
        )
        if parts.isEmpty():
            return sliced
        # At most one part per `target` rows; each gets at most `EDGES` edges.
        parts = durable(parts)
        edges = (
            sliced.join(parts, [group, "_slice"])
            .where(sampled(F.col(seed), F.col("_rows")))
            .groupBy(group, "_slice")
            .agg(F.collect_set(key).alias("_keys"))
        )
        cuts = parts.join(edges, [group, "_slice"], "left").select(
            group, "_slice", *edge_columns(even_edges(F.coalesce("_keys", F.array()), F.col("_least")))
        )
        deeper = F.array_append("_slice", slice_of(F.col(key)))
        sliced = (
            sliced.join(durable(cuts), [group, "_slice"], "left")
            .withColumn("_slice", F.when(F.col("_edges").isNull(), F.col("_slice")).otherwise(deeper))
            .drop("_edges", "_blocks")
        )
