"""Intermediate tables, joins on hot keys and selections by id that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Slices and 32,768-bit bitmaps of `id_bitmap`: 4 MB in all, whatever the number of ids.
BITMAPS, BITS = 1024, 32768
#: Texts that a Python worker gets at a time; one longer text comes alone.
BATCH_BYTES = 2 << 20


def batches_by_bytes(spark: SparkSession) -> None:
    """From now on texts go to Python workers in batches of BATCH_BYTES, whatever the number of rows.

    A batch stands in the executor outside its heap, several times over while it grows, and in the worker, and what either
    has once taken it keeps for the stages that follow.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in `spark.checkpoint.dir`; a local session without one gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Folders of the tables made inside each open `working_tables`, innermost last.
_open: list[list[str]] = []


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}"), folder


def remove(spark: SparkSession, folders: list[str]) -> None:
    jvm = spark._jvm
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` once as Parquet in the shared folder and reads it from there: it outlives the executors that made it.

    Inside `working_tables` it goes with them, otherwise it stays.
    """
    out, folder = _write(df, name)
    if _open:
        _open[-1].append(folder)
    return out


@contextmanager
def working_tables(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that were stored inside when it ends. Results that read them must have been written by then."""
    made: list[str] = []
    _open.append(made)
    try:
        yield
    finally:
        _open.remove(made)
        remove(spark, made)


def settled(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """Stores what `build` gives and removes the tables that were stored on the way to it."""
    with working_tables(spark):
        out, folder = _write(build(), name)
    if _open:
        _open[-1].append(folder)
    return out


def _place(column: str, salt: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column), *[F.lit(salt)] * (salt > 0)), F.lit(BITMAPS * BITS))


def id_bitmap(ids: DataFrame, column: str, salt: int = 0) -> DataFrame:
    """At most BITMAPS rows (slice, bits): a one-hash filter of fixed size over the ids. Another salt is another hash."""
    h = _place(column, salt)
    return (
        ids.select(h.alias("h"))
        .groupBy(F.expr(f"h div {BITS}").alias("_slice"))
        .agg(F.bitmap_construct_agg(F.col("h") % BITS).alias("_bits"))
    )


def may_be_in(df: DataFrame, bitmap: DataFrame, column: str, salt: int = 0) -> DataFrame:
    """`df` with `_maybe`: false only where the id is certainly not among those of the bitmap, made with the same salt."""
    h = _place(column, salt)
    byte = F.conv(F.hex(F.substring("_bits", F.expr(f"cast((_h % {BITS}) div 8 + 1 as int)"), 1)), 16, 10).cast("int")
    bit = F.expr("cast(_h % 8 as int)")
    return (
        df.withColumn("_h", h)
        .withColumn("_slice", F.expr(f"_h div {BITS}"))
        .join(F.broadcast(bitmap), "_slice", "left")  # 4 MB at most
        .withColumn("_maybe", F.coalesce(F.bit_get(byte, bit) == 1, F.lit(False)))
        .drop("_h", "_slice", "_bits")
    )


def told_by_filters(df: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of `df` whose id is certainly not among `ids`, those whose id certainly is, and the rest, which need a join.

    A first filter holds `ids`; a second one holds those ids of `df` that the first takes for one of them by mistake,
    found by a join of ids alone. So a row meets a shuffle only if its id is such a mistake, or looks like one.
    Rows without an id are never in the second part. `df` is read twice, once for its ids only.
    """
    marked = may_be_in(df, id_bitmap(ids, column), column)
    likely = marked.where("_maybe").drop("_maybe")
    mistaken = likely.select(column).join(ids, column, "left_anti")
    marked_again = may_be_in(likely, id_bitmap(stored(mistaken, "mistaken_ids"), column, 1), column, 1)
    inside = marked_again.where(~F.col("_maybe")).drop("_maybe")
    return marked.where(~F.col("_maybe")).drop("_maybe"), inside, marked_again.where("_maybe").drop("_maybe")


def with_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of `df` whose id is among `ids` (one column, distinct). Most others never reach the shuffle."""
    return (
        may_be_in(df, id_bitmap(ids, column), column).where("_maybe").drop("_maybe").join(ids, column, "left_semi")
    )


def without_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of `df` whose id is not among `ids`; rows without an id stay. Few rows are shuffled."""
    outside, _, unsure = told_by_filters(df, ids, column)
    return outside.unionByName(unsure.join(ids, column, "left_anti"))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, share: int = 1000) -> DataFrame:
    """Gives each row what `groups` has for its key. Both should be stored tables.

    Groups with more than 1/`share` of all rows are fewer than `share`, so they are broadcast; the rows of the others
    are shuffled, and none of those groups is large.
    """
    hot = groups.where(F.col(size) * share > F.lit(total))
    extra = [c for c in groups.columns if c not in keys]
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    done = marked.where("_hot").drop("_hot")
    rest = marked.where("_hot is null").drop("_hot", *extra)
    cold = groups.where(F.col(size) * share <= F.lit(total))
    return done.unionByName(rest.join(cold, keys, "left"))


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that can reach a smaller one.

    Alternates two kinds of star contraction until the edges are a forest of stars, which one aggregation by node
    tells; every round is two aggregations and two joins on the edges, and the number of rounds grows with the logarithm
    of the longest path.
    """
    spark = edges.sparkSession
    edge = [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]
    current, folder = _write(edges.where(F.col(a) != F.col(b)).select(*edge).distinct(), "edges")
    while True:
        ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))
        nodes = current.select(F.inline(ends)).groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("least"))
        # a star's leaf has one edge, to its center, which is no leaf
        if nodes.where("out > 1 or (out > 0 and least = 0)").isEmpty():
            if _open:
                _open[-1].append(folder)
            return current.select(F.col("u").alias("id"), F.col("v").alias("component"))
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        done = folder
        current, folder = _write(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        remove(spark, [done])
