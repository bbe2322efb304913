"""Writing results as Parquet, CSV or JSON."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, functions as F

from tradewind.sources.schemas import StarSchema

FACTS = ("fact_transactions", "fact_inventory")


def write_result(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> int:
    """Writes `df` and returns its number of rows.

    Rows are counted as they are written, in the stage that writes them: Spark takes the count of a task's partition once,
    from the attempt that is committed, so a failed attempt does not count.
    """
    written = Observation()
    writer = df.observe(written, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt in ("csv", "json"):
        # The default pattern would cut times to milliseconds.
        writer = writer.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return written.get["rows"]


def save_star(star: StarSchema, folder: str, formats: Sequence[str] = ("parquet", "csv")) -> dict[str, int]:
    """Writes the seven tables and returns their row counts.

    Rows are counted while the Parquet copy is written, and further formats are taken from that copy: no table is computed
    twice or read back to be counted. The transaction fact is partitioned by year; the rebalance hint evens out
    file sizes, splitting a year that holds most rows.
    """
    counts: dict[str, int] = {}
    for name, df in star.items():
        spark = df.sparkSession
        parquet = f"{folder.rstrip('/')}/{name}.parquet"
        if name == "fact_transactions":
            dated = df.withColumn("year", F.floor(F.col("date_key") / 10000).cast("int"))
            counts[name] = write_result(dated.hint("rebalance", "year"), parquet, "parquet", ["year"])
        elif name in FACTS:
            counts[name] = write_result(df.hint("rebalance"), parquet)
        else:
            counts[name] = write_result(df, parquet)
        for fmt in formats:
            if fmt != "parquet":
                write_result(spark.read.parquet(parquet), f"{folder.rstrip('/')}/{name}.{fmt}", fmt)
    return counts


def save_results(results: Mapping[str, DataFrame], folder: str, fmt: str = "csv") -> None:
    """One folder per result."""
    for name, df in results.items():
        write_result(df, f"{folder.rstrip('/')}/{name}.{fmt}", fmt)
