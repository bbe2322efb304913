"""Attaching one row to many, and turning one wide row into rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


def all_groups() -> WindowSpec:
    """Window over all rows, for frames already aggregated to years, categories, centers or other catalog groups."""
    return Window.partitionBy()


def with_row(df: DataFrame, row: DataFrame, name: str) -> DataFrame:
    """Adds the one-row frame `row` as a struct column: a scalar subquery that runs once, however often it is used."""
    return df.withColumn(name, row.select(F.struct("*")).scalar())


def to_metrics(row: DataFrame, metrics: Sequence[tuple[str, Column, str]]) -> DataFrame:
    """One-row frame to (metric, value, unit)."""
    cells = [
        F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"), F.lit(unit).alias("unit"))
        for name, value, unit in metrics
    ]
    return row.select(F.inline(F.array(*cells)))


def to_checks(row: DataFrame, section: str, checks: Sequence[str] | None = None) -> DataFrame:
    """One-row frame of counts to (section, check, value)."""
    names = list(checks or row.columns)
    cells = [
        F.struct(F.lit(section).alias("section"), F.lit(n).alias("check"), F.col(f"`{n}`").cast("double").alias("value"))
        for n in names
    ]
    return row.select(F.inline(F.array(*cells)))
