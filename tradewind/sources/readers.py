"""Reading raw tables (CSV or Parquet) and a written star schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tradewind.functions.temporal import parse_utc
from tradewind.params import NO_PURCHASE_SEGMENT
from tradewind.sources.schemas import FUNNEL_EVENT_COLUMNS, RAW_FILES, RAW_SCHEMAS, RawTables, StarSchema


# Texts of a missing value in the CSV files. In events only an empty field is missing.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
MISSING_IN_EVENTS = ("",)


def read_raw(
    spark: SparkSession, folder: str, table: str, fmt: str = "csv", columns: Sequence[str] | None = None, absent: str = "error"
) -> DataFrame:
    """One raw table with its fixed types.

    CSV is read as text and cast here, so no inference pass runs over the data and files stay splittable.
    """
    path = f"{folder.rstrip('/')}/{RAW_FILES[table]}"
    if fmt == "csv":
        df = spark.read.option("header", True).option("escape", '"').csv(f"{path}.csv")
    else:
        df = spark.read.parquet(f"{path}.parquet")
    return typed(df, table, columns, absent)


def typed(df: DataFrame, table: str, columns: Sequence[str] | None = None, absent: str = "error") -> DataFrame:
    """A frame with the names of a raw table, cast to its types; texts that cannot be read become null.

    Columns are matched by name. One that is absent is an error, or with `absent="null"` a column of nulls.
    """
    missing = MISSING_IN_EVENTS if table == "events" else MISSING
    wanted = list(columns or RAW_SCHEMAS[table])
    lacking = [c for c in wanted if c not in df.columns]
    if lacking and absent != "null":
        raise ValueError(f"{table} lacks the columns {', '.join(lacking)}")
    return df.select(*[_typed(df, name, RAW_SCHEMAS[table][name], missing).alias(name) for name in wanted])


def _typed(df: DataFrame, name: str, kind: str, missing: Sequence[str]) -> Column:
    if name not in df.columns:
        return F.lit(None).cast(kind)
    value = F.col(name)
    if dict(df.dtypes)[name] != "string":
        return value.try_cast(kind)
    value = F.when(~value.isin(*missing), value)
    return parse_utc(value) if kind == "timestamp_ntz" else value.try_cast(kind)


def load_raw(
    spark: SparkSession, folder: str, fmt: str = "csv", event_columns: Sequence[str] | None = None
) -> RawTables:
    """All seven raw tables; `event_columns` narrows the largest one."""
    return RawTables(
        **{
            table: read_raw(spark, folder, table, fmt, event_columns if table == "events" else None)
            for table in RAW_FILES
        }
    )


def _optional(read) -> DataFrame | None:
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def load_funnel_events(spark: SparkSession, folder: str | None, fmt: str = "csv") -> DataFrame | None:
    """Event columns of the funnel analyses, or None when there is no such file."""
    if folder is None:
        return None
    return _optional(lambda: read_raw(spark, folder, "events", fmt, FUNNEL_EVENT_COLUMNS))


def load_raw_orders(spark: SparkSession, folder: str | None, fmt: str = "csv") -> DataFrame | None:
    if folder is None:
        return None
    return _optional(lambda: read_raw(spark, folder, "orders", fmt))


def load_star(spark: SparkSession, folder: str) -> StarSchema:
    """The star schema as written by `save_star`, purchase columns of users filled."""
    tables = {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet") for name in StarSchema.__annotations__}
    tables["dim_users"] = fill_users(tables["dim_users"])
    return StarSchema(**tables)


def fill_users(users: DataFrame) -> DataFrame:
    """Users with the purchase columns filled where they never bought."""
    filled = {"rfm_segment": NO_PURCHASE_SEGMENT, "Frequency": 0, "Monetary": 0.0, "return_rate_pct": 0.0}
    return users.fillna({k: v for k, v in filled.items() if k in users.columns})
