"""Time expressions. Timestamps are zone-less UTC (`timestamp_ntz`); the session zone should be UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tradewind.functions.numeric import col

DAY_SECONDS = 86400.0


def parse_utc(text: Column | str) -> Column:
    """Text to zone-less UTC time: an offset is applied, no offset means UTC, bad text gives null."""
    value = F.trim(col(text).cast("string"))
    zoned = value.rlike(r":.*(Z|UTC|[+-]\d{2}:?\d{2})$")
    date_only = value.rlike(r"^[^:]*$")
    complete = (
        F.when(zoned, value)
        .when(date_only, F.concat(value, F.lit(" 00:00:00 UTC")))
        .otherwise(F.concat(value, F.lit(" UTC")))
    )
    instant = F.try_to_timestamp(complete)
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def elapsed_seconds(later: Column | str, earlier: Column | str) -> Column:
    micros = F.unix_micros(col(later).cast("timestamp")) - F.unix_micros(col(earlier).cast("timestamp"))
    return micros / 1e6


def elapsed_days(later: Column | str, earlier: Column | str) -> Column:
    return elapsed_seconds(later, earlier) / DAY_SECONDS


def whole_days(later: Column | str, earlier: Column | str) -> Column:
    """Elapsed days rounded down, so a difference of minus one hour is -1 day."""
    return F.floor(elapsed_days(later, earlier))


def year_month(value: Column | str) -> Column:
    return F.date_format(col(value).cast("date"), "yyyy-MM")


def month_start(value: Column | str) -> Column:
    return F.trunc(col(value).cast("date"), "month")


def date_key(value: Column | str) -> Column:
    day = col(value)
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")
