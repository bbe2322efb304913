"""Sums, means, shares and rounding."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec, functions as F

MICRO = 1_000_000.0
#: A whole number of micro-units is summed as two longs: its lowest 24 bits, and what is above them.
LOW = 24


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _limbs(value: Column | str) -> tuple[Column, Column]:
    micros = F.rint(col(value) * MICRO).cast("long")
    return F.shiftright(micros, LOW), micros.bitwiseAND(F.lit((1 << LOW) - 1).cast("long"))


def _amount(high: Column, low: Column) -> Column:
    micros = high.cast("decimal(20,0)") * F.lit(1 << LOW).cast("decimal(8,0)") + low.cast("decimal(20,0)")
    return F.coalesce((micros / F.lit(int(MICRO)).cast("decimal(7,0)")).cast("double"), F.lit(0.0))


def total(value: Column | str) -> Column:
    """Sum of an amount, 0 when there is nothing to sum.

    Each amount is first turned into a whole number of micro-units, and these add up in two longs that are joined to one
    decimal per group. So the sum is exact and does not depend on the order in which tasks are merged or retried. The low
    part holds for 5e11 rows of a group, the high part for a sum of 1e20. An amount that is not finite or
    above nine trillion, or a sum beyond that, ends the job with an error.
    """
    return _amount(*map(F.sum, _limbs(value)))


def total_over(value: Column | str, window: WindowSpec) -> Column:
    """`total` over a window."""
    return _amount(*[F.sum(limb).over(window) for limb in _limbs(value)])


def mean(value: Column | str) -> Column:
    """Mean over the non-null amounts, null when there are none."""
    return F.try_divide(total(value), F.count(col(value)))


def total_if(condition: Column, value: Column | str) -> Column:
    return total(F.when(condition, col(value)))


def mean_if(condition: Column, value: Column | str) -> Column:
    return mean(F.when(condition, col(value)))


def flag_total(value: Column | str) -> Column:
    """Number of rows whose 0/1 flag is set."""
    return F.coalesce(F.sum(col(value).cast("long")), F.lit(0))


def round_even(value: Column | str, digits: int) -> Column:
    """Round half to even, the rule of numpy and pandas."""
    scale = float(10**digits)
    return F.rint(col(value) * scale) / scale


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Plain quotient; null for a zero denominator."""
    return F.try_divide(col(numerator).cast("double"), col(denominator).cast("double"))


def ratio0(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient, 0.0 for a zero or missing denominator."""
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def percent(numerator: Column | str, denominator: Column | str, digits: int | None = 1) -> Column:
    """Percentage; null for a zero denominator. `digits=None` keeps it unrounded."""
    value = ratio(numerator, denominator) * 100
    return value if digits is None else round_even(value, digits)
