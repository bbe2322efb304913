"""Bucketing of numbers into labelled bands."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from tradewind.functions.numeric import col

# Band edges and labels.
SALE_PRICE_BANDS = ((0, 25, 50, 100, 200, None), ("<$25", "$25-50", "$50-100", "$100-200", "$200+"))
RECOGNIZED_PRICE_BANDS = (
    (0, 25, 50, 100, 200, 500, None),
    ("<$25", "$25-50", "$50-100", "$100-200", "$200-500", "$500+"),
)
AGE_BANDS = ((0, 24, 34, 44, 54, 64, 200), ("<=24", "25-34", "35-44", "45-54", "55-64", "65+"))
FULFILLMENT_BUCKETS = ((None, 2, 4, 7, None), ("<=2 days", "3-4 days", "5-7 days", "8+ days"))
DELIVERY_BINS = ((None, 3, 5, 7, 10, None), ("<=3d", "3-5d", "5-7d", "7-10d", ">10d"))
NOT_DELIVERED = "not delivered / open"


def band(
    value: Column | str,
    bands: tuple[Sequence[float | None], Sequence[str]],
    closed: str = "right",
    include_lowest: bool = False,
) -> Column:
    """Label of the interval that holds `value`; null outside all of them. A `None` edge is infinite."""
    edges, labels = bands
    v = col(value)

    def inside(low: float | None, high: float | None, first: bool) -> Column:
        tests = [v.isNotNull()]
        if low is not None:
            tests.append(v >= low if closed == "left" or (first and include_lowest) else v > low)
        if high is not None:
            tests.append(v < high if closed == "left" else v <= high)
        return reduce(lambda a, b: a & b, tests)

    out: Column | None = None
    for i, label in enumerate(labels):
        test = inside(edges[i], edges[i + 1], i == 0)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def sale_price_band(price: Column | str) -> Column:
    return band(price, SALE_PRICE_BANDS, closed="left")


def first_match(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """Label of the first rule that holds. A null condition does not hold."""
    out: Column | None = None
    for test, label in rules:
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(F.lit(default))
