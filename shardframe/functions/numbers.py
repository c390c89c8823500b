"""Integer arithmetic as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value: Column | str | int | float) -> Column:
    """A column from a column, a column name or a number."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def floor_div(a, b) -> Column:
    """Integer ``a div b`` for non-negative ``a``; null when ``b`` is 0."""
    a, b = as_col(a), as_col(b)
    return F.when(b != 0, F.call_function("div", a.cast("bigint"), b.cast("bigint")))


def ceil_div(a, b) -> Column:
    """Integer ``ceil(a / b)`` for non-negative ``a`` and positive ``b``."""
    return floor_div(as_col(a) + as_col(b) - 1, b)


def floor_pow2(n) -> Column:
    """Largest power of two that is not above ``n``; 0 below 1. Exact for the whole bigint range."""
    n = as_col(n).cast("bigint")
    return F.when(n >= 1, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(n)) - 1)).otherwise(
        F.lit(0).cast("bigint")
    )


def percent(part, whole) -> Column:
    """``100 * part / whole``, null when the whole is 0."""
    whole = as_col(whole)
    return F.when(whole != 0, F.lit(100.0) * as_col(part) / whole)


def eta(elapsed, progress, total) -> Column:
    """Remaining time at the present pace, null before any progress."""
    progress = as_col(progress)
    return F.when(progress != 0, as_col(elapsed) * (as_col(total) - progress) / progress)


def prod(shape: Column | str) -> Column:
    """Product of an array of integers, 1 for an empty one."""
    return F.aggregate(as_col(shape), F.lit(1).cast("bigint"), lambda a, d: a * d.cast("bigint"))
