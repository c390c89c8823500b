"""Readable sizes and rates; the three formats differ in bounds, digits and suffixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shardframe.functions.numbers import as_col

# Fixed values.
KI = 1024
MI = 1024 * KI
GI = 1024 * MI
TI = 1024 * GI


def _scaled(n: Column, fmt: str, unit: int) -> Column:
    # %.1f rounds ties up on the JVM; the published formats round them to even.
    digits = int(fmt[fmt.index(".") + 1])
    return F.format_string(fmt, F.bround(n.cast("double") / F.lit(float(unit)), digits))


def show_size(n) -> Column:
    """``1.5KiB`` style with bounds inclusive; plain digits below 1 Ki; the largest unit is ``Ti``."""
    n = as_col(n)
    return (
        F.when(n >= TI, _scaled(n, "%.1fTi", TI))
        .when(n >= GI, _scaled(n, "%.1fGiB", GI))
        .when(n >= MI, _scaled(n, "%.1fMiB", MI))
        .when(n >= KI, _scaled(n, "%.1fKiB", KI))
        .otherwise(n.cast("bigint").cast("string"))
    )


def show_rate(rate) -> Column:
    """``1.50 KiB/s`` style with bounds exclusive."""
    r = as_col(rate)
    return (
        F.when(r > GI, _scaled(r, "%.2f GiB/s", GI))
        .when(r > MI, _scaled(r, "%.2f MiB/s", MI))
        .when(r > KI, _scaled(r, "%.2f KiB/s", KI))
        .otherwise(_scaled(r, "%.2f B/s", 1))
    )


def show_bytes(n) -> Column:
    """``1.500MiB`` style with bounds exclusive and no Ki step."""
    n = as_col(n)
    return (
        F.when(n > GI, _scaled(n, "%.3fGiB", GI))
        .when(n > MI, _scaled(n, "%.3fMiB", MI))
        .otherwise(n.cast("bigint").cast("string"))
    )
