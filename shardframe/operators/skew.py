"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardframe.session import store

# Bytes of one key that go to one task before the key is salted, and what a row without a weight counts.
BYTES_PER_COPY = 64 << 20
ROW_BYTES = 128


def broadcast_bytes(spark: SparkSession) -> int:
    """Spark's broadcast threshold."""
    return spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark puts a table's size below its broadcast threshold."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size <= broadcast_bytes(df.sparkSession)


def spread_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    weight: Column | None = None,
    bytes_per_copy: int = BYTES_PER_COPY,
    small_bytes: int | None = None,
) -> DataFrame:
    """Join ``big`` (many bytes per key) to ``small`` (few rows per key), where both sides are large.

    Every key above ``bytes_per_copy`` bytes is salted: the big side by a hash of ``spread_by``, the small side
    by copying its rows once per salt. All other keys keep salt 0. ``weight`` gives the bytes of a row of the
    big side. The list of hot keys is written, so Spark sees its size and broadcasts it only if it is small;
    it has at most one row per ``bytes_per_copy`` bytes of the big side. A small side that Spark would broadcast by
    its size needs neither the list nor the salt, and is joined plainly. ``small_bytes`` are its bytes where Spark's
    estimate is known to be too low, as behind an explode. Spark may estimate the big side too low as well, so it is never the
    side that is broadcast.
    """
    keys = list(keys)
    if fits_broadcast(small) and (small_bytes is None or small_bytes <= broadcast_bytes(small.sparkSession)):
        return big.join(F.broadcast(small), keys, how)
    size = F.lit(ROW_BYTES) if weight is None else weight + F.lit(ROW_BYTES)
    hot = store(
        big.groupBy(*keys)
        .agg(F.sum(size.cast("bigint")).alias("_bytes"))
        .filter(F.col("_bytes") > bytes_per_copy)
        .select(*keys, F.ceil(F.col("_bytes") / bytes_per_copy).cast("int").alias("_copies")),
        "hot-keys",
    )
    copies = F.coalesce(F.col("_copies"), F.lit(1))
    salted = big.join(hot, keys, "left").select(
        *big.columns, F.pmod(F.xxhash64(*spread_by), copies).cast("int").alias("_salt")
    )
    copied = small.join(hot, keys, "left").select(
        *small.columns, F.explode(F.sequence(F.lit(0), copies - 1)).alias("_salt")
    )
    return salted.join(copied.hint("merge"), [*keys, "_salt"], how).drop("_salt")


# Width of the smallest cells, when none is given: the quarter of the shorter intervals is narrower.
QUANTILE = 0.25


def cell_count(lo: str, hi: str, bits: int) -> str:
    """Cells of ``2^bits`` that the half-open interval ``[lo, hi)`` touches, as SQL."""
    return f"(shiftright({hi} - 1, {bits}) - shiftright({lo}, {bits}) + 1)"


def dyadic_cells(lo: str, hi: str, bits: int):
    """Aligned cells ``(level, cell)`` that make up the cells of ``2^bits`` touched by ``[lo, hi)``.

    A cell of a level is ``2^level`` smallest ones. Of each level there are two at most, no two overlap, and an interval has twice as many as its
    length in smallest cells has binary digits, whatever its place.
    """
    first, stop = f"shiftright({lo}, {bits})", f"(shiftright({hi} - 1, {bits}) + 1)"
    levels = f"sequence(0, length(conv({cell_count(lo, hi, bits)}, 10, 2)) - 1)"
    # At a level the whole cells inside run from a to b; an odd a has no sibling before it, an odd b none behind it.
    a, b = f"-shiftright(-{first}, l)", f"shiftright({stop}, l)"
    cell = "named_struct('level', l, 'cell', CAST({} AS bigint))"
    left = f"if({a} < {b} AND {a} % 2 <> 0, {cell.format(a)}, NULL)"
    right = f"if({a} < {b} AND {b} % 2 <> 0, {cell.format(b + ' - 1')}, NULL)"
    return F.expr(f"CASE WHEN {lo} < {hi} THEN filter(flatten(transform({levels}, l -> array({left}, {right}))), c -> c IS NOT NULL) END")


def cells_above(at: str, bits: int, levels: int):
    """The cells ``(level, cell)`` of each level below ``levels`` that hold a place."""
    return F.expr(f"transform(sequence(0, {levels - 1}), l -> named_struct('level', l, 'cell', shiftright(shiftright({at}, {bits}), l)))")


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    left_range: tuple[str, str],
    right_range: tuple[str, str],
    width: int | None = None,
    keys: Sequence[str] = (),
    spread_by: Sequence[str] = (),
    bytes_per_copy: int = BYTES_PER_COPY,
) -> DataFrame:
    """Pairs whose half-open intervals overlap, each once, by an equi-join on dyadic cells.

    Of two intervals that overlap one begins in the other. So each row stands for its cells and, apart from that, for the cells of all levels above
    its begin; begins of one side meet cells of the other in one join. An interval's cells don't overlap, so a pair meets once. An interval of any length
    has few cells: one that is a billion times longer than the others has 60. The smallest cells are about ``width`` wide; without a width
    they follow the shorter intervals of the side with the longer ones. ``left`` is the side that may hold many rows per cell. Column names of
    both sides must differ except for ``keys``.
    """
    sizes = []
    for df, (lo, hi) in ((left, left_range), (right, right_range)):
        length = F.expr(f"CASE WHEN {lo} < {hi} THEN {hi} - {lo} END")
        sizes.append(df.agg(F.percentile_approx(length, QUANTILE).alias("short"), F.max(length).alias("long"), F.count(F.lit(1)).alias("n")).first())
    width = width or max(1, *(int(s["short"] or 0) for s in sizes))
    bits = width.bit_length() - 1
    # Levels of the other side's cells: an interval touches one cell more than its length may fill.
    above = [((int(s["long"] or 1) >> bits) + 2).bit_length() for s in sizes]

    def cells(df: DataFrame, bounds: tuple[str, str], levels: int, roles: tuple[str, str]) -> DataFrame:
        lo, hi = bounds
        own = F.transform(dyadic_cells(lo, hi, bits), lambda c: F.struct(F.lit(roles[0]).alias("role"), c["level"].alias("level"), c["cell"].alias("cell")))
        begin = F.transform(cells_above(lo, bits, levels), lambda c: F.struct(F.lit(roles[1]).alias("role"), c["level"].alias("level"), c["cell"].alias("cell")))
        return df.withColumn("_at", F.explode(F.concat(own, begin))).select(*df.columns, F.col("_at.role").alias("_role"), F.col("_at.level").alias("_level"), F.col("_at.cell").alias("_cell"))

    a = cells(left, left_range, above[1], ("L", "R"))
    b = cells(right, right_range, above[0], ("R", "L"))
    # Spark doesn't see that an interval becomes many rows: two cells of each of its levels at most, and one for each level of the other side.
    most = sizes[1]["n"] * (2 * above[1] + above[0]) * ROW_BYTES
    met = spread_join(
        a, b, [*keys, "_role", "_level", "_cell"], spread_by or [left_range[0], left_range[1]], bytes_per_copy=bytes_per_copy, small_bytes=most
    )
    (lo, hi), (lo2, hi2) = left_range, right_range
    begins = f"if(_role = 'R', {lo2} <= {lo} AND {lo} < {hi2}, {lo} < {lo2} AND {lo2} < {hi})"
    return met.filter(begins).drop("_role", "_level", "_cell")
