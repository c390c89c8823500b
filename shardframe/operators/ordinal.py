"""Distributed positions and running sums.

``row_number() OVER (ORDER BY ...)`` without a partition puts the whole table into one task. Here the
rows are range-partitioned on the order, and the only thing that is combined globally is one row per
(range partition, group): its row count and its sums.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardframe.session import cut_lineage, store

_BEFORE = (Window.unboundedPreceding, -1)
_ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def _cells(cells: DataFrame, groups: Sequence[str]) -> DataFrame:
    """A table of one row per (range partition, group).

    Without groups it has a row per partition, which is broadcast. With groups it is written, and Spark broadcasts
    it only if its bytes are few.
    """
    return store(cells, "cells") if groups else F.broadcast(cells)


def running(
    df: DataFrame,
    order: Sequence[str],
    groups: Sequence[str] = (),
    sums: Mapping[str, Column] | None = None,
    position: str = "position",
    total: str | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in its group and exclusive running sums.

    ``order`` must be unique inside a group. A group of any size is cut over many range partitions, so
    a hot group costs no more than the same rows spread over many groups. ``sums`` maps an output name
    to the expression to accumulate; ``total`` names a column for the group's row count.
    """
    sums = dict(sums or {})
    keys = [*groups, *order]
    measured = df.select("*", *[e.alias(f"_add_{n}") for n, e in sums.items()])
    ranged = measured.repartitionByRange(*([parts] if parts else []), *keys)
    # The slot is partition number * 2^33 + offset, so it gives both without a window. It is written
    # out because a second evaluation could pick other range bounds.
    placed = cut_lineage(
        ranged.sortWithinPartitions(*keys).withColumn("_slot", F.monotonically_increasing_id())
    ).withColumn("_cell", F.struct(F.shiftright("_slot", 33).alias("p"), *groups))

    cells = placed.groupBy("_cell").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min("_slot").alias("_first"),
        *[F.sum(f"_add_{n}").alias(f"_sum_{n}") for n in sums],
    )
    # One row per (range partition, group); inside a group at most one row per range partition.
    in_group = Window.partitionBy(F.struct(F.lit(0), *[F.col(f"_cell.{g}") for g in groups]))
    earlier = in_group.orderBy("_cell.p").rowsBetween(*_BEFORE)
    bases = cells.select(
        "_cell",
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_base_{n}") for n in sums],
        *([F.sum("_rows").over(in_group.rowsBetween(*_ALL)).alias(total)] if total else []),
    )
    joined = placed.join(_cells(bases, groups), "_cell")
    inside = Window.partitionBy("_cell").orderBy("_slot").rowsBetween(*_BEFORE)
    return joined.select(
        *df.columns,
        (F.col("_slot") + F.col("_shift")).alias(position),
        *[
            (F.col(f"_base_{n}") + F.coalesce(F.sum(f"_add_{n}").over(inside), F.lit(0))).alias(n)
            for n in sums
        ],
        *([total] if total else []),
    )


# Rows of a hash bucket, on average: a bucket is sorted in one task.
BUCKET_ROWS = 1 << 18


def hashed_order(df: DataFrame, id_col: str, seed: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Positions of a seeded permutation: ``(position, sample_id, n_samples)``.

    Order is by ``md5(seed:id)``. Hash prefixes are equally likely, so they make balanced buckets; their length
    follows from the number of rows, so a bucket stays small. Only the bucket counts, a row per
    ``bucket_rows / 16`` rows at most, are combined globally; they are written, and broadcast only if small.
    """
    hex_digits = max(2, math.ceil(math.log(max(df.count() / bucket_rows, 1), 16)))
    keyed = df.select(
        F.col(id_col).alias("sample_id"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))).alias("_hash"),
    ).withColumn("_bucket", F.substring("_hash", 1, hex_digits))
    whole = Window.partitionBy(F.lit(0))
    counts = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    bases = store(
        counts.select(
            "_bucket",
            F.coalesce(F.sum("_rows").over(whole.orderBy("_bucket").rowsBetween(*_BEFORE)), F.lit(0)).alias("_base"),
            F.sum("_rows").over(whole.rowsBetween(*_ALL)).alias("n_samples"),
        ),
        "buckets",
    )
    in_bucket = Window.partitionBy("_bucket").orderBy("_hash", "sample_id")
    return keyed.join(bases, "_bucket").select(
        (F.col("_base") + F.row_number().over(in_bucket) - 1).alias("position"), "sample_id", "n_samples"
    )


def neighbour(df: DataFrame, groups: Sequence[str], position: str, columns: Mapping[str, str], step: int) -> DataFrame:
    """Add columns of the row ``step`` places away (null at the ends), by an equi-join on position.

    The join key holds the position, so it is unique and a hot group spreads over all tasks.
    """
    other = df.select(
        *[F.col(g).alias(f"_g_{g}") for g in groups],
        (F.col(position) - step).alias("_at"),
        *[F.col(c).alias(n) for n, c in columns.items()],
    )
    on = df[position] == other["_at"]
    for g in groups:
        on = on & df[g].eqNullSafe(other[f"_g_{g}"])
    return df.join(other, on, "left").drop("_at", *[f"_g_{g}" for g in groups])


def depth_pieces(changes: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Pieces ``(*groups, lo, hi, times)`` of a line between the places of ``changes(*groups, at, step)``; ``times`` sums the steps up to a piece.

    An interval is a step of 1 at its begin and of -1 at its end, so ``times`` tells how many intervals hold a piece. The last piece of a group is open.
    """
    summed = changes.groupBy(*groups, "at").agg(F.sum("step").alias("step"))
    placed = running(summed, ["at"], groups, sums={"before": F.col("step")}, position="_k")
    return neighbour(placed, groups, "_k", {"until": "at"}, 1).select(
        *groups, F.col("at").alias("lo"), F.col("until").alias("hi"), (F.col("before") + F.col("step")).alias("times")
    )


def run_lengths(df: DataFrame, groups: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Run-length encode ``value`` along ``order`` per group: ``(*groups, run, value, count)``."""
    # Positions come from a written table, so both uses below see the same ones.
    placed = running(df.select(*groups, *order, value), order, groups, position="_pos", total="_n")
    marked = neighbour(placed, groups, "_pos", {"_prev": value}, -1)
    starts = marked.filter((F.col("_pos") == 0) | ~F.col("_prev").eqNullSafe(F.col(value)))
    numbered = running(starts.select(*groups, value, "_pos", "_n"), ["_pos"], groups, position="run")
    ends = neighbour(numbered, groups, "run", {"_next": "_pos"}, 1)
    return ends.select(
        *groups, "run", value, (F.coalesce("_next", "_n") - F.col("_pos")).alias("count")
    )


def following(
    points: DataFrame,
    series: DataFrame,
    groups: Sequence[str],
    key: str,
    columns: Sequence[str],
    strict: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """For each point the first row of ``series`` in its group with ``key`` at or after the point's.

    ``strict`` asks for a later key. Adds ``next_<key>`` and ``next_<column>``, null where nothing follows.
    Both tables are sorted together over range partitions; what a partition cannot answer itself comes
    from the first series row of a later one, so a hot group is no single task.
    """
    wanted = [key, *columns]
    series_rows = series.select(
        *groups, key, F.struct(*wanted).alias("_hit"), F.lit(None).cast(points.select(F.struct(*points.columns)).schema[0].dataType).alias("_point")
    )
    point_rows = points.select(
        *groups, key, F.lit(None).cast(series_rows.schema["_hit"].dataType).alias("_hit"), F.struct(*points.columns).alias("_point")
    )
    both = point_rows.unionByName(series_rows)
    # At an equal key a point sorts before the series rows it may take, or after them when strict.
    side = F.col("_point").isNull() if not strict else F.col("_hit").isNull()
    keys = [*groups, key, "_side"]
    ranged = both.withColumn("_side", side).repartitionByRange(*([parts] if parts else []), *keys)
    placed = cut_lineage(
        ranged.sortWithinPartitions(*keys).withColumn("_slot", F.monotonically_increasing_id())
    ).withColumn("_cell", F.struct(F.shiftright("_slot", 33).alias("p"), *groups))
    firsts = placed.groupBy("_cell").agg(F.min_by("_hit", F.when(F.col("_hit").isNotNull(), F.col("_slot"))).alias("_lead"))
    later = (
        Window.partitionBy(F.struct(F.lit(0), *[F.col(f"_cell.{g}") for g in groups]))
        .orderBy(F.col("_cell.p").desc())
        .rowsBetween(*_BEFORE)
    )
    carried = firsts.select("_cell", F.last("_lead", ignorenulls=True).over(later).alias("_carry"))
    inside = Window.partitionBy("_cell").orderBy(F.col("_slot").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = placed.withColumn("_own", F.last("_hit", ignorenulls=True).over(inside)).filter(F.col("_point").isNotNull())
    hit = F.coalesce("_own", "_carry")
    return found.join(_cells(carried, groups), "_cell").select("_point.*", *[hit[c].alias(f"next_{c}") for c in wanted])
