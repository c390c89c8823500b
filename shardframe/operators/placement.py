"""Replica placement on a ring of hosts, fallback reads and placement comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardframe.operators.ordinal import running


def replicas(hosts: DataFrame, r: int) -> DataFrame:
    """Copies of what each of ``hosts(host_ord, host)`` owns: ``(owner, copy, host_ord)``, copies 0..r.

    Copy ``j`` of host ``i`` is on host ``(i + j) mod n``; ``r`` must be below the number of hosts.
    """
    if r < 0:
        raise ValueError("r must not be negative")
    n = hosts.agg(F.count(F.lit(1))).scalar()
    size = F.when(n > r, n).otherwise(F.raise_error(F.lit("fewer hosts than copies")).cast("bigint"))
    copies = hosts.select(
        F.col("host_ord").alias("owner"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(r).cast("bigint"))).alias("copy")
    )
    return copies.withColumn("host_ord", (F.col("owner") + F.col("copy")) % size)


def resolve_hosts(copies: DataFrame, failed: DataFrame) -> DataFrame:
    """Per owner the first copy on a host that has not failed, and how many copies are left."""
    down = failed.select("host_ord").distinct().withColumn("_down", F.lit(True))
    seen = copies.join(down, "host_ord", "left")
    alive = F.col("_down").isNull()
    return seen.groupBy("owner").agg(
        F.min_by("host_ord", F.when(alive, F.col("copy"))).alias("source"),
        F.count(F.when(alive, 1)).alias("alive"),
        F.count(F.lit(1)).alias("copies"),
        F.bool_or((F.col("copy") == 0) & ~alive).alias("owner_failed"),
    )


def resolve_source(items: DataFrame, copies: DataFrame, failed: DataFrame, gpus_per_host: int) -> DataFrame:
    """Host to read each of ``items(item, device)`` from; null source and ``unrecoverable`` when none is left."""
    owned = items.withColumn("owner", F.expr(f"device div {gpus_per_host}L"))
    hosts = resolve_hosts(copies, failed).select("owner", "source")
    joined = owned.join(hosts, "owner", "left")
    return joined.select(*items.columns, "owner", "source", F.col("source").isNull().alias("unrecoverable"))


def failure_impact(items: DataFrame, copies: DataFrame, failed: DataFrame) -> DataFrame:
    """Items ``(item, owner)`` whose owner failed, with copies left and whether that is enough."""
    hosts = resolve_hosts(copies, failed).filter("owner_failed").select("owner", "alive")
    joined = items.join(hosts, "owner")
    return joined.select(*items.columns, "alive", (F.col("alive") > 0).alias("recoverable"))


def placement_diff(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("host", "port", "item")) -> DataFrame:
    """Distinct rows of both snapshots tagged ``only_left``, ``only_right`` or ``common``, with their counts.

    Equal rows are counted before they meet, so a placement that repeats often is one row in the join.
    """
    keys = list(keys)
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = left.select(*keys, one.alias("l"), zero.alias("r")).unionByName(right.select(*keys, zero.alias("l"), one.alias("r")))
    counts = both.groupBy(*keys).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))
    side = F.when(F.col("n_right") == 0, "only_left").when(F.col("n_left") == 0, "only_right").otherwise("common")
    return counts.withColumn("side", side)


def placement_relation(left: DataFrame, right: DataFrame, order: str, keys: Sequence[str] = ("host", "port", "item")) -> DataFrame:
    """One row: are the snapshots equal in order, are they disjoint."""
    keys = list(keys)
    a = left.select(F.col(order).alias("_at"), F.struct(*keys).alias("_a"))
    b = right.select(F.col(order).alias("_at"), F.struct(*keys).alias("_b"))
    equal = a.join(b, "_at", "full_outer").agg(
        F.coalesce(F.bool_and(F.col("_a").eqNullSafe(F.col("_b"))), F.lit(True)).alias("equal")
    )
    common = placement_diff(left, right, keys).filter("side = 'common'").agg(F.count(F.lit(1))).scalar()
    return equal.withColumn("disjoint", common == 0)


def on_host(placement: DataFrame, host: str) -> DataFrame:
    """Rows on one host."""
    return placement.filter(F.col("host") == host)


def others(placement: DataFrame, host: str, port: int) -> DataFrame:
    """All rows but those of one peer."""
    return placement.filter(~((F.col("host") == host) & (F.col("port") == port)))


def host_groups(placed: DataFrame, host: str = "host", rank: str = "rank") -> DataFrame:
    """Local rank, local size, master (lowest rank on the host) and host count of each row."""
    local = running(placed, [rank], [host], position="local_rank", total="local_size")
    hosts = placed.groupBy(host).agg(F.min(rank).alias("master"))
    n_hosts = hosts.agg(F.count(F.lit(1))).scalar()
    return local.join(hosts, host).withColumn("host_count", n_hosts)
