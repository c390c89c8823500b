"""Device shares over a job arrival and finish trace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardframe.functions.numbers import floor_div, floor_pow2
from shardframe.operators.ordinal import running


def equal_shares(jobs: DataFrame, n_hosts: int, gpus_per_host: int) -> DataFrame:
    """State after each event of ``jobs(job, arrive, finish)``; an open job has a null finish.

    At equal times finishes come first. ``share`` is the power of two below an equal split, ``slot`` the
    place of an arriving job, whose hosts are ``[host_lo, host_hi)`` (none when the share is below a host).
    """
    devices = n_hosts * gpus_per_host
    starts = jobs.select("job", F.col("arrive").alias("time"), F.lit(1).cast("bigint").alias("delta"))
    stops = jobs.filter(F.col("finish").isNotNull()).select(
        "job", F.col("finish").alias("time"), F.lit(-1).cast("bigint").alias("delta")
    )
    events = running(starts.unionByName(stops), ["time", "delta", "job"], sums={"before": F.col("delta")}, position="event")
    active = F.col("before") + F.col("delta")
    share = F.when(active > 0, floor_pow2(floor_div(F.lit(devices), active))).otherwise(F.lit(0).cast("bigint"))
    arriving = F.col("delta") > 0
    hosts = floor_div("share", gpus_per_host)
    return (
        events.withColumn("active", active)
        .withColumn("share", share)
        .withColumn("hosts", hosts)
        .withColumn("idle", F.lit(devices) - F.col("share") * F.col("active"))
        .withColumn("slot", F.when(arriving, F.col("before")))
        .withColumn("host_lo", F.col("slot") * F.col("hosts"))
        .withColumn("host_hi", (F.col("slot") + 1) * F.col("hosts"))
        .drop("before")
    )
