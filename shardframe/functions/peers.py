"""Host addresses as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardframe.functions.numbers import as_col

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def ipv4_to_long(address) -> Column:
    """IPv4 text as an unsigned 32-bit value in a bigint; null for anything else."""
    address = as_col(address)
    value = F.aggregate(F.split(address, r"\."), F.lit(0).cast("bigint"), lambda v, octet: v * 256 + octet.cast("bigint"))
    return F.when(address.rlike(_IPV4), value)


def long_to_ipv4(value) -> Column:
    """The inverse of ``ipv4_to_long``; null outside 32 bits."""
    value = as_col(value)
    octets = [F.shiftright(value, 24 - 8 * i).bitwiseAND(F.lit(255)).cast("string") for i in range(4)]
    return F.when(value.between(0, (1 << 32) - 1), F.concat_ws(".", *octets))


def parse_peers(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Explode ``ip:port,ip:port`` lists into ``(…, rank, host, ipv4, port)`` and a violations table."""
    entries = df.select("*", F.posexplode(F.split(column, ",")).alias("rank", "_entry"))
    parsed = entries.select(
        *df.columns,
        F.col("rank").cast("bigint").alias("rank"),
        "_entry",
        F.regexp_extract("_entry", r"^([^:]*):(\d+)$", 1).alias("host"),
        F.expr(r"try_cast(regexp_extract(_entry, '^([^:]*):([0-9]+)$', 2) AS bigint)").alias("port"),
    ).withColumn("ipv4", ipv4_to_long("host"))
    good = F.col("ipv4").isNotNull() & F.coalesce(F.col("port").between(0, 65535), F.lit(False))
    peers = parsed.filter(good).select(*df.columns, "rank", "host", "ipv4", "port")
    bad = parsed.filter(~good).select(
        *df.columns, "rank", F.col("_entry").alias("entry"), F.lit("not an ip:port address").alias("reason")
    )
    return peers, bad
