"""Column functions over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from shardframe.functions import (
    append_path, ceil_div, eta, floor_pow2, long_to_ipv4, parse_peers, path_parts, percent,
    rel_path, show_bytes, show_rate, show_size, trim_last_ext,
)
from shardframe.functions.paths import base_name, parent_path
from shardframe.plans.registry import query, table


@query(
    "f1_show_size",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
         (l_partkey * l_partkey * (l_suppkey + 1) * (l_linenumber * 1000 + 1))::BIGINT AS n FROM lineitem)
    SELECT n, CASE WHEN n >= 1099511627776 THEN printf('%.1fTi', n / 1099511627776.0::DOUBLE)
       WHEN n >= 1073741824 THEN printf('%.1fGiB', n / 1073741824.0::DOUBLE)
       WHEN n >= 1048576 THEN printf('%.1fMiB', n / 1048576.0::DOUBLE)
       WHEN n >= 1024 THEN printf('%.1fKiB', n / 1024.0::DOUBLE) ELSE n::VARCHAR END AS size,
     CASE WHEN n > 1073741824 THEN printf('%.2f GiB/s', n / 1073741824.0::DOUBLE)
       WHEN n > 1048576 THEN printf('%.2f MiB/s', n / 1048576.0::DOUBLE)
       WHEN n > 1024 THEN printf('%.2f KiB/s', n / 1024.0::DOUBLE) ELSE printf('%.2f B/s', n::DOUBLE) END AS rate,
     CASE WHEN n > 1073741824 THEN printf('%.3fGiB', n / 1073741824.0::DOUBLE)
       WHEN n > 1048576 THEN printf('%.3fMiB', n / 1048576.0::DOUBLE) ELSE n::VARCHAR END AS bytes
    FROM t""",
)
def f1(spark, sf):
    part, supplier, line = (F.col(c).cast("decimal(20,0)") for c in ("l_partkey", "l_suppkey", "l_linenumber"))
    # The product of large keys is beyond a bigint: there it has no number, but its texts are those of the wide product.
    wide = reduce(lambda a, b: (a * b).cast("decimal(38,0)"), [supplier + 1, line * 1000 + 1, part, part])
    n = F.when(F.col("_wide").between(-(1 << 63), (1 << 63) - 1), F.col("_wide").cast("bigint"))
    sized = table(spark, sf, "lineitem").select(wide.alias("_wide")).select("_wide", n.alias("n"))

    def shown(show):
        return F.when(F.col("n").isNull(), show("_wide")).otherwise(show("n"))

    return sized.select("n", shown(show_size).alias("size"), shown(show_rate).alias("rate"), shown(show_bytes).alias("bytes"))


@query(
    "f2_percent_eta",
    """SELECT o_orderkey, 100::DOUBLE * o_custkey / nullif(o_orderkey, 0) AS pct,
      CASE WHEN o_custkey <> 0 THEN o_totalprice * (o_orderkey - o_custkey) / o_custkey END AS eta FROM orders""",
)
def f2(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        percent("o_custkey", "o_orderkey").alias("pct"),
        eta("o_totalprice", "o_custkey", "o_orderkey").alias("eta"),
    )


@query(
    "f3_uri_parts",
    r"""SELECT page_id,
      regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/')
        || '/idx/part.0' || regexp_extract(url, '^[a-z]+://[^/?#]*[^?#]*(.*)$', 1) AS appended,
      ltrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') AS rel,
      CASE WHEN regexp_matches(url, '[^/.][^/]*\.[^/.]*$') THEN regexp_replace(url, '\.[^/.]*$', '') ELSE url END AS trimmed
    FROM pages""",
)
def f3(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id",
        append_path("url", F.lit("/idx/part.0")).alias("appended"),
        rel_path("url").alias("rel"),
        trim_last_ext("url").alias("trimmed"),
    )


@query(
    "f4_path_parts",
    """WITH t AS (SELECT page_id, list_filter(string_split(url, '/'), lambda x: x <> '') AS parts FROM pages)
    SELECT page_id, len(parts)::BIGINT AS depth, '/' || array_to_string(parts[1:len(parts) - 1], '/') AS parent,
      parts[len(parts)] AS base FROM t""",
)
def f4(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id",
        F.size(path_parts("url")).cast("bigint").alias("depth"),
        parent_path("url").alias("parent"),
        base_name("url").alias("base"),
    )


@query(
    "f5_integer_helpers",
    """SELECT p_partkey, (p_partkey + p_size - 1) // p_size AS ceiled,
      CASE WHEN p_partkey < 1 THEN 0 ELSE (1::BIGINT << (length(bin(p_partkey)) - 1)::INTEGER) END AS pow2 FROM part""",
)
def f5(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", ceil_div("p_partkey", "p_size").alias("ceiled"), floor_pow2("p_partkey").alias("pow2")
    )


# A peer list per order; the third octet runs to 299, so some entries are no addresses.
PEERS = """
WITH t AS (SELECT o_orderkey, o_custkey % 256 AS b, o_orderkey % 300 AS c, 8000 + o_orderkey % 1000 AS port FROM orders),
e AS (SELECT o_orderkey, 0::BIGINT AS rank, '10.' || b || '.' || c || '.7' AS host,
        10 * 16777216 + b * 65536 + c * 256 + 7 AS ipv4, port, c < 256 AS good FROM t
      UNION ALL SELECT o_orderkey, 1, '1.2.3.4', 16909060, 8080, true FROM t)
"""


def peer_lists(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.format_string(
            "10.%d.%d.7:%d,1.2.3.4:8080", F.col("o_custkey") % 256, F.col("o_orderkey") % 300, F.col("o_orderkey") % 1000 + 8000
        ).alias("peers"),
    )


@query(
    "p7_parse_peers",
    PEERS + "SELECT o_orderkey, rank, host, ipv4::BIGINT AS ipv4, port::BIGINT AS port, host AS back FROM e WHERE good",
)
def p7(spark, sf):
    peers, _ = parse_peers(peer_lists(spark, sf), "peers")
    return peers.drop("peers").withColumn("back", long_to_ipv4("ipv4"))


@query(
    "p7_peer_violations",
    PEERS + "SELECT o_orderkey, rank, host || ':' || port AS entry, 'not an ip:port address' AS reason FROM e WHERE NOT good",
)
def p7_violations(spark, sf):
    return parse_peers(peer_lists(spark, sf), "peers")[1].drop("peers")
