"""Placement over ``supplier`` as a ring of hosts, ``orders`` and ``lineitem`` as placed items."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardframe.operators import placement
from shardframe.plans.registry import query, table

# Hosts with a low balance have failed; 8 devices a host; copies j = 0..2 of host i sit on (i + j) mod n.
RING = """
WITH hosts AS (SELECT s_suppkey AS host_ord, s_acctbal < 2000 AS down, count(*) OVER () AS n FROM supplier),
copies AS (SELECT h.host_ord AS owner, j::BIGINT AS copy, (h.host_ord + j) % h.n AS host_ord
           FROM hosts h, (VALUES (0), (1), (2)) v(j)),
res AS (SELECT owner, arg_min(host_ord, copy) FILTER (NOT down) AS source, count(*) FILTER (NOT down) AS alive,
               bool_or(down AND copy = 0) AS owner_down
        FROM copies JOIN hosts USING (host_ord) GROUP BY owner),
items AS (SELECT o_orderkey AS item, (o_custkey * 7) % (8 * (SELECT count(*) FROM supplier)) AS device FROM orders)
"""


def hosts(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("host_ord"), F.col("s_name").alias("host"))


def failed(spark, sf):
    return table(spark, sf, "supplier").filter("s_acctbal < 2000").select(F.col("s_suppkey").alias("host_ord"))


def items(spark, sf):
    n = table(spark, sf, "supplier").agg(F.count(F.lit(1))).scalar()
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("item"), ((F.col("o_custkey") * 7) % (n * 8)).alias("device")
    )


@query("p2_replicas", RING + "SELECT owner, copy, host_ord FROM copies")
def p2(spark, sf):
    return placement.replicas(hosts(spark, sf), 2)


@query(
    "p3_resolve_source",
    RING
    + """SELECT item, device, device // 8 AS owner, source, source IS NULL AS unrecoverable
    FROM items LEFT JOIN res ON owner = device // 8""",
)
def p3(spark, sf):
    return placement.resolve_source(items(spark, sf), placement.replicas(hosts(spark, sf), 2), failed(spark, sf), 8)


@query(
    "p4_failure_impact",
    RING
    + """SELECT item, device // 8 AS owner, alive, alive > 0 AS recoverable
    FROM items JOIN res ON owner = device // 8 WHERE owner_down""",
)
def p4(spark, sf):
    owned = items(spark, sf).select("item", F.expr("device div 8").alias("owner"))
    return placement.failure_impact(owned, placement.replicas(hosts(spark, sf), 2), failed(spark, sf))


SNAPSHOTS = """
WITH l AS (SELECT l_suppkey AS host, l_linenumber::BIGINT AS port, l_partkey AS item FROM lineitem WHERE l_linestatus = 'O'),
r AS (SELECT l_suppkey AS host, l_linenumber::BIGINT AS port, l_partkey AS item FROM lineitem WHERE l_linestatus = 'F')
"""


def snapshots(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("host"),
        F.col("l_linenumber").cast("bigint").alias("port"),
        F.col("l_partkey").alias("item"),
        "l_linestatus",
    )
    return rows.filter("l_linestatus = 'O'"), rows.filter("l_linestatus = 'F'")


@query(
    "p5_placement_diff",
    SNAPSHOTS
    + """SELECT host, port, item, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right,
      CASE WHEN b.n IS NULL THEN 'only_left' WHEN a.n IS NULL THEN 'only_right' ELSE 'common' END AS side
    FROM (SELECT host, port, item, count(*) AS n FROM l GROUP BY ALL) a
    FULL OUTER JOIN (SELECT host, port, item, count(*) AS n FROM r GROUP BY ALL) b USING (host, port, item)""",
)
def p5(spark, sf):
    return placement.placement_diff(*snapshots(spark, sf))


@query(
    "p5_placement_relation",
    """WITH a AS (SELECT s_suppkey AS ord, s_name AS host, s_nationkey AS port, s_suppkey AS item FROM supplier),
    b AS (SELECT s_suppkey AS ord, s_name AS host, CASE WHEN s_acctbal < 0 THEN -1 ELSE s_nationkey END AS port, s_suppkey AS item FROM supplier)
    SELECT (SELECT bool_and(a.port = b.port) FROM a JOIN b USING (ord)) AS equal,
           NOT EXISTS (SELECT 1 FROM a JOIN b USING (host, port, item)) AS disjoint""",
)
def p5_relation(spark, sf):
    a = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("ord"), F.col("s_name").alias("host"), F.col("s_nationkey").alias("port"),
        F.col("s_suppkey").alias("item"), "s_acctbal",
    )
    b = a.withColumn("port", F.when(F.col("s_acctbal") < 0, -1).otherwise(F.col("port")))
    return placement.placement_relation(a, b, "ord")


@query(
    "p6_host_groups",
    """SELECT c_custkey AS rank, c_nationkey AS host, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS local_rank,
      count(*) OVER (PARTITION BY c_nationkey) AS local_size, min(c_custkey) OVER (PARTITION BY c_nationkey) AS master,
      (SELECT count(DISTINCT c_nationkey) FROM customer) AS host_count FROM customer""",
)
def p6(spark, sf):
    placed = table(spark, sf, "customer").select(F.col("c_custkey").alias("rank"), F.col("c_nationkey").alias("host"))
    return placement.host_groups(placed)
