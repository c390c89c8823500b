"""Orders as jobs: open at the order date, finished by the last ship date."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardframe.operators import allocation
from shardframe.plans.registry import query, table


@query(
    "a4_equal_shares",
    """WITH j AS (SELECT o_orderkey AS job, datediff('day', DATE '1970-01-01', o_orderdate::DATE) AS arrive,
          greatest(datediff('day', DATE '1970-01-01', o_orderdate::DATE) + 1, (SELECT max(datediff('day', DATE '1970-01-01', l_shipdate::DATE))
             FROM lineitem WHERE l_orderkey = o_orderkey)) AS finish,
          EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS shipped FROM orders),
    ev AS (SELECT job, arrive AS time, 1 AS delta FROM j UNION ALL SELECT job, finish, -1 FROM j WHERE shipped),
    run AS (SELECT *, row_number() OVER w - 1 AS event, sum(delta) OVER w AS active FROM ev WINDOW w AS (ORDER BY time, delta, job)),
    sh AS (SELECT *, CASE WHEN active > 0 AND 32768 // active > 0 THEN 1 << (length(bin((32768 // active)::BIGINT)) - 1)::INTEGER ELSE 0 END AS share FROM run)
    SELECT job, time::BIGINT AS time, delta::BIGINT AS delta, event, active::BIGINT AS active, share::BIGINT AS share,
      share::BIGINT // 8 AS hosts, (32768 - share * active)::BIGINT AS idle,
      CASE WHEN delta > 0 THEN (active - 1)::BIGINT END AS slot,
      CASE WHEN delta > 0 THEN (active - 1)::BIGINT * (share::BIGINT // 8) END AS host_lo,
      CASE WHEN delta > 0 THEN active::BIGINT * (share::BIGINT // 8) END AS host_hi FROM sh""",
)
def a4(spark, sf):
    def day(c):
        return F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")

    shipped = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("job")).agg(F.max(day("l_shipdate")).alias("shipped"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job"), day("o_orderdate").alias("arrive"))
    jobs = orders.join(shipped, "job", "left").select(
        "job", "arrive", F.when(F.col("shipped").isNotNull(), F.greatest(F.col("arrive") + 1, "shipped")).alias("finish")
    )
    return allocation.equal_shares(jobs, 4096, 8)
