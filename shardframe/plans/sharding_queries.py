"""Order, batches and shards over ``documents`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardframe.operators import index, sharding
from shardframe.operators.ordinal import running
from shardframe.plans.index_queries import IDX, document_index
from shardframe.plans.registry import query, table

SEED, GBS, DP, PROGRESS, MIN_SAMPLES = 1234, 23, 4, 100, 50

# Seeded order, batches from PROGRESS on, ranks and files in SQL.
SHARDS = f"""
WITH ord AS (
  SELECT row_number() OVER (ORDER BY md5('{SEED}:' || doc_id), doc_id) - 1 AS position, doc_id AS sample_id,
         count(*) OVER () AS n_samples, n_chars + 16 AS length FROM documents),
cut AS (
  SELECT *, (position - {PROGRESS}) // {GBS} AS batch, (position - {PROGRESS}) % {GBS} AS k
  FROM ord WHERE position >= {PROGRESS}),
kept AS (SELECT * FROM cut WHERE batch < (n_samples - {PROGRESS}) // {GBS}),
shards AS (
  SELECT batch, k // 6 AS dp_rank, k AS pos_in_batch, k % 6 AS pos_in_rank, sample_id, length FROM kept),
files AS (
  SELECT *, batch // (CASE WHEN dp_rank = 3 THEN 10 ELSE 9 END) AS file_id FROM shards)
"""


def documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (F.col("n_chars") + 16).alias("length"))


def order_of(spark, sf):
    return sharding.sample_order(documents(spark, sf), "doc_id", SEED)


def assigned(spark, sf):
    return sharding.assign_shards(documents(spark, sf), "doc_id", GBS, DP, PROGRESS, SEED, job="docs")


def packed(spark, sf):
    return sharding.pack_shard_files(assigned(spark, sf), GBS, DP, MIN_SAMPLES)


def lengths(spark, sf):
    return documents(spark, sf).withColumnRenamed("doc_id", "sample_id")


@query(
    "d1_sample_order",
    """SELECT row_number() OVER (ORDER BY md5('7:' || (l_orderkey * 8 + l_linenumber)), l_orderkey * 8 + l_linenumber) - 1 AS position,
       l_orderkey * 8 + l_linenumber AS sample_id, count(*) OVER () AS n_samples
    FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)""",
)
def d1(spark, sf):
    lines = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")).distinct()
    return sharding.sample_order(lines, "id", 7)


@query(
    "d1_identity_order",
    """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS position, o_orderkey AS sample_id,
       count(*) OVER () AS n_samples FROM orders""",
)
def d1_identity(spark, sf):
    return sharding.sample_order(table(spark, sf, "orders"), "o_orderkey")


@query(
    "d2_global_batches",
    f"""WITH ord AS (SELECT row_number() OVER (ORDER BY md5('{SEED}:' || doc_id), doc_id) - 1 AS position,
        doc_id AS sample_id, count(*) OVER () AS n FROM documents)
    SELECT sample_id, position // 64 AS batch, position % 64 AS pos_in_batch,
           least(64, n - position // 64 * 64) AS batch_size FROM ord""",
)
def d2(spark, sf):
    cut = sharding.global_batches(order_of(spark, sf), 64, drop_last=False)
    return cut.select("sample_id", "batch", "pos_in_batch", "batch_size")


@query("d3_resume_progress", SHARDS + "SELECT sample_id, batch, k AS pos_in_batch FROM kept")
def d3(spark, sf):
    cut = sharding.global_batches(order_of(spark, sf), GBS, PROGRESS)
    return cut.select("sample_id", "batch", "pos_in_batch")


@query(
    "d4_shard_batches",
    """WITH ord AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS p, o_orderkey AS sample_id, count(*) OVER () AS n FROM orders),
    cut AS (SELECT *, p // 64 AS batch, p % 64 AS k, least(64, n - p // 64 * 64) AS size FROM ord)
    SELECT sample_id, batch, k // ((size + 4) // 5) AS dp_rank, k % ((size + 4) // 5) AS pos_in_rank FROM cut""",
)
def d4(spark, sf):
    order = sharding.sample_order(table(spark, sf, "orders"), "o_orderkey")
    cut = sharding.shard_batches(sharding.global_batches(order, 64, drop_last=False), 5)
    return cut.select("sample_id", "batch", "dp_rank", "pos_in_rank")


@query(
    "d5_assign_shards",
    SHARDS
    + f"""SELECT 'docs' AS job, {PROGRESS}::BIGINT AS progress, {DP}::BIGINT AS dp_size, batch, dp_rank, pos_in_batch,
      pos_in_rank, sample_id FROM shards""",
)
def d5(spark, sf):
    return assigned(spark, sf)


@query(
    "d6_batch_size_runs",
    """WITH ord AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders),
    cut AS (SELECT p // 64 AS batch, p % 64 AS k, least(64, n - p // 64 * 64) AS size FROM ord),
    sizes AS (SELECT k // ((size + 4) // 5) AS dp_rank, batch, count(*) AS batch_size FROM cut GROUP BY 1, 2),
    isl AS (SELECT *, row_number() OVER (PARTITION BY dp_rank ORDER BY batch)
                  - row_number() OVER (PARTITION BY dp_rank, batch_size ORDER BY batch) AS g FROM sizes),
    runs AS (SELECT dp_rank, batch_size, g, min(batch) AS b, count(*) AS "count" FROM isl GROUP BY 1, 2, 3)
    SELECT dp_rank, row_number() OVER (PARTITION BY dp_rank ORDER BY b) - 1 AS run, batch_size, "count" FROM runs""",
)
def d6(spark, sf):
    order = sharding.sample_order(table(spark, sf, "orders"), "o_orderkey")
    return sharding.batch_size_runs(sharding.shard_batches(sharding.global_batches(order, 64, drop_last=False), 5))


@query(
    "d6_parse_runs",
    """SELECT l_orderkey AS job, l_linenumber::BIGINT * 2 - 2 + u.run AS run,
      CASE WHEN u.run = 0 THEN l_quantity::BIGINT ELSE l_linenumber::BIGINT END AS batch_size,
      CASE WHEN u.run = 0 THEN l_partkey ELSE l_suppkey END AS "count"
    FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS l_linenumber,
                 l_quantity, l_partkey, l_suppkey FROM lineitem), (VALUES (0), (1)) u(run)""",
)
def d6_parse(spark, sf):
    # One text of "size count" lines per order, two lines for each of its items (an order has few items).
    lines = table(spark, sf, "lineitem")
    ranked = running(
        lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"),
        ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"],
        ["l_orderkey"],
        position="item",
    )
    text = F.format_string(
        "%d %d\n%d %d\n", F.col("l_quantity").cast("bigint"), "l_partkey", F.col("item") + 1, "l_suppkey"
    )
    texts = ranked.select(F.col("l_orderkey").alias("job"), "item", text.alias("text"))
    parsed = sharding.parse_runs(texts, "text")
    return parsed.select("job", (F.col("item") * 2 + F.col("run")).alias("run"), "batch_size", "count")


@query(
    "d7_dropped_samples",
    SHARDS + f"SELECT position, sample_id FROM cut WHERE batch >= (n_samples - {PROGRESS}) // {GBS}",
)
def d7(spark, sf):
    return sharding.dropped_samples(order_of(spark, sf), GBS, PROGRESS)


@query(
    "d8_pack_shard_files",
    SHARDS
    + """SELECT dp_rank, file_id, lpad(file_id::VARCHAR, 4, '0') || '.tf_record' AS filename, count(*) AS n_samples,
      sum(length)::BIGINT AS bytes FROM files GROUP BY 1, 2, 3""",
)
def d8(spark, sf):
    return sharding.shard_files(packed(spark, sf), lengths(spark, sf)).drop("job", "progress", "dp_size")


@query(
    "d9_shard_index",
    SHARDS
    + """SELECT dp_rank, file_id, row_number() OVER w - 1 AS ord, sample_id,
      (sum(length) OVER w - length)::BIGINT AS "begin", (sum(length) OVER w)::BIGINT AS "end"
    FROM files WINDOW w AS (PARTITION BY dp_rank, file_id ORDER BY batch, pos_in_rank)""",
)
def d9(spark, sf):
    return sharding.shard_index(packed(spark, sf), lengths(spark, sf))


@query(
    "d10_manifests",
    SHARDS
    + f""", f AS (SELECT DISTINCT dp_rank, file_id FROM files),
    p AS (SELECT '/job/docs/progress/{PROGRESS}/cluster-of-{DP}' AS root, '/job/docs/progress-{PROGRESS}-cluster-of-{DP}.txt' AS list),
    r AS (SELECT unnest(range({DP})) AS dp_rank),
    d AS (SELECT dp_rank, root || '/rank-' || lpad(dp_rank::VARCHAR, 3, '0') AS dir FROM r, p)
    SELECT dir || '/list.txt' AS path, file_id AS line_no, dir || '/' || lpad(file_id::VARCHAR, 4, '0') || '.tf_record' AS line
      FROM f JOIN d USING (dp_rank)
    UNION ALL SELECT list, dp_rank, dir FROM d, p
    UNION ALL SELECT root || '/global-batch-size.txt', 0, '{GBS}' FROM p
    UNION ALL SELECT '/job/docs/head.txt', 0, list FROM p
    UNION ALL SELECT '/job/docs/cluster-prefix.txt', 0, root FROM p
    UNION ALL SELECT '/job/docs/order.txt', position, sample_id::VARCHAR FROM ord
    UNION ALL SELECT dir || '/' || lpad(file_id::VARCHAR, 4, '0') || '.tf_record.meta',
      row_number() OVER (PARTITION BY dp_rank, file_id ORDER BY batch, pos_in_rank) - 1, sample_id::VARCHAR FROM files JOIN d USING (dp_rank)
    UNION ALL SELECT dir || '/batch-sizes.txt', 0, size || ' ' || count(*) FROM
      (SELECT dp_rank, batch, count(*) AS size FROM shards GROUP BY 1, 2) JOIN d USING (dp_rank) GROUP BY dir, size
    UNION ALL SELECT dir || '/dropped.txt', 0, ((SELECT count(*) FROM documents) - {PROGRESS}) % {GBS} || '' FROM d
    UNION ALL SELECT dir || '/dropped-ids.txt', row_number() OVER (PARTITION BY dir ORDER BY position) - 1, sample_id::VARCHAR
      FROM cut, d WHERE batch >= (n_samples - {PROGRESS}) // {GBS}""",
)
def d10(spark, sf):
    return sharding.manifests(packed(spark, sf), GBS, order_of(spark, sf))


@query(
    "d10_resolve_head",
    """SELECT o_custkey AS job, arg_max(o_orderpriority, o_orderkey) AS head, max(o_orderkey) AS version
    FROM orders GROUP BY o_custkey""",
)
def d10_head(spark, sf):
    heads = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("job"), F.col("o_orderpriority").alias("prefix"), F.col("o_orderkey").alias("version")
    )
    return sharding.resolve_head(heads)


@query(
    "d11_modulo_shards",
    "SELECT o_orderkey, (o_orderkey % 23) // 6 AS dp_rank FROM orders",
)
def d11(spark, sf):
    return sharding.modulo_shards(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 23, 4)


@query(
    "d13_verify_shards",
    SHARDS
    + """SELECT dp_rank, count(*) AS n_read, count(*) AS n_expected, true AS ok FROM shards GROUP BY dp_rank""",
)
def d13(spark, sf):
    shards = assigned(spark, sf)
    return sharding.verify_shards(shards, sharding.batch_size_runs(shards))


# A job per customer: every order is a schedule point, the step its rank by key, sizes 0, 4, 8, 12, 16 by priority.
JOBS = """
WITH pts AS (
  SELECT o_custkey AS job, o_orderkey AS step,
         (CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 4 WHEN '3' THEN 8 WHEN '4' THEN 12 ELSE 16 END)::BIGINT AS size
  FROM orders),
nxt AS (SELECT *, row_number() OVER w - 1 AS stage, coalesce(lead(step) OVER w, 100000000) AS end_step FROM pts
        WINDOW w AS (PARTITION BY job ORDER BY step)),
conf AS (SELECT c_custkey AS job, s::BIGINT AS size, 2 AS mp, s::BIGINT // 4 AS dp, CASE WHEN s = 8 AND c_custkey % 5 = 0 THEN 3 ELSE 2 END AS pp
         FROM customer, (VALUES (4), (8), (16)) v(s))
"""


def jobs(spark, sf):
    first = F.substring("o_orderpriority", 1, 1)
    size = F.when(first == "1", 0).when(first == "2", 4).when(first == "3", 8).when(first == "4", 12).otherwise(16)
    points = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("step"), size.cast("bigint").alias("size")
    )
    keys = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("job"), F.explode(F.expr("array(4L, 8L, 16L)")).alias("size")
    )
    pp = F.when((F.col("size") == 8) & (F.col("job") % 5 == 0), 3).otherwise(2)
    configs = keys.select(
        "job", "size", F.lit(2).cast("bigint").alias("mp"), F.expr("size div 4").alias("dp"), pp.cast("bigint").alias("pp")
    )
    return points, configs


def scaled_jobs(spark, sf):
    """The jobs with the keys of all orders spread over the steps that the documents make."""
    points, configs = jobs(spark, sf)
    steps = documents(spark, sf).count() // 8
    keys = table(spark, sf, "orders").agg(F.coalesce(F.max("o_orderkey"), F.lit(0)).alias("k")).first()["k"] + 1
    return points.withColumn("step", F.expr(f"step * {steps}L div {keys}L")).groupBy("job", "step").agg(F.max("size").alias("size")), configs


@query(
    "d15_stage_plan",
    JOBS
    + """SELECT job, stage, step AS start_step, end_step, step * 128 AS progress, size, mp::BIGINT AS mp, pp::BIGINT AS pp, dp AS dp_size
    FROM nxt JOIN conf USING (job, size) WHERE size = mp * dp * pp""",
)
def d15(spark, sf):
    points, configs = jobs(spark, sf)
    return sharding.stage_plan(points, configs, 128, last_step=100000000)[0]


@query(
    "d15_stage_violations",
    JOBS
    + """SELECT job, size::BIGINT AS size, CASE WHEN mp IS NULL THEN 'size not configured' ELSE 'degrees do not multiply to size' END AS reason
    FROM nxt LEFT JOIN conf USING (job, size) WHERE size <> 0 AND (mp IS NULL OR size <> mp * dp * pp)""",
)
def d15_violations(spark, sf):
    points, configs = jobs(spark, sf)
    return sharding.stage_plan(points, configs, 128, last_step=100000000)[1]


# Steps [0, 50) and [50, 90) of batch 8; the second stage wrongly starts again at sample 120.
@query(
    "d16_rescale_audit",
    """WITH ord AS (SELECT row_number() OVER (ORDER BY md5('1234:' || doc_id), doc_id) - 1 AS position, doc_id AS sample_id,
                    count(*) OVER () AS n FROM documents),
    st AS (SELECT 0 AS lo, (n // 20) * 8 AS hi, (n // 20 + n // 40) * 8 AS ext FROM ord LIMIT 1),
    t AS (SELECT position, sample_id, (CASE WHEN position < hi THEN 1 ELSE 0 END)
          + (CASE WHEN position >= 120 AND position < 120 + ext - hi THEN 1 ELSE 0 END) AS times, ext FROM ord, st)
    SELECT 'docs' AS job, position, sample_id, times::BIGINT AS times FROM t WHERE position < ext AND times <> 1""",
)
def d16(spark, sf):
    n = F.count(F.lit(1))
    docs = documents(spark, sf)
    a, b = F.floor(n / 20).cast("bigint"), F.floor(n / 40).cast("bigint")
    zero = F.lit(0).cast("bigint")
    stages = docs.agg(
        F.array(
            F.struct(zero.alias("stage"), zero.alias("progress"), zero.alias("start_step"), a.alias("end_step")),
            F.struct((zero + 1).alias("stage"), (zero + 120).alias("progress"), a.alias("start_step"), (a + b).alias("end_step")),
        ).alias("s")
    ).selectExpr("inline(s)").withColumn("job", F.lit("docs"))
    return sharding.rescale_audit(stages, order_of(spark, sf), 8)


# The stages of every customer's job, as the plan gives them, against the order of the documents: steps that a job
# doesn't cover are missing, and so are the samples of stages that couldn't be planned. The keys of all orders are spread over the steps that
# the documents make; of points that fall on one step the largest counts.
@query(
    "d16_all_jobs",
    """WITH n AS (SELECT count(*) AS n, count(*) // 8 AS steps FROM documents), k AS (SELECT max(o_orderkey) + 1 AS k FROM orders),
    pts AS (SELECT o_custkey AS job, o_orderkey * steps // k AS step, max((CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 4 WHEN '3' THEN 8 WHEN '4' THEN 12 ELSE 16 END))::BIGINT AS size
            FROM orders, n, k GROUP BY ALL),
    nxt AS (SELECT *, coalesce(lead(step) OVER (PARTITION BY job ORDER BY step), (SELECT steps FROM n)) AS until FROM pts),
    st AS (SELECT job, step * 8 AS lo, until * 8 AS hi FROM nxt WHERE size IN (4, 8, 16) AND NOT (size = 8 AND job % 5 = 0)),
    ext AS (SELECT job, least(max(hi), n) AS ext FROM st, n GROUP BY job, n),
    p AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents),
    t AS (SELECT ext.job, p.position, count(st.lo) AS times FROM ext JOIN p ON p.position < ext.ext
          LEFT JOIN st ON st.job = ext.job AND p.position >= st.lo AND p.position < st.hi GROUP BY 1, 2)
    SELECT job, times, count(*) AS samples, sum(position)::BIGINT AS positions FROM t WHERE times <> 1 GROUP BY 1, 2""",
)
def d16_jobs(spark, sf):
    points, configs = scaled_jobs(spark, sf)
    steps = documents(spark, sf).count() // 8
    stages, _ = sharding.stage_plan(points, configs, 8, last_step=steps)
    return sharding.rescale_audit(stages, order_of(spark, sf), 8, totals=True)


# Regions of each file that the stages of every customer's job read together: counts at the ends of what a job's stages cover, and for regions that
# lie at several places of the order a bitmap for each stage and file, and their unions for the jobs.
@query(
    "i9_job_coverage",
    IDX
    + """, n AS (SELECT count(*) AS n, count(*) // 8 AS steps FROM documents), k AS (SELECT max(o_orderkey) + 1 AS k FROM orders),
    pts AS (SELECT o_custkey AS job, o_orderkey * steps // k AS step, max((CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 4 WHEN '3' THEN 8 WHEN '4' THEN 12 ELSE 16 END))::BIGINT AS size
            FROM orders, n, k GROUP BY ALL),
    nxt AS (SELECT *, coalesce(lead(step) OVER (PARTITION BY job ORDER BY step), (SELECT steps FROM n)) AS until FROM pts),
    st AS (SELECT job, step * 8 AS lo, until * 8 AS hi FROM nxt WHERE size IN (4, 8, 16) AND NOT (size = 8 AND job % 5 = 0)),
    ord AS (SELECT row_number() OVER (ORDER BY md5('1234:' || doc_id), doc_id) - 1 AS position, doc_id FROM documents),
    total AS (SELECT file_ord, count(*) AS regions FROM idx GROUP BY file_ord)
    SELECT job, file_ord, regions, count(DISTINCT range_ord) AS covered
    FROM st JOIN ord ON position >= lo AND position < hi JOIN idx USING (doc_id) JOIN total USING (file_ord) GROUP BY ALL""",
)
def i9_jobs(spark, sf):
    points, configs = scaled_jobs(spark, sf)
    steps = documents(spark, sf).count() // 8
    stages, _ = sharding.stage_plan(points, configs, 8, last_step=steps)
    idx = document_index(spark, sf)
    regions = idx.select(F.col("doc_id").alias("sample_id"), "file_ord", F.col("range_ord").alias("region"))
    ordered = order_of(spark, sf).join(regions, "sample_id")
    spans = stages.select("job", "stage", F.col("progress").alias("lo"), (F.col("end_step") * 8).alias("hi"))
    return index.span_coverage(ordered, spans, index.file_counts(idx), ["job"], "stage")
