"""Index operators over ``documents``: a file per source, a record of ``n_chars + 16`` bytes per document."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardframe.operators import index
from shardframe.operators.ordinal import running
from shardframe.plans.registry import query, table


def document_index(spark, sf):
    """``documents`` as an index, with ``doc_id`` kept."""
    docs = table(spark, sf, "documents").select("source", "doc_id", (F.col("n_chars") + 16).alias("size"))
    files = running(docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")), ["source"], position="file_ord")
    placed = running(docs, ["doc_id"], ["source"], sums={"begin": F.col("size")}, position="range_ord")
    blocks = files.withColumn("_block", F.explode(F.expr(f"sequence(0L, (n - 1) div {index.BLOCK}L)")))
    joined = placed.withColumn("_block", F.expr(f"range_ord div {index.BLOCK}L")).join(blocks, ["source", "_block"])
    return joined.select(
        "file_ord",
        F.concat(F.lit("/data/"), F.col("source"), F.lit(".rec")).alias("path"),
        "range_ord",
        "begin",
        (F.col("begin") + F.col("size")).alias("end"),
        "doc_id",
    )


# The same index in SQL; `idx` is used by every query below.
IDX = """
WITH idx AS (
  SELECT CAST(dense_rank() OVER (ORDER BY source) - 1 AS BIGINT) AS file_ord,
         '/data/' || source || '.rec' AS path,
         CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS range_ord,
         CAST(sum(n_chars + 16) OVER (PARTITION BY source ORDER BY doc_id) - (n_chars + 16) AS BIGINT) AS "begin",
         CAST(sum(n_chars + 16) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS "end",
         doc_id
  FROM documents),
named AS (
  SELECT *, CAST(row_number() OVER (ORDER BY file_ord, range_ord) - 1 AS BIGINT) AS sample_id FROM idx),
placed AS (
  SELECT *, CAST(sum("end" - "begin") OVER (ORDER BY file_ord, range_ord) AS BIGINT) AS stop,
         CAST(sum("end" - "begin") OVER (ORDER BY file_ord, range_ord) AS BIGINT) - ("end" - "begin") AS start
  FROM idx)
"""


@query("i1_named_ranges", IDX + 'SELECT file_ord, path, range_ord, "begin", "end", doc_id, sample_id FROM named')
def i1(spark, sf):
    return index.named_ranges(document_index(spark, sf))


@query(
    "i2_select_ranges",
    IDX
    + """, ids AS (SELECT event_id AS position, user_id AS sample_id FROM events)
    SELECT position, sample_id, path, "begin", "end" FROM ids JOIN named USING (sample_id)""",
)
def i2(spark, sf):
    ids = table(spark, sf, "events").select(F.col("event_id").alias("position"), F.col("user_id").alias("sample_id"))
    ranges = index.named_ranges(document_index(spark, sf))
    return index.select_ranges(ranges, ids)[0].select("position", "sample_id", "path", "begin", "end")


@query(
    "i2_unknown_ids",
    IDX
    + """, ids AS (SELECT event_id AS position, event_id % 1500 AS sample_id FROM events)
    SELECT position, sample_id, 'unknown sample' AS reason FROM ids WHERE sample_id NOT IN (SELECT sample_id FROM named)""",
)
def i2_unknown(spark, sf):
    ids = table(spark, sf, "events").select(F.col("event_id").alias("position"), (F.col("event_id") % 1500).alias("sample_id"))
    return index.select_ranges(index.named_ranges(document_index(spark, sf)), ids)[1]


# Ids of which a tenth lie beyond the index at every size.
FAR = IDX + """, n AS (SELECT count(*) AS n FROM documents),
ids AS (SELECT event_id AS position, CASE WHEN event_id % 10 = 0 THEN event_id + n ELSE event_id % n END AS sample_id FROM events, n)
"""


def far_ids(spark, sf):
    n, at = F.lit(table(spark, sf, "documents").count()), F.col("event_id")
    return table(spark, sf, "events").select(at.alias("position"), F.when(at % 10 == 0, at + n).otherwise(at % n).alias("sample_id"))


@query(
    "i2_far_ids",
    FAR + "SELECT position, sample_id, 'unknown sample' AS reason FROM ids WHERE sample_id NOT IN (SELECT sample_id FROM named)",
)
def i2_far(spark, sf):
    return index.select_ranges(index.named_ranges(document_index(spark, sf)), far_ids(spark, sf))[1]


@query(
    "i3_index_stats",
    IDX
    + """SELECT path, CAST(count(*) AS BIGINT) AS n_ranges, CAST(sum("end" - "begin") AS BIGINT) AS indexed_bytes
    FROM idx GROUP BY ROLLUP (path)""",
)
def i3(spark, sf):
    return index.index_stats(document_index(spark, sf))


@query(
    "i4_take_files",
    IDX + 'SELECT file_ord, path, range_ord, "begin", "end" FROM idx WHERE file_ord < 7',
)
def i4(spark, sf):
    return index.take_files(document_index(spark, sf), 7).drop("doc_id")


@query(
    "i5_set_host",
    r"""SELECT page_id,
      regexp_extract(url, '^([a-z]+):', 1) || '://store.example:81' || regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) AS hosted,
      regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) AS localised,
      CASE WHEN instr(url, 'th') > 0
           THEN substr(url, 1, instr(url, 'th') - 1) || 'TH/' || substr(url, instr(url, 'th') + 2) ELSE url END AS rebased
    FROM pages""",
)
def i5(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", F.col("url").alias("path"))
    hosted = index.set_host(pages, "store.example:81").withColumnRenamed("path", "hosted")
    local = index.set_host(hosted.withColumn("path", F.col("url")), "").withColumnRenamed("path", "localised")
    rebased = index.rebase_paths(local.withColumn("path", F.col("url")), "th", "TH/")
    return rebased.select("page_id", "hosted", "localised", F.col("path").alias("rebased"))


@query(
    "i6_localize_index",
    r"""WITH src AS (
      SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url
        WHEN page_id % 3 = 1 THEN 'file://' || regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)
        ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END AS path FROM pages)
    SELECT 'served' AS outcome, 'http://h1:9000' || regexp_extract(path, '^(file://)?(.*)$', 2) AS path,
           CAST(count(*) AS BIGINT) AS n FROM src WHERE page_id % 3 <> 0 GROUP BY 1, 2
    UNION ALL SELECT 'non-local file', path, CAST(count(*) AS BIGINT) FROM src WHERE page_id % 3 = 0 GROUP BY 1, 2""",
)
def i6(spark, sf):
    plain = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    mixed = (
        F.when(F.col("page_id") % 3 == 0, F.col("url"))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit("file://"), plain))
        .otherwise(plain)
    )
    served, bad = index.localize_index(table(spark, sf, "pages").select(mixed.alias("path")), "h1:9000")
    ok = served.groupBy("path").agg(F.count(F.lit(1)).alias("n")).select(F.lit("served").alias("outcome"), "path", "n")
    return ok.unionByName(bad.select(F.col("reason").alias("outcome"), "path", F.col("n_ranges").alias("n")))


@query(
    "i7_check_index",
    IDX
    + """, indexed AS (SELECT path, sum("end" - "begin") AS b FROM idx GROUP BY path),
    files AS (SELECT '/data/' || source || '.rec' AS path,
                     sum(n_chars) + 16 * count(*) + CASE WHEN source = 'src3' THEN 1 ELSE 0 END AS size
              FROM documents WHERE source <> 'src5' GROUP BY source
              UNION ALL SELECT '/data/' || c_mktsegment || '.rec', count(*) FROM customer GROUP BY c_mktsegment)
    SELECT path, CAST(b AS BIGINT) AS indexed_bytes, CAST(size AS BIGINT) AS size,
      CASE WHEN size IS NULL THEN 'missing file' WHEN b IS NULL THEN 'not indexed'
           WHEN size <> b THEN 'size mismatch' ELSE 'ok' END AS status, true AS same_domain
    FROM indexed FULL OUTER JOIN files USING (path)""",
)
def i7(spark, sf):
    docs = table(spark, sf, "documents")
    extra = F.when(F.col("source") == "src3", 1).otherwise(0)
    sizes = docs.filter("source <> 'src5'").groupBy("source").agg(F.sum(F.col("n_chars") + 16).alias("size"))
    files = sizes.select(F.concat(F.lit("/data/"), "source", F.lit(".rec")).alias("path"), (F.col("size") + extra).alias("size"))
    stray = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("size"))
    files = files.unionByName(stray.select(F.concat(F.lit("/data/"), "c_mktsegment", F.lit(".rec")).alias("path"), "size"))
    return index.check_index(document_index(spark, sf), files)


# Windows to locate: one per order, at 1000 * key, of a few thousand bytes.
@query(
    "i8_locate",
    IDX
    + """, reqs AS (SELECT o_orderkey AS request, o_orderkey * 1000 AS pos,
                     o_orderkey * 1000 + 2000 + (o_custkey % 100) * 50 AS until FROM orders)
    SELECT request, greatest(pos, start) AS at, path,
           "begin" + greatest(pos, start) - start AS "begin", "begin" + least(until, stop) - start AS "end"
    FROM reqs JOIN placed ON pos < stop AND start < until""",
)
def i8(spark, sf):
    requests = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request"),
        (F.col("o_orderkey") * 1000).alias("pos"),
        (F.lit(2000) + (F.col("o_custkey") % 100) * 50).alias("length"),
    )
    return index.locate(index.logical_ranges(document_index(spark, sf)), requests)


# Windows of one byte to a gigabyte, a power of two by the order's key; many reach far past the end.
@query(
    "i8_locate_all_scales",
    IDX
    + """, reqs AS (SELECT o_orderkey AS request, o_orderkey * 100 AS pos, o_orderkey * 100 + (1::BIGINT << CASE WHEN o_orderkey % 50 = 0 THEN (o_custkey % 31)::INTEGER ELSE (o_custkey % 12)::INTEGER END) AS until FROM orders)
    SELECT request, count(*) AS segments, min(greatest(pos, start)) AS at, sum(least(until, stop) - greatest(pos, start))::BIGINT AS bytes
    FROM reqs JOIN placed ON pos < stop AND start < until GROUP BY request""",
)
def i8_scales(spark, sf):
    power = F.when(F.col("o_orderkey") % 50 == 0, F.col("o_custkey") % 31).otherwise(F.col("o_custkey") % 12)
    requests = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request"), (F.col("o_orderkey") * 100).alias("pos"), F.expr("1L").alias("one"), power.cast("int").alias("power")
    ).select("request", "pos", F.expr("shiftleft(one, power)").alias("length"))
    found = index.locate(index.logical_ranges(document_index(spark, sf)), requests)
    return found.groupBy("request").agg(
        F.count(F.lit(1)).alias("segments"), F.min("at").alias("at"), F.sum(F.col("end") - F.col("begin")).alias("bytes")
    )


@query(
    "i9_region_coverage",
    IDX
    + """, hit AS (SELECT DISTINCT user_id AS sample_id FROM events)
    SELECT file_ord, CAST(count(*) AS BIGINT) AS regions, CAST(count(hit.sample_id) AS BIGINT) AS covered
    FROM named LEFT JOIN hit USING (sample_id) GROUP BY file_ord""",
)
def i9(spark, sf):
    regions = index.region_map(document_index(spark, sf))
    ids = table(spark, sf, "events").select(F.col("user_id").alias("sample_id"))
    return index.region_coverage(regions, ids)


@query(
    "i9_region_totals",
    IDX
    + """SELECT CAST(count(*) AS BIGINT) AS n_files, CAST(max(n) AS BIGINT) AS max_regions,
      CAST(sum(n) AS BIGINT) AS total_regions FROM (SELECT count(*) AS n FROM idx GROUP BY file_ord)""",
)
def i9_totals(spark, sf):
    return index.region_totals(document_index(spark, sf))


@query(
    "d12_index_shard",
    IDX
    + """, sized AS (SELECT *, (SELECT (count(*) + 6) // 7 FROM documents) AS c FROM named)
    SELECT sample_id, path, "begin", "end" FROM sized WHERE sample_id >= 2 * c AND sample_id < 3 * c""",
)
def d12(spark, sf):
    ranges = index.named_ranges(document_index(spark, sf))
    return index.index_shard(ranges, 2, 7).select("sample_id", "path", "begin", "end")


@query(
    "d14_lookup_samples",
    IDX
    + """, chunked AS (SELECT sample_id // 32 AS file_ord, sample_id % 32 AS range_ord, "begin", "end" FROM named)
    SELECT event_id AS position, user_id AS sample_id, file_ord, range_ord, "begin", "end" - "begin" AS size
    FROM events JOIN chunked ON file_ord = user_id // 32 AND range_ord = user_id % 32""",
)
def d14(spark, sf):
    ranges = index.named_ranges(document_index(spark, sf))
    files = ranges.select(
        F.expr("sample_id div 32L").alias("file_ord"), F.expr("sample_id % 32L").alias("range_ord"), "path", "begin", "end"
    )
    ids = table(spark, sf, "events").select(F.col("event_id").alias("position"), F.col("user_id").alias("sample_id"))
    return index.lookup_samples(files, ids, 32)[0].drop("path")


@query(
    "d14_unknown_samples",
    IDX
    + """SELECT event_id AS position, event_id % 1500 AS sample_id, 'unknown sample' AS reason
    FROM events WHERE event_id % 1500 NOT IN (SELECT sample_id FROM named)""",
)
def d14_unknown(spark, sf):
    ranges = index.named_ranges(document_index(spark, sf))
    files = ranges.select(
        F.expr("sample_id div 32L").alias("file_ord"), F.expr("sample_id % 32L").alias("range_ord"), "path", "begin", "end"
    )
    ids = table(spark, sf, "events").select(F.col("event_id").alias("position"), (F.col("event_id") % 1500).alias("sample_id"))
    return index.lookup_samples(files, ids, 32)[1]


@query(
    "d14_far_samples",
    FAR + "SELECT position, sample_id, 'unknown sample' AS reason FROM ids WHERE sample_id NOT IN (SELECT sample_id FROM named)",
)
def d14_far(spark, sf):
    ranges = index.named_ranges(document_index(spark, sf))
    files = ranges.select(
        F.expr("sample_id div 32L").alias("file_ord"), F.expr("sample_id % 32L").alias("range_ord"), "path", "begin", "end"
    )
    return index.lookup_samples(files, far_ids(spark, sf), 32)[1]
