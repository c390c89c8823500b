"""The URL filter's query: captures and dated lists derived from ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardframe.llm import url_filter
from shardframe.llm.registry import query
from shardframe.llm.shared import table

# The digits of a pattern's MD5 tell its list, the dates of its entries, and which entries it has.
OP7_SQL = r"""
WITH seen AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id * 7919 % 366 AS INTEGER) AS DATE) AS fetched_on,
         lower(regexp_replace(regexp_replace(regexp_replace(
           regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.$', '')) AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS segs
  FROM pages),
patterns AS (
  SELECT DISTINCT 'host' AS kind, host AS pattern FROM seen WHERE host <> ''
  UNION SELECT DISTINCT 'domain', array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') FROM seen WHERE host <> ''
  UNION SELECT DISTINCT 'prefix', host || '/' || segs[1] FROM seen WHERE host <> '' AND len(segs) > 0),
digits AS (
  SELECT kind, pattern, [instr('0123456789abcdef', c) - 1 FOR c IN string_split(substr(md5(kind || ':' || pattern), 1, 8), '')] AS d
  FROM patterns),
dates AS (
  SELECT kind, pattern, d, CASE d[2] % 3 WHEN 0 THEN 'adult' WHEN 1 THEN 'malware' ELSE 'spam' END AS list,
         CAST(DATE '2024-01-01' + CAST(d[3] * 16 + d[4] AS INTEGER) AS DATE) AS added
  FROM digits WHERE d[1] < 6),
entries AS (
  SELECT list, kind, pattern, 'add' AS action, added AS dated FROM dates
  UNION ALL SELECT list, kind, pattern, 'remove', CAST(added + CAST(20 + d[5] * 10 AS INTEGER) AS DATE) FROM dates WHERE d[6] < 10
  UNION ALL SELECT list, kind, pattern, 'add', CAST(added + CAST(50 + d[5] * 10 AS INTEGER) AS DATE) FROM dates WHERE d[6] < 10 AND d[7] < 8),
valid AS (
  SELECT list, kind, pattern, action, dated AS valid_from,
         lead(dated) OVER (PARTITION BY list, kind, pattern ORDER BY dated, action) AS valid_to
  FROM entries),
active AS (
  SELECT s.page_id, v.list, v.valid_from
  FROM seen s JOIN valid v ON v.action = 'add' AND v.valid_from <= s.fetched_on AND (v.valid_to IS NULL OR s.fetched_on < v.valid_to)
   AND ((v.kind = 'host' AND s.host = v.pattern)
     OR (v.kind = 'domain' AND (s.host = v.pattern OR ends_with(s.host, '.' || v.pattern)))
     OR (v.kind = 'prefix' AND len(s.segs) > 0 AND s.host || '/' || s.segs[1] = v.pattern))),
found AS (
  SELECT page_id, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists, count(*) AS n_active, min(valid_from) AS active_since
  FROM active GROUP BY page_id)
SELECT s.page_id, s.url, s.fetched_on, s.host, f.page_id IS NOT NULL AS blocked, coalesce(f.lists, '') AS lists,
       coalesce(f.n_active, 0) AS n_active, f.active_since
FROM seen s LEFT JOIN found f USING (page_id)
"""


def captures(pages: DataFrame) -> DataFrame:
    """The pages as captures of the days of one year."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7919 % 366).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched_on"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """Additions, removals and later additions of some of the pages' hosts, domains and first path segments."""
    seen = pages.select(url_filter.host_of(F.col("url")).alias("host"), url_filter.segments_of(F.col("url")).alias("segs")).filter("host <> ''")
    patterns = (
        seen.select(
            F.explode(
                F.array(
                    F.struct(F.lit("host").alias("kind"), F.col("host").alias("pattern")),
                    F.struct(F.lit("domain").alias("kind"), F.substring_index("host", ".", -3).alias("pattern")),
                    F.struct(F.lit("prefix").alias("kind"), F.concat("host", F.lit("/"), F.get("segs", F.lit(0))).alias("pattern")),
                )
            ).alias("p")
        )
        .select("p.*")
        .filter("pattern IS NOT NULL")
        .distinct()
    )
    code = F.md5(F.concat("kind", F.lit(":"), "pattern"))
    d = lambda k: F.instr(F.lit("0123456789abcdef"), F.substring("code", k, 1)) - 1
    dated = (
        patterns.withColumn("code", code)
        .filter(d(1) < 6)
        .withColumn("list", F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam")), (d(2) % 3 + 1).cast("int")))
        .withColumn("added", F.date_add(F.lit("2024-01-01").cast("date"), (d(3) * 16 + d(4)).cast("int")))
        .withColumn("removed", F.when(d(6) < 10, F.date_add("added", (20 + d(5) * 10).cast("int"))))
        .withColumn("again", F.when((d(6) < 10) & (d(7) < 8), F.date_add("added", (50 + d(5) * 10).cast("int"))))
    )
    entry = lambda action, day: F.struct(F.lit(action).alias("action"), F.col(day).alias("dated"))
    return (
        dated.select("list", "kind", "pattern", F.explode(F.array(entry("add", "added"), entry("remove", "removed"), entry("add", "again"))).alias("e"))
        .select("list", "kind", "pattern", "e.action", "e.dated")
        .filter("dated IS NOT NULL")
    )


@query("op7_url_filter", OP7_SQL)
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture, with the lists that blocked it on its day."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_captures(captures(pages), dated_entries(pages))
