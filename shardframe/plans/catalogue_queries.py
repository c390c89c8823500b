"""A path catalogue from ``pages``: the host is the first directory, ``page_id`` the version."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardframe.functions.paths import rel_path, uri_host
from shardframe.operators import catalogue
from shardframe.plans.registry import query, table

# Paths of even pages are there already; odd ones and every third are updates.
PATHS = r"""
WITH src AS (
  SELECT page_id, length(html)::BIGINT AS size, list_filter(string_split(
    regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages),
rows AS (SELECT page_id, size, parts, '/' || array_to_string(parts, '/') AS path FROM src),
old AS (SELECT path, parts, arg_max(size, page_id) AS size, max(page_id) AS version FROM rows WHERE page_id % 2 = 0 GROUP BY 1, 2),
upd AS (SELECT path, parts, size + 1 AS size, page_id + 1 AS version FROM rows WHERE page_id % 2 = 1 OR page_id % 3 = 0)
"""
MERGED = (
    PATHS
    + """,
latest AS (SELECT path, parts, arg_max(size, n * 1000000000 + version) AS size, arg_max(version, n * 1000000000 + version) AS version
           FROM (SELECT *, 0 AS n FROM old UNION ALL SELECT *, 1 FROM upd) GROUP BY 1, 2),
up AS (SELECT path, size, unnest(list_transform(range(len(parts)), lambda i: '/' || array_to_string(parts[1:i], '/'))) AS dir,
              '/' || array_to_string(parts[1:len(parts) - 1], '/') AS parent FROM latest),
clash AS (SELECT path, count(*) AS n FROM up WHERE dir IN (SELECT path FROM latest) GROUP BY path),
files AS (SELECT * FROM latest WHERE path NOT IN (SELECT path FROM clash)),
alldirs AS (SELECT DISTINCT dir FROM up WHERE path NOT IN (SELECT path FROM clash)),
cat AS (SELECT path, false AS is_dir, size::BIGINT AS size, version::BIGINT AS version FROM files
        UNION ALL SELECT dir, true, 0, 0 FROM alldirs)
"""
)


def pages(spark, sf):
    path = F.concat(F.lit("/"), uri_host("url"), F.lit("/"), rel_path("url"))
    return table(spark, sf, "pages").select(
        path.alias("path"), F.lit(False).alias("is_dir"), F.length("html").cast("bigint").alias("size"), F.col("page_id").alias("version")
    )


def upserted(spark, sf, replace=True):
    rows = pages(spark, sf)
    old = (
        rows.filter("version % 2 = 0")
        .withColumn("path", catalogue.normal_path("path"))
        .groupBy("path")
        .agg(F.max_by(F.struct("is_dir", "size", "version"), "version").alias("r"))
        .select("path", "r.*")
    )
    updates = rows.filter("version % 2 = 1 OR version % 3 = 0").select(
        "path", "is_dir", (F.col("size") + 1).alias("size"), (F.col("version") + 1).alias("version")
    )
    return catalogue.path_upsert(old, updates, replace)


@query("p8_path_upsert", MERGED + "SELECT path, is_dir, size, version FROM cat")
def p8(spark, sf):
    return upserted(spark, sf)[0]


@query(
    "p8_upsert_violations",
    PATHS
    + """, extra AS (SELECT path, count(*) - CASE WHEN path IN (SELECT path FROM old) THEN 0 ELSE 1 END AS n
                     FROM upd GROUP BY path),
    kept AS (SELECT path, parts FROM old UNION SELECT path, parts FROM upd),
    up AS (SELECT path, unnest(list_transform(range(len(parts)), lambda i: '/' || array_to_string(parts[1:i], '/'))) AS dir FROM kept)
    SELECT path, n, 'path exists' AS reason FROM extra WHERE n > 0
    UNION ALL SELECT path, count(*), 'parent is a file' FROM up WHERE dir IN (SELECT path FROM kept) GROUP BY path""",
)
def p8_violations(spark, sf):
    return upserted(spark, sf, replace=False)[1]


@query(
    "p9_path_list",
    MERGED + "SELECT path, is_dir, size FROM cat WHERE path = '/blog.ththan.example.net' OR path LIKE '/blog.ththan.example.net/%'",
)
def p9_list(spark, sf):
    return catalogue.path_list(upserted(spark, sf)[0], "/blog.ththan.example.net").drop("version")


@query(
    "p9_path_find",
    MERGED
    + """SELECT path, version FROM cat WHERE regexp_matches(path, '^/blog\\.ththan\\.example\\.net/en/9[^./]*(\\.[^/]*)?$')
      AND split_part(split_part(path, '/', 4), '.', 1) = (SELECT min(split_part(split_part(path, '/', 4), '.', 1)) FROM cat
        WHERE path LIKE '/blog.ththan.example.net/en/9%')""".replace("\\\\", "\\"),
)
def p9_find(spark, sf):
    cat = upserted(spark, sf)[0]
    name = F.substring_index(F.substring_index("path", "/", -1), ".", 1)
    stem = cat.filter(F.col("path").startswith("/blog.ththan.example.net/en/9")).agg(F.min(name)).first()[0]
    return catalogue.path_find(cat, "/blog.ththan.example.net/en", stem).select("path", "version")


@query(
    "p10_path_delete",
    MERGED
    + """, gone AS (SELECT *, (path = '/blog.ththan.example.net' OR path LIKE '/blog.ththan.example.net/%') AS del FROM cat)
    SELECT count(*) FILTER (del AND NOT is_dir) AS files, count(*) FILTER (del AND is_dir) AS dirs,
           count(*) FILTER (NOT del) AS remaining FROM gone""",
)
def p10(spark, sf):
    kept, counts = catalogue.path_delete(upserted(spark, sf)[0], "/blog.ththan.example.net")
    return counts.withColumn("remaining", kept.agg(F.count(F.lit(1))).scalar())


@query(
    "p11_path_stats",
    MERGED
    + """, nodes AS (SELECT path, is_dir, size, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM cat),
    anc AS (SELECT is_dir, size, unnest(list_transform(range(len(parts)), lambda i: '/' || array_to_string(parts[1:i], '/'))) AS dir,
                   '/' || array_to_string(parts[1:len(parts) - 1], '/') AS parent FROM nodes)
    SELECT dir AS path, count(*) FILTER (parent = dir) AS children, count(*) FILTER (NOT is_dir) AS files,
           count(*) FILTER (is_dir) AS dirs, sum(size)::BIGINT AS bytes FROM anc GROUP BY dir""",
)
def p11(spark, sf):
    return catalogue.path_stats(upserted(spark, sf)[0])
