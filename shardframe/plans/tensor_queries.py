"""Tensors from ``embeddings``: one of 20 vectors each, in two chunks of 10 rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardframe.operators import tensors
from shardframe.plans.registry import query, table

# Element rows of the same tensors.
ELEMENTS = """
WITH el AS (SELECT 't/' || (vec_id // 20) AS path, vec_id // 20 AS t, (vec_id % 20)::BIGINT AS a, (u.i - 1)::BIGINT AS b,
              embedding[u.i]::DOUBLE AS value
            FROM embeddings, (SELECT unnest(range(1, 65)) AS i) u)
"""


def matrices(spark, sf, by_rows=False):
    """``(snapshot, rank, path)`` tensors of shape [20, 64].

    With ``by_rows`` a chunk that hasn't got ten vectors of its own, as the last of a table, becomes a chunk for each vector, so the
    bytes of every chunk fill its box and can be cut along columns.
    """
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    chunks = vectors.groupBy(
        F.expr("vec_id div 20").alias("t"), F.expr("(vec_id % 20) div 10").alias("c")
    ).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("v"))
    offset, n = F.col("c") * 10, F.lit(10).cast("bigint")
    if by_rows:
        whole = (F.size("v") == 10) & (F.size(F.array_distinct(F.col("v.vec_id"))) == 10)
        runs = F.when(whole, F.array("v")).otherwise(F.transform("v", lambda x: F.array(x)))
        chunks = chunks.select("t", "c", F.explode(runs).alias("v"))
        offset, n = F.col("v")[0]["vec_id"] % 20, F.size("v").cast("bigint")
    return chunks.select(
        F.lit("emb").alias("snapshot"),
        (F.col("t") % 4).alias("rank"),
        F.concat(F.lit("t/"), F.col("t").cast("string")).alias("path"),
        F.lit("f32").alias("dtype"),
        F.expr("array(20L, 64L)").alias("shape"),
        F.array(offset, F.lit(0).cast("bigint")).alias("chunk_offset"),
        F.array(n, F.lit(64).cast("bigint")).alias("chunk_shape"),
        tensors.encode_elements(F.flatten(F.transform("v", lambda x: x["embedding"])), "f32").alias("data"),
    )


def elements(df, *index):
    """Path, index columns and value of every element."""
    decoded = tensors.decode_elements(df, "f32")
    return decoded.select("path", *[F.col("at")[i].alias(name) for i, name in enumerate(index)], "value")


# Each fourth tensor is broken in its own way.
@query(
    "x1_validate_tensors",
    """WITH t AS (SELECT vec_id // 20 AS t, (vec_id % 20) // 10 AS c FROM embeddings GROUP BY 1, 2)
    SELECT CASE t % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'unknown dtype' WHEN 2 THEN 'wrong byte length'
           ELSE CASE WHEN c = 1 THEN 'chunk outside shape' ELSE 'chunks do not cover the shape' END END AS outcome,
      CASE t % 4 WHEN 1 THEN 'bf16' ELSE 'f32' END AS dtype, count(*) AS chunks FROM t GROUP BY 1, 2""",
)
def x1(spark, sf):
    t = F.col("rank")
    mixed = (
        matrices(spark, sf)
        .withColumn("dtype", F.when(t == 0, "float32").when(t == 1, "bf16").otherwise("f32"))
        .withColumn("data", F.when(t == 2, F.substring("data", 1, 100)).otherwise(F.col("data")))
        .withColumn("shape", F.when(t == 3, F.expr("array(15L, 64L)")).otherwise(F.col("shape")))
    )
    good, bad = tensors.validate_tensors(mixed)
    rows = good.select(F.lit("ok").alias("outcome"), "dtype").unionByName(bad.select(F.col("reason").alias("outcome"), "dtype"))
    return rows.groupBy("outcome", "dtype").agg(F.count(F.lit(1)).alias("chunks"))


@query("x2_flatten_tensors", ELEMENTS + "SELECT path, a * 64 + b AS a, value FROM el")
def x2(spark, sf):
    return elements(tensors.flatten_tensors(matrices(spark, sf)), "a")


@query("x2_flatten_columns", ELEMENTS + "SELECT path, a * 24 + b - 16 AS a, value FROM el WHERE b >= 16 AND b < 40")
def x2_columns(spark, sf):
    # Column cuts leave chunks that are not contiguous in the flat tensor.
    left, _ = tensors.tensor_range(matrices(spark, sf, by_rows=True), ":,16:32")
    right, _ = tensors.tensor_range(matrices(spark, sf, by_rows=True), ":,32:40")
    halves = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    whole, _ = tensors.concat_tensors(halves, ["snapshot", "rank", "path"], "side", 1)
    return elements(tensors.flatten_tensors(whole), "a")


@query("x3_slice_rows", ELEMENTS + "SELECT path, a - 7 AS a, b, value FROM el WHERE a >= 7 AND a < 13")
def x3(spark, sf):
    return elements(tensors.slice_rows(matrices(spark, sf), 7, 13)[0], "a", "b")


@query("x3_sub", ELEMENTS + "SELECT path, b AS a, value FROM el WHERE a = 12")
def x3_sub(spark, sf):
    return elements(tensors.sub(matrices(spark, sf), 12)[0], "a")


@query("x4_tensor_range", ELEMENTS + "SELECT path, a - 5 AS a, b - 10 AS b, value FROM el WHERE a >= 5 AND b >= 10 AND b < 20")
def x4(spark, sf):
    return elements(tensors.tensor_range(matrices(spark, sf, by_rows=True), "5:,10:20")[0], "a", "b")


@query(
    "x5_concat_tensors",
    """SELECT 'g/' || (vec_id // 80) AS path, (vec_id % 20)::BIGINT AS a, ((vec_id // 20) % 4 * 64 + u.i - 1)::BIGINT AS b,
      embedding[u.i]::DOUBLE AS value FROM embeddings, (SELECT unnest(range(1, 65)) AS i) u""",
)
def x5(spark, sf):
    number = F.substring_index("path", "/", -1).cast("bigint")
    parts = matrices(spark, sf).select(
        F.concat(F.lit("g/"), F.call_function("div", number, F.lit(4).cast("bigint")).cast("string")).alias("path"),
        F.col("rank").alias("part"), "dtype", "shape", "chunk_offset", "chunk_shape", "data",
    )
    return elements(tensors.concat_tensors(parts, ["path"], "part", 1)[0], "a", "b")


@query(
    "x6_pad_tensors",
    ELEMENTS + """SELECT path, a, sum(value) = 0 AND count(*) = 64 AS zero FROM el GROUP BY path, a
    UNION ALL SELECT path, 20 + u.i, true FROM (SELECT DISTINCT path FROM el), (SELECT unnest(range(5)) AS i) u""",
)
def x6(spark, sf):
    padded, _ = tensors.pad_tensors(matrices(spark, sf).withColumn("to", F.expr("array(25L, 64L)")), "to")
    rows = elements(padded, "a", "b").groupBy("path", "a")
    return rows.agg(((F.max(F.abs("value")) == 0) & (F.count(F.lit(1)) == 64)).alias("zero"))


@query("x7_decode_elements", ELEMENTS + "SELECT path, a, b, value FROM el")
def x7(spark, sf):
    return elements(matrices(spark, sf), "a", "b")


@query(
    "x8_tensor_stats",
    """WITH t AS (SELECT vec_id // 20 AS t FROM embeddings GROUP BY 1)
    SELECT snapshot, prefix, count(*) AS tensors, (sum(1280))::BIGINT AS elements, (sum(5120))::BIGINT AS bytes
    FROM (SELECT 'emb' AS snapshot, 't' AS prefix FROM t) GROUP BY ROLLUP (snapshot, prefix)""",
)
def x8(spark, sf):
    return tensors.tensor_stats(matrices(spark, sf))


@query(
    "x9_tensor_meta",
    """SELECT p_partkey, 'f32' || chr(10) || '2' || chr(10) || p_size || chr(10) || (p_partkey % 7) || chr(10) AS meta,
      CASE WHEN p_partkey % 3 <> 0 THEN 'f32' END AS dtype,
      CASE WHEN p_partkey % 3 <> 0 THEN p_size::BIGINT END AS rows FROM part""",
)
def x9(spark, sf):
    shaped = table(spark, sf, "part").select(
        "p_partkey",
        tensors.format_meta(F.lit("f32"), F.array(F.col("p_size").cast("bigint"), F.col("p_partkey") % 7)).alias("meta"),
    )
    # A third of the texts loses its last line.
    broken = F.when(F.col("p_partkey") % 3 == 0, F.regexp_replace("meta", r"[^\n]*\n$", "")).otherwise(F.col("meta"))
    parsed = tensors.parse_meta(shaped.withColumn("text", broken), "text")
    return parsed.select("p_partkey", "meta", "dtype", F.col("shape")[0].alias("rows"))
