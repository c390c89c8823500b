import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardframe.plans import QUERIES
from shardframe.plans import checkpoint as ck
from shardframe.plans import reshard_queries
from shardframe.session import cut_lineage

CHUNKS = "rank long, path string, dtype string, shape array<long>, chunk_offset array<long>, chunk_shape array<long>, data binary"


def chunk(rows, path, shape, offset, values):
    values = np.asarray(values, "<f4")
    return (rows, path, "f32", shape, offset, list(values.shape), values.tobytes())


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_totals_of_row_blocks_meet_in_no_shuffle(spark, rows):
    """Blocks of rows are summed where they are; column pieces of a row are added up."""
    whole = np.arange(12).reshape(4, 3)
    blocks = [chunk(0, "m", [4, 3], [0, 0], whole[:3]), chunk(0, "m", [4, 3], [3, 0], whole[3:]), chunk(1, "v", [3], [0], [1, 2, 3])]
    pieces = [chunk(0, "m", [4, 3], [0, 0], whole[:, :2]), chunk(0, "m", [4, 3], [0, 2], whole[:, 2:]), blocks[2]]
    want = sorted([*((0, "m", r, float(x)) for r, x in enumerate(whole.sum(1))), (1, "v", 0, 1.0), (1, "v", 1, 2.0), (1, "v", 2, 3.0)], key=repr)
    made = reshard_queries.line_totals(spark.createDataFrame(blocks, CHUNKS))
    assert rows(made, "rank", "path", "line", "total") == want
    assert "Exchange" not in plan_text(made)
    assert rows(reshard_queries.line_totals(spark.createDataFrame(pieces, CHUNKS), pieces=True), "rank", "path", "line", "total") == want


def test_carried_values_need_no_tensors(spark, rows, tmp_path, monkeypatch):
    """Ten layers; values are carried without the tensors' bytes being made."""
    spark.range(10).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(30).select(F.col("id").alias("vec_id"), F.array_repeat(F.lit(0.5).cast("float"), 64).alias("embedding")).write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(ck, "chunks_of", lambda *args: pytest.fail("tensors are made"))
    got = rows(QUERIES["r9_carry_values"].run(spark, str(tmp_path)), "rank", "path", "dtype", "value")
    groups = "optimizer/optimizer/param_groups"
    told = [("iteration", "int", "50"), ("seed", "int", "0"), (f"{groups}/0/lr", "float", "0.1"), (f"{groups}/1/lr", "float", "0.2")]
    assert got == sorted([(rank, *x) for rank in range(30) for x in told], key=repr)


def test_chunks_meet_blocks_of_vectors(spark, tmp_path):
    """Four layers; one vector is absent and one is there twice, and the vectors begin again several times in a block."""
    vectors = [v for v in range(30) if v != 7] + [3]
    spark.createDataFrame([(v,) for v in range(4)], "s_suppkey bigint").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(v, [float(v + 1)] * 64) for v in vectors], "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    params = cut_lineage(ck.parameters(spark, str(tmp_path), ck.SOURCE))
    made = ck.chunks_of(spark, str(tmp_path), params, ck.SOURCE[1])
    # Vectors are collected before they meet the chunks, and no payload is shuffled behind that.
    assert "collect_list" not in plan_text(made)
    got = {(r["rank"], r["path"]): np.frombuffer(r["data"], "<f4").reshape(-1, 64)[:, 5].tolist() for r in made.filter("path LIKE '%attention.weight'").collect()}
    want = {}
    for layer in range(4):
        for mp in range(4):
            ids = [(layer * 48 + mp * 12 + r) % 30 for r in range(12)]
            rows = [x for v in ids for x in ([0.0] if v == 7 else [v + 1.0] * (2 if v == 3 else 1))]
            want[layer // 2 * 4 + mp, f"model/language_model/encoder/layers.{layer % 2}.attention.weight"] = rows
    assert got == want


def test_line_sums_meet_in_blocks(spark, rows, monkeypatch):
    """Runs of lines that overlap, with a gap, over blocks of four lines; a path is shuffled for each block, not for each line."""
    monkeypatch.setattr(reshard_queries, "LINES", 4)
    whole = np.arange(40).reshape(10, 4)
    pieces = [chunk(0, "m", [20, 4], [0, 0], whole[:, :3]), chunk(0, "m", [20, 4], [2, 3], whole[2:7, 3:]), chunk(0, "m", [20, 4], [15, 0], whole[:2])]
    sums = {r: float(whole[r, :3].sum() + (whole[r, 3] if 2 <= r < 7 else 0)) for r in range(10)} | {15 + r: float(whole[r].sum()) for r in range(2)}
    made = reshard_queries.line_totals(spark.createDataFrame(pieces, CHUNKS), pieces=True)
    assert rows(made, "rank", "path", "line", "total") == sorted(((0, "m", r, x) for r, x in sums.items()), key=repr)
    assert "hashpartitioning(rank" in plan_text(made) and not re.search(r"hashpartitioning\(rank[^)]*line", plan_text(made))


def test_chunks_are_made_by_many_tasks(spark, tmp_path):
    """Rows that name the bytes of a chunk are few bytes, but no task makes the bytes of all of them, also where the vectors aren't broadcast."""
    spark.range(40).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(30).select(F.col("id").alias("vec_id"), F.array_repeat(F.lit(0.5).cast("float"), 64).alias("embedding")).write.parquet(str(tmp_path / "embeddings.parquet"))
    params = cut_lineage(ck.parameters(spark, str(tmp_path), ck.SOURCE))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = ck.chunks_of(spark, str(tmp_path), params, ck.SOURCE[1]).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The table and the head are four chunks each.
    assert sum(r["count"] for r in made) == params.count() * 3 + 2 * 4 * 3 * 3
    assert len(made) > 4 and max(r["count"] for r in made) < params.count()


def test_lines_are_summed_where_they_are_decoded(spark, rows):
    """Elements don't leave the task that decodes them, only sums do; unknown elements make an unknown line, of any shape."""
    data = [chunk(0, "m", [2, 3], [0, 0], [[1, 2, 3], [np.nan, 5, 6]]), chunk(0, "n", [3, 1], [1, 0], [[7], [8]]), chunk(0, "o", [2, 2, 2], [0, 0, 0], np.arange(8).reshape(2, 2, 2))]
    for pieces in (False, True):
        made = reshard_queries.line_totals(spark.createDataFrame(data, CHUNKS), pieces)
        known = [("m", 0, 6.0), ("n", 1, 7.0), ("n", 2, 8.0), ("o", 0, 6.0), ("o", 1, 22.0)]
        assert rows(made, "path", "line", "total") == sorted(known + [("m", 1, None)] * (not pieces), key=repr)
        assert not re.search(r"aggregate\(slice\(_v|get\(p", plan_text(made)) and "transform(sequence" not in plan_text(made)
