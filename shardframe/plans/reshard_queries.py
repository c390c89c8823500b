"""Re-sharding over the checkpoint of :mod:`shardframe.plans.checkpoint`, (pp, mp, dp) (2, 4, 1) to (5, 3, 2)."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from shardframe.operators import byref, reshard, structure, tensors
from shardframe.plans import checkpoint as ck
from shardframe.plans.registry import query, table
from shardframe.session import new_shared_path
from shardframe.sources import state


def params_sql(name: str, degrees: tuple[int, int, int]) -> str:
    """Parameters of a configuration by arithmetic: logical tensor, stage, key, group and index."""
    pp, mp, _ = degrees
    head = f"UNION ALL SELECT {pp - 1}, -1, 'head', 4 * n + 3, 'model/word_embeddings_for_head/weight', tr || '-64', 0, 2 * n FROM {name}_c" if pp > 1 else ""
    return f"""{name}_c AS (SELECT (SELECT count(*) FROM supplier) // {pp} AS n,
      ((SELECT count(*) FROM embeddings) + {128 * mp - 1}) // {128 * mp} * 128 AS tr),
    {name}_p AS (
      SELECT s_suppkey // n AS pp, s_suppkey AS layer, k.kind, (s_suppkey % n) * 4 + k.i + 1 AS ord,
        'model/language_model/encoder/layers.' || (s_suppkey % n) || '.' || k.nm AS key, k.shape, k.i % 2 AS grp,
        (s_suppkey % n) * 2 + k.i // 2 + CASE WHEN s_suppkey // n = 0 AND k.i % 2 = 0 THEN 1 ELSE 0 END AS idx
      FROM supplier, {name}_c, (VALUES ('attention_w', 0, 'attention.weight', '{48 // mp}-64'), ('attention_b', 1, 'attention.bias', '{48 // mp}'),
        ('output_w', 2, 'output.weight', '64-{48 // mp}'), ('norm_w', 3, 'norm.weight', '64')) k(kind, i, nm, shape)
      UNION ALL SELECT 0, -1, 'embedding', 0, 'model/language_model/embedding/word_embeddings/weight', tr || '-64', 0, 0 FROM {name}_c
      UNION ALL SELECT {pp - 1}, -1, 'final_w', 4 * n + 1, 'model/language_model/encoder/final_layernorm.weight', '64', 1, 2 * n FROM {name}_c
      UNION ALL SELECT {pp - 1}, -1, 'final_b', 4 * n + 2, 'model/language_model/encoder/final_layernorm.bias', '64', 1, 2 * n + 1 FROM {name}_c
      {head}),
    {name}_g AS (SELECT pp, count(*) FILTER (grp = 0) AS g0 FROM {name}_p GROUP BY pp),
    {name}_t AS (SELECT {name}_p.*, 0 AS s, key AS path FROM {name}_p
      UNION ALL SELECT p.*, 1, 'optimizer/optimizer/state/' || (idx + CASE WHEN grp = 1 THEN g0 ELSE 0 END) || '/exp_avg' FROM {name}_p p JOIN {name}_g USING (pp)
      UNION ALL SELECT p.*, 2, 'optimizer/fp32_from_fp16_params/' || grp || '/' || idx FROM {name}_p p)"""


# A target tensor and the same logical tensor of the source; the model's head reads the embedding.
BOTH = f"""
WITH {params_sql('a', ck.SOURCE)}, {params_sql('b', ck.TARGET)},
ranks AS (SELECT unnest(range(5 * 3 * 2)) AS rank),
tgt AS (SELECT r.rank, b_t.pp::BIGINT AS pp, r.rank % 3 AS mp, r.rank // 15 AS dp, b_t.layer, b_t.kind, b_t.s, b_t.path, b_t.shape
        FROM ranks r JOIN b_t ON b_t.pp = (r.rank % 15) // 3),
mapped AS (SELECT t.rank, t.pp, t.mp, t.dp, t.path, t.shape, t.kind, t.layer, t.s, a.pp::BIGINT AS source_pp, a.path AS source_path, a.shape AS source_shape
  FROM tgt t JOIN a_t a ON a.layer = t.layer AND a.s = t.s
    AND a.kind = CASE WHEN t.kind = 'head' AND t.s = 0 THEN 'embedding' ELSE t.kind END)
"""

# Source ranges by overlapping all source parts, then keeping what is not empty.
PLAN = (
    BOTH
    + """,
dims AS (SELECT *, CASE WHEN kind = 'output_w' THEN 1 ELSE 0 END AS dim,
    CASE kind WHEN 'output_w' THEN 12 WHEN 'attention_w' THEN 12 WHEN 'attention_b' THEN 12 ELSE (SELECT tr FROM a_c) END AS a,
    CASE kind WHEN 'output_w' THEN 16 WHEN 'attention_w' THEN 16 WHEN 'attention_b' THEN 16 ELSE (SELECT tr FROM b_c) END AS b
  FROM mapped WHERE shape <> source_shape),
cutp AS (SELECT d.*, q.q AS source_mp, greatest(mp * b, q * a) AS lo_, least((mp + 1) * b, (q + 1) * a) AS hi_
  FROM dims d, (SELECT unnest(range(4)) AS q) q),
moves AS (SELECT rank, pp, mp, dp, path, source_pp, source_path, 'repartition' AS action, source_mp, dim::BIGINT AS dim,
    lo_ - source_mp * a AS lo, hi_ - source_mp * a AS hi, lo_ - mp * b AS dst_lo, shape, source_shape, kind, s, layer FROM cutp WHERE lo_ < hi_),
got AS (SELECT d.rank, d.path, d.b, d.pp, d.mp, d.dp, d.source_pp, d.source_path, d.shape, d.source_shape, d.kind, d.s, d.layer, coalesce(sum(m.hi - m.lo), 0) AS n
  FROM dims d LEFT JOIN moves m USING (rank, path) GROUP BY ALL),
plan AS (
  SELECT rank, pp, mp, dp, path, source_pp, source_path, action, source_mp, dim, lo, hi, dst_lo, shape, source_shape, kind, s, layer FROM moves
  UNION ALL SELECT rank, pp, mp, dp, path, source_pp, source_path, 'pad', NULL, 0, 0, (b - n)::BIGINT, n::BIGINT, shape, source_shape, kind, s, layer FROM got WHERE n < b
  UNION ALL SELECT rank, pp, mp, dp, path, source_pp, source_path, 'replicate', 0, 0, 0, split_part(shape, '-', 1)::BIGINT, 0, shape, source_shape, kind, s, layer
    FROM mapped WHERE shape = source_shape)
"""
)


def shape_text(column):
    return F.array_join(F.col(column).cast("array<string>"), "-")


def both(spark, sf, data=False):
    return ck.state_of(spark, sf, ck.SOURCE, data), ck.state_of(spark, sf, ck.TARGET)


def mapped(spark, sf):
    """Source keys of all target tensors and the violations."""
    source, target = both(spark, sf)
    change = ck.change_of(spark, sf)

    def groups(state):
        keys = structure.split_weight_decay(structure.model_keys(state.structure))
        return keys.join(state.rank_map.filter("dp = 0").select("rank", "pp", "mp"), "rank")

    sizes = [structure.group_sizes(s.structure, s.rank_map, "fp16") for s in (source, target)]
    return reshard.source_keys(reshard.target_tensors(target), change, groups(target), sizes[1], groups(source), sizes[0])


@query(
    "c10_group_sizes",
    f"WITH {params_sql('a', ck.SOURCE)} SELECT 'c' AS config_id, pp::BIGINT AS pp, grp::BIGINT AS \"group\", count(*) AS size FROM a_p GROUP BY pp, grp",
)
def c10(spark, sf):
    state = ck.state_of(spark, sf, ck.SOURCE)
    return structure.group_sizes(state.structure, state.rank_map, "fp16")


@query(
    "c9_checkpoint_groups",
    f"""WITH {params_sql('b', ck.TARGET)} SELECT pp * 3 + m.m AS rank, key AS path, grp::BIGINT AS "group", idx::BIGINT AS "index"
    FROM b_p, (SELECT unnest(range(3)) AS m) m""",
)
def c9_checkpoint(spark, sf):
    state = ck.state_of(spark, sf, ck.TARGET)
    return structure.split_weight_decay(structure.model_keys(state.structure)).select("rank", "path", "group", "index")


# Layers of a grid of depths and degrees over `part`.
GRID = """WITH g AS (SELECT p_partkey, 24 + p_size AS n, 1 + p_partkey % 4 AS spp, 1 + p_partkey % 5 AS tpp, p_partkey % 3 AS l FROM part),
h AS (SELECT *, p_partkey % tpp AS t, l + (p_partkey % tpp) * (n // tpp) AS gl FROM g)
"""


@query(
    "r1_layer_place",
    GRID + """SELECT p_partkey, gl AS global_layer, CASE WHEN gl // (n // spp) < spp THEN gl // (n // spp) END AS source_pp,
      CASE WHEN gl // (n // spp) < spp THEN gl - gl // (n // spp) * (n // spp) END AS source_layer FROM h""",
)
def r1(spark, sf):
    key = F.col("p_partkey")
    grid = table(spark, sf, "part").select(
        "p_partkey", (F.col("p_size").cast("bigint") + 24).alias("n"), (key % 4 + 1).alias("spp"), (key % 5 + 1).alias("tpp"),
        (key % 3).alias("l"),
    ).withColumn("t", key % F.col("tpp"))
    return grid.select("p_partkey", reshard.layer_place("l", "t", "n", "spp", "tpp").alias("r")).select("p_partkey", "r.*")


@query("r1_map_layers", BOTH + "SELECT rank, path, source_pp, source_path FROM mapped WHERE s = 0 AND layer >= 0")
def r1_keys(spark, sf):
    wanted = reshard.target_tensors(ck.state_of(spark, sf, ck.TARGET)).filter(F.col("parts")[0] == "model")
    out = reshard.map_layers(wanted, ck.change_of(spark, sf))
    return out.select("rank", "path", "source_pp", F.array_join("source_parts", "/").alias("source_path"))


@query("r2_map_stage_keys", BOTH + "SELECT rank, path, source_pp, source_path FROM mapped WHERE s = 0 AND layer < 0")
def r2(spark, sf):
    wanted = reshard.target_tensors(ck.state_of(spark, sf, ck.TARGET)).filter(F.col("parts")[0] == "model")
    out = reshard.map_stage_keys(wanted, ck.change_of(spark, sf))
    return out.select("rank", "path", "source_pp", F.array_join("source_parts", "/").alias("source_path"))


@query("r4_map_optimizer_keys", BOTH + "SELECT rank, path, source_pp, source_path FROM mapped WHERE s > 0")
def r4(spark, sf):
    found = mapped(spark, sf)[0].filter(F.col("parts")[0] == "optimizer")
    return found.select("rank", "path", "source_pp", "source_path")


@query("r5_source_keys", BOTH + "SELECT rank, pp, mp, dp, path, source_pp, source_path FROM mapped")
def r5(spark, sf):
    return mapped(spark, sf)[0].select("rank", "pp", "mp", "dp", "path", "source_pp", "source_path")


@query(
    "r6_overlap_ranges",
    """WITH g AS (SELECT p_partkey, p_size::BIGINT AS a, 1 + p_partkey % 50 AS b, 1 + p_partkey % 8 AS smp, p_partkey % 6 AS q FROM part),
    o AS (SELECT g.*, u.r, greatest(q * b, r * a) AS lo_, least((q + 1) * b, (r + 1) * a) AS hi_ FROM g, (SELECT unnest(range(8)) AS r) u WHERE r < smp),
    hit AS (SELECT p_partkey, r AS source_mp, lo_ - r * a AS lo, hi_ - r * a AS hi, lo_ - q * b AS dst_lo FROM o WHERE lo_ < hi_),
    n AS (SELECT p_partkey, sum(hi - lo)::BIGINT AS n FROM hit GROUP BY 1)
    SELECT g.p_partkey, source_mp, lo, hi, dst_lo, b - coalesce(n, 0) AS pad FROM g LEFT JOIN hit USING (p_partkey) LEFT JOIN n USING (p_partkey)""",
)
def r6(spark, sf):
    key = F.col("p_partkey")
    grid = table(spark, sf, "part").select(
        "p_partkey", F.col("p_size").cast("bigint").alias("a"), (key % 50 + 1).alias("b"), (key % 8 + 1).alias("smp"), (key % 6).alias("q")
    )
    return reshard.overlap_ranges(grid, "a", "b", "smp", "q").select("p_partkey", "source_mp", "lo", "hi", "dst_lo", "pad")


def plan_of(spark, sf):
    source, target = both(spark, sf)
    return reshard.plan_migration(source, target, ck.change_of(spark, sf))


@query(
    "r7_transfer_plan",
    PLAN + "SELECT rank, pp, mp, dp, path, source_pp, source_path, action, source_mp, dim, lo, hi, dst_lo, shape, source_shape FROM plan",
)
def r7(spark, sf):
    plan, _ = plan_of(spark, sf)
    return plan.withColumn("shape", shape_text("shape")).withColumn("source_shape", shape_text("source_shape"))


#: Lines of a tensor whose sums are joined at once.
LINES = 256

# Rows of the target tensors straight from the vectors they are made of.
CONTENT = (
    BOTH
    + """,
n AS (SELECT count(*) AS n FROM embeddings),
v AS (SELECT vec_id, embedding[1]::DOUBLE AS first, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS total, embedding FROM embeddings),
rows AS (SELECT t.rank, t.path, t.kind, t.layer, t.s, t.mp, u.r FROM mapped t
   JOIN (SELECT unnest(range(100000)) AS r) u ON u.r < CASE WHEN kind IN ('attention_w', 'attention_b', 'output_w') THEN 16
     WHEN kind IN ('embedding', 'head') THEN (SELECT tr FROM b_c) ELSE 1 END),
vec AS (SELECT rows.*, CASE WHEN layer >= 0 THEN (layer * 48 + CASE WHEN kind = 'norm_w' THEN 0 ELSE mp * 16 + r END
      + CASE kind WHEN 'attention_w' THEN 0 WHEN 'attention_b' THEN 7 WHEN 'output_w' THEN 14 ELSE 21 END + 13 * s) % n
    WHEN kind IN ('embedding', 'head') THEN CASE WHEN mp * (SELECT tr FROM b_c) + r < n THEN (mp * (SELECT tr FROM b_c) + r + 13 * s) % n END
    ELSE (13 * s + CASE WHEN kind = 'final_b' THEN 1 ELSE 0 END) % n END AS vec_id FROM rows, n),
content AS (
  SELECT rank, path, r::BIGINT AS line, coalesce(CASE WHEN kind = 'attention_b' THEN first ELSE total END, 0) AS total
    FROM vec LEFT JOIN v USING (vec_id) WHERE kind IN ('attention_w', 'attention_b', 'embedding', 'head')
  UNION ALL SELECT rank, path, (i.i - 1)::BIGINT, sum(embedding[i.i]::DOUBLE) FROM vec JOIN v USING (vec_id), (SELECT unnest(range(1, 65)) AS i) i
    WHERE kind IN ('norm_w', 'final_w', 'final_b', 'output_w') GROUP BY 1, 2, 3)
"""
)


@query("r8_apply_plan", CONTENT + "SELECT rank, path, line, round(total, 5) AS total FROM content")
def r8(spark, sf):
    source, target = both(spark, sf, data=True)
    plan, _ = reshard.plan_migration(source, target, ck.change_of(spark, sf))
    stored = source.tensors.join(source.rank_map.filter("dp = 0").select("rank", "pp", "mp"), "rank")
    return line_totals(byref.read_targets(byref.targets_of(stored, plan)))


@query("r8_apply_plan_to_tables", CONTENT + "SELECT rank, path, line, round(total, 5) AS total FROM content")
def r8_tables(spark, sf):
    """The same plan on chunk rows that hold their bytes."""
    source, target = both(spark, sf, data=True)
    plan, _ = reshard.plan_migration(source, target, ck.change_of(spark, sf))
    held = byref.read_targets(byref.whole_tensors(source.tensors), block=1 << 13)
    stored = held.join(source.rank_map.filter("dp = 0").select("rank", "pp", "mp"), "rank")
    return line_totals(reshard.apply_plan(stored, plan), pieces=True)


@F.arrow_udf(StructType([StructField("at", LongType()), StructField("s", ArrayType(DoubleType()))]))
def _joined(pieces: pa.Array) -> pa.Array:
    """Sums of runs of lines ``(at, s)`` that overlap, as one run for each list of them; a line without a value is null."""
    held, runs = pieces.value_lengths().to_numpy(), pieces.flatten()
    at, lines = runs.field("at").to_numpy(), runs.field("s")
    n, flat = lines.value_lengths().to_numpy().astype(np.int64), lines.flatten()
    heads = np.cumsum(held) - held
    low = np.minimum.reduceat(at, heads) if len(at) else at
    size = (np.maximum.reduceat(at + n, heads) if len(at) else at) - low
    first = np.r_[0, np.cumsum(size)]
    # The place of each run, then of each of its lines.
    begin = at + np.repeat(first[:-1] - low, held)
    place = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(len(flat))
    known = flat.is_valid().to_numpy(zero_copy_only=False)
    place, values = place[known], flat.drop_null().to_numpy(zero_copy_only=False)
    sums, found = np.bincount(place, values, minlength=first[-1]), np.bincount(place, minlength=first[-1])
    made = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(sums, pa.float64(), mask=found == 0))
    return pa.StructArray.from_arrays([pa.array(low, pa.int64()), made], names=["at", "s"])


def joined_lines(summed):
    """Sums of lines from runs of them ``(rank, path, _at, _s)`` that overlap. Runs meet as arrays in blocks of lines, so a path isn't shuffled for each line."""
    blocks = summed.filter("size(_s) > 0").withColumn("_b", F.explode(F.expr(f"sequence(_at div {LINES}, (_at + size(_s) - 1) div {LINES})")))
    blocks = blocks.withColumn("_from", F.expr(f"greatest(_at, _b * {LINES})"))
    cut = F.expr(f"slice(_s, int(_from - _at) + 1, int(least(_at + size(_s), (_b + 1) * {LINES}) - _from))")
    met = blocks.select("rank", "path", "_b", F.struct(F.col("_from").alias("at"), cut.alias("s")).alias("_p")).groupBy("rank", "path", "_b").agg(F.collect_list("_p").alias("_p"))
    lines = met.select("rank", "path", _joined("_p").alias("_j")).select("rank", "path", "_j.at", F.posexplode("_j.s").alias("_r", "value"))
    return lines.filter("value IS NOT NULL").select("rank", "path", (F.col("at") + F.col("_r")).alias("line"), "value")


def line_totals(moved, pieces=False):
    """Sum of every row of the tensors' leading dimension; with ``pieces`` a row may lie in several chunks."""
    # Rows are summed inside their chunk, by the task that decodes it; only column pieces of a row meet in an aggregate.
    stride = F.expr("aggregate(slice(chunk_shape, 2, size(chunk_shape)), 1L, (a, x) -> a * x)")
    sums = tensors.row_sums(tensors.decode_array("f32"), F.col("chunk_shape")[0], stride)
    summed = moved.select("rank", "path", F.col("chunk_offset")[0].alias("_at"), sums.alias("_s"))
    if pieces:
        rows = joined_lines(summed)
    else:
        rows = summed.select("rank", "path", "_at", F.posexplode("_s").alias("_r", "value")).select("rank", "path", (F.col("_at") + F.col("_r")).alias("line"), "value")
    # Adding 0 turns a rounded -0.0 into 0.0.
    return rows.select("rank", "path", "line", (F.round("value", 5) + F.lit(0.0)).alias("total"))


@query(
    "r9_carry_values",
    BOTH + """SELECT r.rank, v.path, v.dtype, v.value FROM ranks r, (VALUES ('iteration', 'int', '50'), ('seed', 'int', '0'),
      ('optimizer/optimizer/param_groups/0/lr', 'float', '0.1'), ('optimizer/optimizer/param_groups/1/lr', 'float', '0.2')) v(path, dtype, value)""",
)
def r9(spark, sf):
    source, target = both(spark, sf)
    wanted = reshard.target_tensors(target).select("rank").distinct().withColumn(
        "path",
        F.explode(ck.lit_array(["iteration", "seed", "optimizer/optimizer/param_groups/0/lr", "optimizer/optimizer/param_groups/1/lr"])),
    )
    return reshard.carry_values(wanted, source.values.join(source.rank_map, "rank"))[0]


@query(
    "r9_diverging_values",
    """SELECT o_orderpriority AS path, min('int' || o_orderstatus)[4:] AS least, max('int' || o_orderstatus)[4:] AS greatest
    FROM orders GROUP BY 1 HAVING min(o_orderstatus) <> max(o_orderstatus)""",
)
def r9_differs(spark, sf):
    values = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("pp"), F.col("o_orderkey").alias("mp"), F.lit(0).alias("dp"),
        F.col("o_orderpriority").alias("path"), F.lit("int").alias("dtype"), F.col("o_orderstatus").alias("value"),
    )
    return reshard.carry_values(values.select("path").distinct(), values)[1]


@query(
    "r10_renumber_params",
    BOTH + """SELECT r.rank, 'optimizer/optimizer/param_groups/' || p.grp || '/params/' || p.idx AS path,
      (p.idx + CASE WHEN p.grp = 1 THEN g.g0 ELSE 0 END)::VARCHAR AS value
    FROM ranks r JOIN b_p p ON p.pp = (r.rank % 15) // 3 JOIN b_g g ON g.pp = p.pp""",
)
def r10(spark, sf):
    target = ck.state_of(spark, sf, ck.TARGET)
    first = target.rank_map.filter("dp = 0").select("rank", "pp", "mp")
    values = structure.state_leaves(target.structure)[1].join(first, "rank").drop("rank")
    everywhere = values.join(target.rank_map.select("rank", "pp", "mp"), ["pp", "mp"]).filter(F.col("path").contains("/params/"))
    blank = everywhere.select("rank", "pp", "path", F.lit("0").alias("value"))
    sizes = structure.group_sizes(target.structure, target.rank_map, "fp16").filter("`group` = 0")
    return reshard.renumber_params(blank, sizes, "fp16").drop("pp")


@query(
    "r11_vocab_padding",
    """SELECT p_partkey, (30000 + p_partkey + 128 * (1 + p_size % 8) - 1) // (128 * (1 + p_size % 8)) * 128 * (1 + p_size % 8) AS padded FROM part""",
)
def r11(spark, sf):
    mp = (F.col("p_size") % 8 + 1).cast("bigint")
    return table(spark, sf, "part").select("p_partkey", reshard.vocab_padding(F.col("p_partkey") + 30000, mp).alias("padded"))


RNG = "rng_state/0/np_rng_state/1"


# The random state is a tensor file under a leaf that the structure calls a value.
@query(
    "r9_random_state",
    BOTH + f"""SELECT r.rank, '{RNG}' AS path, round(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE)), 5) AS total
    FROM ranks r, embeddings e WHERE e.vec_id = 0""",
)
def r9_random_state(spark, sf):
    source, target = both(spark, sf, data=True)

    def with_rng(state):
        ranks = state.rank_map.filter("dp = 0").select("rank")
        leaf = ranks.select(
            F.lit("c").alias("config_id"), "rank", F.lit(RNG).alias("path"), F.split(F.lit(RNG), "/").alias("parts"),
            F.lit(1000000).cast("bigint").alias("ord"), F.lit("value").alias("kind"), F.lit(None).cast("array<bigint>").alias("shape"),
            F.lit(None).cast("bigint").alias("length"), F.lit("NotPrimitiveNorTensor").alias("value"), F.lit("str").alias("dtype"),
        )
        return state.structure.unionByName(leaf), ranks

    structure_rows, ranks = with_rng(source)
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("rank"), "embedding").join(ranks, "rank")
    shape, zero = F.array(F.lit(64).cast("bigint")), F.array(F.lit(0).cast("bigint"))
    rng = vectors.select(
        "rank", F.lit(RNG).alias("path"), F.lit("f32").alias("dtype"), shape.alias("shape"), zero.alias("chunk_offset"),
        shape.alias("chunk_shape"), tensors.encode_elements(F.col("embedding"), "f32").alias("data"),
    )
    rng = byref.store_chunks(rng, new_shared_path(spark, "random-state"))
    source = replace(source, structure=structure_rows, tensors=source.tensors.unionByName(rng))
    target = replace(target, structure=with_rng(target)[0])
    out = reshard.migrate_state(source, target, ck.change_of(spark, sf), 50)
    lost = out["violations"].filter(F.col("path") == RNG).select("rank", "path", F.lit(None).cast("double").alias("total"))
    total = F.aggregate(tensors.decode_array("f32"), F.lit(0.0), lambda a, x: a + x)
    return out["tensors"].filter(F.col("path") == RNG).select("rank", "path", F.round(total, 5).alias("total")).unionByName(lost)


# All rows of the target: tensors by line, values, lists, step markers, and what the source ranks differ in.
MIGRATED = (
    CONTENT
    + """SELECT rank, 'tensor' AS kind, path, line, round(total, 5) AS total FROM content
    UNION ALL SELECT r.rank, 'value', v.path, NULL, v.value FROM ranks r, (VALUES ('iteration', 50.0), ('seed', 0.0),
      ('optimizer/optimizer/param_groups/0/lr', 0.1), ('optimizer/optimizer/param_groups/1/lr', 0.2)) v(path, value)
    UNION ALL SELECT r.rank, 'value', 'optimizer/optimizer/param_groups/' || p.grp || '/params/' || p.idx, NULL,
      (p.idx + CASE WHEN p.grp = 1 THEN g.g0 ELSE 0 END)::DOUBLE FROM ranks r JOIN b_p p ON p.pp = (r.rank % 15) // 3 JOIN b_g g ON g.pp = p.pp
    UNION ALL SELECT r.rank, 'list', 'optimizer/optimizer/param_groups/' || p.grp || '/params', NULL, count(*)::DOUBLE
      FROM ranks r JOIN b_p p ON p.pp = (r.rank % 15) // 3 GROUP BY r.rank, p.grp
    UNION ALL SELECT rank, 'list', 'optimizer/optimizer/param_groups', NULL, 2 FROM ranks
    UNION ALL SELECT rank, 'step', NULL, NULL, 50 FROM ranks
    UNION ALL SELECT NULL, 'source ranks differ', 'seed', NULL, 0"""
)


def migrated(moved, values, lists, step, violations):
    """One table of all that a migration made."""
    none, text = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    number = lambda c: c.cast("double")
    parts = [
        line_totals(moved).select("rank", F.lit("tensor").alias("kind"), "path", "line", "total"),
        values.select("rank", F.lit("value").alias("kind"), "path", none.alias("line"), number(F.col("value")).alias("total")),
        lists.select("rank", F.lit("list").alias("kind"), "path", none.alias("line"), number(F.col("length")).alias("total")),
        step.select("rank", F.lit("step").alias("kind"), text.alias("path"), none.alias("line"), number(F.col("step")).alias("total")),
        violations.select("rank", F.col("reason").alias("kind"), "path", none.alias("line"), F.lit(0.0).alias("total")),
    ]
    result = parts[0]
    for other in parts[1:]:
        result = result.unionByName(other)
    return result


@query("r12_migrate_state", MIGRATED)
def r12(spark, sf):
    source, target = both(spark, sf, data=True)
    out = reshard.migrate_state(source, target, ck.change_of(spark, sf), 50)
    return migrated(out["tensors"], out["values"], out["lists"], out["step"], out["violations"])


@query("r12_migrate_files", MIGRATED)
def r12_files(spark, sf):
    """From one state directory into another, which is read back."""
    source, target = both(spark, sf)
    out = new_shared_path(spark, "migrated")
    told = reshard.migrate_files(spark, ck.state_dir(spark, sf, ck.SOURCE), "save", source, target, ck.change_of(spark, sf), 50, out, "load")
    moved, values, lists, bad = state.read_state_dir(spark, out)
    # The directory has one marker for all ranks.
    step = target.rank_map.select("rank", F.lit(state.read_step(spark, out)).cast("bigint").alias("step"))
    lost = bad.unionByName(told["unread"]).select(F.lit(None).cast("bigint").alias("rank"), F.col("file").alias("path"), "reason")
    return migrated(moved, values, lists, step, told["violations"].select("rank", "path", "reason").unionByName(lost))


@query(
    "r13_replicate_audit",
    PLAN + """SELECT replace(source_path, '/', '-') AS "source-key", replace(path, '/', '-') AS "target-key", source_pp * 4 AS "source-device",
      'pp' || source_pp || '-mp0-dp0' AS "source-mdp-rank", rank AS "target-device", 'pp' || pp || '-mp' || mp || '-dp' || dp AS "target-mdp-rank"
    FROM plan WHERE action = 'replicate'""",
)
def r13_replicate(spark, sf):
    return reshard.replicate_audit(plan_of(spark, sf)[0], ck.rank_map(spark, sf, ck.SOURCE))


@query(
    "r13_repartition_audit",
    PLAN + """SELECT source_shape AS "source-shape", shape AS "target-shape", rank AS "target-device", 'pp' || pp || '-mp' || mp || '-dp' || dp AS "target-mdp-rank",
      source_pp AS "source-pp-rank", replace(source_path, '/', '-') AS "source-key", replace(path, '/', '-') AS "target-key",
      'map[' || string_agg(source_mp || ':[' || lo || ' ' || hi || ']', ' ' ORDER BY source_mp) || ']' AS requests
    FROM plan WHERE action = 'repartition' GROUP BY ALL""",
)
def r13_repartition(spark, sf):
    return reshard.repartition_audit(plan_of(spark, sf)[0])


def traffic_sql(source_host: str, same: str) -> str:
    return PLAN + f""", e AS (SELECT {source_host} AS source_host, rank // 8 AS target_host, source_pp * 4 + source_mp AS dev, rank,
      4 * CASE WHEN action = 'replicate' THEN CASE WHEN contains(shape, '-') THEN split_part(shape, '-', 1)::BIGINT * split_part(shape, '-', 2)::BIGINT ELSE shape::BIGINT END
        WHEN kind = 'attention_b' THEN hi - lo ELSE (hi - lo) * 64 END AS bytes FROM plan WHERE action <> 'pad'),
    l AS (SELECT source_host, target_host, bytes, CASE WHEN source_host <> target_host THEN 'remote' ELSE {same} END AS locality FROM e)
    SELECT source_host, target_host, locality, sum(bytes)::BIGINT AS bytes, count(*) AS transfers FROM l GROUP BY ROLLUP (source_host, target_host, locality)"""


def traffic(spark, sf, central):
    source, target = both(spark, sf)
    plan, _ = reshard.plan_migration(source, target, ck.change_of(spark, sf))
    types = plan.select("source_pp", "source_path").distinct().withColumn("dtype", F.lit("f32"))
    return reshard.plan_traffic(plan, source.rank_map, types, 8, 4, central)


@query(
    "r14_plan_traffic",
    traffic_sql("(source_pp * 4 + source_mp) // 8", "CASE WHEN dev % 8 // 4 = rank % 8 // 4 THEN 'same container' ELSE 'same host' END"),
)
def r14(spark, sf):
    return traffic(spark, sf, False)


@query("r14_plan_traffic_central", traffic_sql("0::BIGINT", "'same host'"))
def r14_central(spark, sf):
    return traffic(spark, sf, True)
