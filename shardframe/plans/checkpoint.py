"""A checkpoint whose depth grows with ``supplier`` and whose data are the ``embeddings`` vectors.

Each supplier is a layer of four tensors: attention weight [48, 64] (rows split), attention bias [48],
output weight [64, 48] (columns split) and norm weight [64] (whole). Stage 0 adds the embedding table, one
row per vector padded as a vocabulary; the last stage a final norm and, with more than one stage, the tied
head. Every model tensor has an optimizer state and a full-precision twin.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from shardframe.operators import byref, tensors
from shardframe.operators.reshard import Change, State
from shardframe.operators.skew import fits_broadcast
from shardframe.plans.registry import table
from shardframe.session import cut_lineage, new_shared_path, shared_once, store
from shardframe.sources import state
from shardframe.sources.files import io_parts

WIDTH, ROWS, TABLE_CHUNK = 64, 48, 32
#: Parameters whose three tensors one task makes.
TASK_PARAMS = 16_000
SOURCE, TARGET = (2, 4, 1), (5, 3, 2)

LANGUAGE = ["model", "language_model"]
KINDS = ("attention_w", "attention_b", "output_w", "norm_w")


def lit_array(values):
    return F.array(*[F.lit(v) for v in values])


def change_of(spark, sf, precision="fp16") -> Change:
    """Degrees of the test change and the depth, a count of one small column."""
    depth = table(spark, sf, "supplier").count()
    return Change(SOURCE[0], SOURCE[1], TARGET[0], TARGET[1], depth, precision)


def parameters(spark, sf, degrees):
    """Model tensors at dp 0: ``(rank, pp, mp, ord, kind, layer, parts, shape, group, index)``.

    ``layer`` is global, -1 outside the layers.
    """
    pp, mp, _ = degrees
    depth = table(spark, sf, "supplier").agg(F.count(F.lit(1))).scalar()
    vocab = table(spark, sf, "embeddings").agg(F.count(F.lit(1))).scalar()
    per_stage = F.call_function("div", depth, F.lit(pp).cast("bigint"))
    multiple = 128 * mp
    table_rows = F.call_function("div", vocab + (multiple - 1), F.lit(multiple).cast("bigint")) * 128
    layers = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("layer"),
        F.call_function("div", F.col("s_suppkey"), per_stage).alias("pp"),
        (F.col("s_suppkey") % per_stage).alias("l"),
        per_stage.alias("n"),
        table_rows.alias("table_rows"),
    )
    ranks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(mp - 1).cast("bigint")))
    names = dict(zip(KINDS, ("attention.weight", "attention.bias", "output.weight", "norm.weight")))
    part = ROWS // mp
    shapes = {
        "attention_w": f"array({part}L, {WIDTH}L)", "attention_b": f"array({part}L)",
        "output_w": f"array({WIDTH}L, {part}L)", "norm_w": f"array({WIDTH}L)",
    }
    first = (F.col("pp") == 0).cast("bigint")
    rows = [
        F.struct(
            F.lit(kind).alias("kind"),
            (F.col("l") * 4 + i + 1).cast("bigint").alias("ord"),
            F.concat(
                lit_array([*LANGUAGE, "encoder"]),
                F.array(F.format_string(f"layers.%d.{names[kind]}", "l")),
            ).alias("parts"),
            F.expr(shapes[kind]).alias("shape"),
            F.lit(i % 2).cast("bigint").alias("group"),
            (F.col("l") * 2 + i // 2 + (first if i % 2 == 0 else 0)).cast("bigint").alias("index"),
        )
        for i, kind in enumerate(KINDS)
    ]
    per_layer = layers.select("pp", "layer", F.explode(F.array(*rows)).alias("t"))

    def special(kind, ord_, parts, shape, group, index):
        return F.struct(
            F.lit(kind).alias("kind"), ord_.cast("bigint").alias("ord"), lit_array(parts).alias("parts"),
            shape.alias("shape"), F.lit(group).cast("bigint").alias("group"), index.cast("bigint").alias("index"),
        )

    after = F.col("n") * 4
    wide = F.array(F.col("table_rows"), F.lit(WIDTH).cast("bigint"))
    line = F.expr(f"array({WIDTH}L)")
    opening = layers.filter("layer = 0").select(
        "pp", F.array(special("embedding", F.lit(0), [*LANGUAGE, "embedding", "word_embeddings", "weight"], wide, 0, F.lit(0))).alias("t")
    )
    closing_rows = [
        special("final_w", after + 1, [*LANGUAGE, "encoder", "final_layernorm.weight"], line, 1, F.col("n") * 2),
        special("final_b", after + 2, [*LANGUAGE, "encoder", "final_layernorm.bias"], line, 1, F.col("n") * 2 + 1),
    ]
    if pp > 1:
        closing_rows.append(special("head", after + 3, ["model", "word_embeddings_for_head", "weight"], wide, 0, F.col("n") * 2))
    closing = layers.filter((F.col("pp") == pp - 1) & (F.col("l") == F.col("n") - 1)).select("pp", F.array(*closing_rows).alias("t"))
    ends = opening.unionByName(closing).select("pp", F.lit(-1).cast("bigint").alias("layer"), F.explode("t").alias("t"))
    flat = per_layer.unionByName(ends).select("pp", "layer", "t.*", ranks.alias("mp"))
    return flat.withColumn("rank", F.col("pp") * mp + F.col("mp"))


def group_zero(params):
    """Size of group 0 per stage."""
    return params.filter("mp = 0 AND `group` = 0").groupBy("pp").agg(F.count(F.lit(1)).alias("g0"))


def tensor_paths(params):
    """The three tensors of each parameter: adds ``set`` (0 model, 1 state, 2 full precision), ``path``."""
    sized = params.join(group_zero(params), "pp")
    x = F.col("index") + F.when(F.col("group") == 1, F.col("g0")).otherwise(F.lit(0))
    root = lit_array(["optimizer", "optimizer", "state"])
    paths = [
        F.col("parts"),
        F.concat(root, F.array(x.cast("string"), F.lit("exp_avg"))),
        F.concat(
            lit_array(["optimizer", "fp32_from_fp16_params"]),
            F.array(F.col("group").cast("string"), F.col("index").cast("string")),
        ),
    ]
    exploded = sized.withColumn(
        "_p", F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("set"), p.alias("p")) for i, p in enumerate(paths)]))
    )
    return exploded.select(
        "rank", "pp", "mp", "kind", "layer", "group", "index", "shape", "ord",
        F.col("_p.set").alias("set"), F.col("_p.p").alias("parts"), F.array_join("_p.p", "/").alias("path"),
    )


def rank_map(spark, sf, degrees):
    """Ranks of a configuration, dp outermost."""
    pp, mp, dp = degrees
    n = pp * mp * dp
    return spark.range(n).select(
        F.lit("c").alias("config_id"), F.col("id").alias("rank"),
        F.expr(f"(id % {pp * mp}) div {mp}").alias("pp"), F.expr(f"id % {mp}").alias("mp"), F.expr(f"id div {pp * mp}").alias("dp"),
    )


def values_of(params):
    """Scalar leaves: a step, a learning rate per group, and the index lists."""
    stages = params.select("rank", "pp").distinct()
    group = "optimizer/optimizer/param_groups"
    fixed = stages.select(
        "rank",
        F.explode(
            F.array(
                F.struct(F.lit("iteration").alias("path"), F.lit("int").alias("dtype"), F.lit("50").alias("value")),
                F.struct(F.lit(f"{group}/0/lr").alias("path"), F.lit("float").alias("dtype"), F.lit("0.1").alias("value")),
                F.struct(F.lit(f"{group}/1/lr").alias("path"), F.lit("float").alias("dtype"), F.lit("0.2").alias("value")),
                F.struct(F.lit("seed").alias("path"), F.lit("int").alias("dtype"), F.col("rank").cast("string").alias("value")),
            )
        ).alias("v"),
    ).select("rank", "v.*")
    sized = params.join(group_zero(params), "pp")
    index = F.col("index") + F.when(F.col("group") == 1, F.col("g0")).otherwise(F.lit(0))
    listed = sized.select(
        "rank", F.format_string(f"{group}/%d/params/%d", "group", "index").alias("path"), F.lit("int").alias("dtype"),
        index.cast("string").alias("value"),
    )
    return fixed.unionByName(listed)


def structure_of(params):
    """Structure rows with the columns of a flattened document."""
    def rows(df, kind, shape="CAST(NULL AS array<bigint>)", length="CAST(NULL AS bigint)", value="CAST(NULL AS string)", dtype="CAST(NULL AS string)", ord_="1000000L"):
        return df.select(
            F.lit("c").alias("config_id"), "rank", "path", F.split("path", "/").alias("parts"), F.expr(ord_).alias("ord"),
            F.lit(kind).alias("kind"), F.expr(shape).alias("shape"), F.expr(length).alias("length"),
            F.expr(value).alias("value"), F.expr(dtype).alias("dtype"),
        )

    group = "optimizer/optimizer/param_groups"
    counts = params.groupBy("rank", "group").agg(F.count(F.lit(1)).alias("n"))
    lists = counts.select("rank", F.format_string(f"{group}/%d/params", "group").alias("path"), "n").unionByName(
        params.select("rank").distinct().select("rank", F.lit(group).alias("path"), F.lit(2).cast("bigint").alias("n"))
    )
    return (
        rows(tensor_paths(params), "tensor", shape="shape", ord_="ord")
        .unionByName(rows(values_of(params), "value", value="value", dtype="dtype"))
        .unionByName(rows(lists, "list", length="n"))
    )


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding")


def vector_runs(vectors, n):
    """Vectors 0 to ``n`` in overlapping blocks: ``(b, run, whole)``.

    Block ``b`` holds the vectors ``(b * ROWS + e) % n`` for ``e`` up to twice ``ROWS``, by ``e``, so any ``ROWS`` vectors that follow each other lie in the
    block where they begin. It is whole if each of these vectors is there once.
    """
    last, span = F.call_function("div", n - 1, F.lit(ROWS).cast("bigint")), 2 * ROWS
    known = vectors.filter((F.col("vec_id") >= 0) & (F.col("vec_id") < n)).select("vec_id", F.coalesce("embedding", zero_vector()).alias("embedding"), n.alias("_n"), last.alias("_last"))
    # Vectors at the beginning come again behind the end, often if there are few.
    turns = known.withColumn("_p", F.explode(F.expr(f"transform(sequence(0L, (_last * {ROWS} + {span}) div _n), k -> vec_id + k * _n)")))
    placed = turns.withColumn("b", F.explode(F.expr(f"filter(array(_p div {ROWS} - 1, _p div {ROWS}), b -> b >= 0 AND b <= _last)")))
    entry = F.struct((F.col("_p") - F.col("b") * ROWS).alias("e"), "embedding")
    blocks = placed.groupBy("b").agg(F.array_sort(F.collect_list(entry)).alias("run"))
    return blocks.select("b", "run", ((F.size("run") == span) & (F.size(F.array_distinct("run.e")) == span)).alias("whole"))


def zero_vector():
    return F.array_repeat(F.lit(0.0).cast("float"), WIDTH)


def chunks_of(spark, sf, params, mp):
    """Chunk rows of all tensors of ``params``; row ``r`` of layer ``g`` is one vector (see ``vector_of``).

    The vectors of a chunk follow each other, so a chunk meets one block of vectors instead of each of its vectors, and no payload is shuffled once it
    is part of a chunk.
    """
    part = ROWS // mp
    paths = tensor_paths(params).drop("parts", "group", "index", "ord")
    n = table(spark, sf, "embeddings").agg(F.count(F.lit(1))).scalar()
    layered = F.col("kind").isin("attention_w", "attention_b", "output_w")
    tabled = F.col("kind").isin("embedding", "head")
    pieces = F.when(tabled, F.call_function("div", F.col("shape")[0] - 1, F.lit(TABLE_CHUNK).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))
    cut = paths.withColumn("c", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces)))
    # The rows name bytes only, and a task writes those of all of its rows, so their number is explicit.
    tasks = max(io_parts(spark), -(-params.count() // TASK_PARAMS))
    dealt = cut.repartition(tasks, "rank", "path", "c")
    # A tensor that is named several times has each row as often.
    named = dealt.groupBy("rank", "pp", "mp", "path", "kind", "shape", "layer", "set", "c").agg(F.count(F.lit(1)).cast("int").alias("times"))
    lead = F.col("c") * TABLE_CHUNK
    at = F.col("mp") * F.when(layered, part).when(tabled, F.col("shape")[0]).otherwise(0) + lead
    size = F.when(tabled, F.least(F.col("shape")[0] - lead, F.lit(TABLE_CHUNK).cast("bigint"))).when(layered, part).otherwise(1).cast("bigint")
    begun = named.select("*", n.alias("_n"), at.alias("_at"), size.alias("_size"))
    begun = begun.withColumn("_first", vector_of(F.col("_at"), F.col("_n")))
    begun = begun.withColumns(
        {
            "b": F.call_function("div", "_first", F.lit(ROWS).cast("bigint")),
            "_e": F.col("_first") % ROWS,
            "_held": F.when(tabled, F.least(F.col("_size"), F.col("_n") - F.col("_at"))).otherwise(F.col("_size")),
        }
    )
    blocks = store(vector_runs(vectors(spark, sf), n), "vector-runs")
    if fits_broadcast(blocks):
        met = begun.join(F.broadcast(blocks), "b", "left")
    else:
        # A block is met by chunks of many layers, and adaptive execution would join rows that only name bytes into few tasks: blocks are copied
        # until there are some for each task, which are as many as before.
        copies = -(-4 * tasks // max(1, blocks.count()))
        salted = begun.withColumn("_salt", F.pmod(F.xxhash64("rank", "path", "c"), F.lit(copies)).cast("int")).repartition(tasks, "b", "_salt")
        copied = blocks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).repartition(tasks, "b", "_salt")
        met = salted.join(copied.hint("merge"), ["b", "_salt"], "left").drop("_salt")
    plain = F.expr("coalesce(whole, false) AND _held = _size AND times = 1")
    met = met.withColumn("_found", F.when(~plain, F.expr("coalesce(filter(run, x -> x.e >= _e AND x.e < _e + _held), filter(run, x -> false), array())")))
    zero = zero_vector()
    # Rows without a vector are zeros.
    absent = F.array_except(F.expr("sequence(0L, _size - 1)"), F.expr("transform(_found, x -> x.e - _e)"))
    met = met.withColumn("_absent", F.when(~plain, absent)).withColumn("_zero", zero)
    rows = F.concat(
        F.expr("transform(_found, x -> struct(x.e - _e AS j, x.embedding AS embedding))"), F.expr("transform(_absent, j -> struct(j AS j, _zero AS embedding))")
    )
    rows = F.array_sort(F.flatten(F.array_repeat(rows, F.col("times"))))
    met = met.withColumn("v", F.when(plain, F.expr("slice(run, int(_e) + 1, int(_size)).embedding")).otherwise(rows["embedding"]))
    # Columns of the stacked vectors by index; a lambda inside a lambda would not reach the Python encoder.
    turned = F.expr(f"transform(sequence(0, {WIDTH} * size(v) - 1), k -> v[k % size(v)][k div size(v)])")
    flat = F.when(F.col("kind") == "attention_b", F.transform("v", lambda x: x[0])).when(F.col("kind") == "output_w", turned).otherwise(F.flatten("v"))
    offset = F.when(tabled, F.array(lead, F.lit(0).cast("bigint"))).otherwise(F.transform("shape", lambda s: F.lit(0).cast("bigint")))
    box = F.when(tabled, F.array(F.size("v").cast("bigint"), F.lit(WIDTH).cast("bigint"))).otherwise(F.col("shape"))
    return met.select(
        "rank", "path", F.lit("f32").alias("dtype"), "shape", offset.alias("chunk_offset"), box.alias("chunk_shape"),
        tensors.encode_elements(flat, "f32").alias("data"),
    )


def vector_of(at, n):
    """Vector id of row ``at`` of a tensor; rows of tables beyond the vectors have none."""
    shift = F.col("set") * 13
    kind = F.col("kind")
    kind_no = F.when(kind == "attention_w", 0).when(kind == "attention_b", 1).when(kind == "output_w", 2).otherwise(3)
    return (
        F.when(F.col("layer") >= 0, (F.col("layer") * ROWS + at + kind_no * 7 + shift) % n)
        .when(kind.isin("embedding", "head"), F.when(at < n, (at + shift) % n))
        .otherwise((shift + F.when(kind == "final_b", 1).otherwise(0)) % n)
    )


def state_of(spark, sf, degrees, data=False) -> State:
    """Tables of one configuration, made once a session; its tensors are described chunks of files."""

    def tables() -> State:
        params = cut_lineage(parameters(spark, sf, degrees))
        return State(structure=cut_lineage(structure_of(params)), rank_map=rank_map(spark, sf, degrees), values=cut_lineage(values_of(params)))

    def chunks():
        params = cut_lineage(parameters(spark, sf, degrees))
        return byref.store_chunks(chunks_of(spark, sf, params, degrees[1]), new_shared_path(spark, "chunks"))

    made = shared_once(spark, ("checkpoint", sf, degrees), tables)
    return replace(made, tensors=shared_once(spark, ("chunks", sf, degrees), chunks)) if data else made


def state_dir(spark, sf, degrees) -> str:
    """A state directory of the configuration, snapshot ``save``, made once a session."""

    def write() -> str:
        out = new_shared_path(spark, "state-dir")
        made = state_of(spark, sf, degrees, data=True)
        files = byref.write_targets(byref.whole_tensors(made.tensors), f"{out}/save")
        leaves = state.write_leaves(made.values, made.structure.filter("kind = 'list'").select("rank", "path", "length"), f"{out}/save")
        files.unionByName(leaves).agg(F.sum("bytes")).collect()
        state.write_step(spark, out, 50)
        return out

    return shared_once(spark, ("state-dir", sf, degrees), write)
