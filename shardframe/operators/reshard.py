"""Checkpoint re-sharding: which source stage, key and range each target tensor comes from, and the move.

A target tensor is a row ``(rank, pp, mp, dp, path, parts, shape)``; the rank is a column throughout, so
one job plans and moves the state of all ranks.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardframe.functions.numbers import as_col, ceil_div, floor_div, prod
from shardframe.operators import byref
from shardframe.operators import structure as st
from shardframe.operators.skew import spread_join
from shardframe.operators.tensors import cut_chunks, item_size, pad_tensors
from shardframe.session import cut_lineage, qualify, store
from shardframe.sources import state

# Names in the checkpoints.
FIRST_STAGE_KEYS = ("embedding",)
LAST_STAGE_KEYS = (
    "word_embeddings_for_head", "final_layernorm.weight", "final_layernorm.bias", "pooler", "lm_head", "binary_head",
)
TIED_HEAD = "word_embeddings_for_head"
TIED_SOURCE = ("language_model", "embedding", "word_embeddings")
VOCAB_MULTIPLE = 128


@dataclass(frozen=True)
class Change:
    """Degrees before and after, and the model's depth."""

    source_pp: int
    source_mp: int
    target_pp: int
    target_mp: int
    n_layers: int
    precision: str = "fp16"


def vocab_padding(vocab, mp) -> Column:
    """Vocabulary size rounded up to a multiple of ``128 * mp``."""
    multiple = as_col(mp) * VOCAB_MULTIPLE
    return ceil_div(vocab, multiple) * multiple


def layer_place(layer, stage, n_layers, source_pp, target_pp) -> Column:
    """Struct ``(global_layer, source_pp, source_layer)`` of a local layer of a target stage.

    Null source for the layers that a division with remainder leaves over.
    """
    per_target = floor_div(n_layers, target_pp)
    per_source = floor_div(n_layers, source_pp)
    g = as_col(layer) + as_col(stage) * per_target
    s = floor_div(g, per_source)
    known = F.when(s < as_col(source_pp), s)
    return F.struct(
        g.cast("bigint").alias("global_layer"), known.alias("source_pp"), (g - known * per_source).cast("bigint").alias("source_layer")
    )


def layer_of(parts: Column) -> Column:
    """Layer number in the first key part that names one, else null."""
    named = F.try_element_at(F.filter(parts, lambda p: p.contains("layers.")), F.lit(1))
    return F.regexp_extract(named, r"layers\.(\d+)\.", 1).try_cast("bigint")


def with_layer(parts: Column, layer: Column) -> Column:
    """Key parts with the layer number of the first such part replaced."""
    first = F.array_position(F.transform(parts, lambda p: p.contains("layers.")), True)
    new = F.concat(F.lit("layers."), layer.cast("string"))
    return F.transform(
        parts, lambda p, i: F.when(i + 1 == first, F.regexp_replace(p, F.lit(r"layers\.(\d+)"), new)).otherwise(p)
    )


def _layer_source(parts: Column, change: Change) -> Column:
    """Struct ``(pp, parts)`` for a key inside a layer."""
    place = layer_place(layer_of(parts), "pp", change.n_layers, change.source_pp, change.target_pp)
    return F.struct(place["source_pp"].alias("pp"), with_layer(parts, place["source_layer"]).alias("parts"))


def names_layers(parts: Column) -> Column:
    """True when a key part names layers."""
    return F.exists(parts, lambda p: p.contains("layers."))


def map_layers(df: DataFrame, change: Change) -> DataFrame:
    """Rows whose key names a layer, with ``source_pp`` and ``source_parts`` (null when left over)."""
    layered = df.filter(names_layers(F.col("parts"))).withColumn("_s", _layer_source(F.col("parts"), change))
    return layered.select(*df.columns, F.col("_s.pp").alias("source_pp"), F.col("_s.parts").alias("source_parts"))


def _has_any(parts: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))


def stage_of_key(parts: Column, source_pp: int) -> Column:
    """Source stage of a key outside the layers, null for an unknown one."""
    return F.when(_has_any(parts, FIRST_STAGE_KEYS), F.lit(0).cast("bigint")).when(
        _has_any(parts, LAST_STAGE_KEYS), F.lit(source_pp - 1).cast("bigint")
    )


def _stage_source(parts: Column, change: Change) -> Column:
    """Struct ``(pp, parts)`` for a model key outside the layers; the tied head reads the embedding."""
    head = F.array_position(parts, TIED_HEAD).cast("int")
    tied = F.concat(
        F.slice(parts, F.lit(1), F.greatest(head - 1, F.lit(0))),
        F.array(*[F.lit(p) for p in TIED_SOURCE]),
        F.slice(parts, head + 1, F.size(parts)),
    )
    is_tied = F.array_contains(parts, TIED_HEAD)
    stage = F.when(is_tied, F.lit(0).cast("bigint")).otherwise(stage_of_key(parts, change.source_pp))
    return F.struct(stage.alias("pp"), F.when(is_tied, tied).otherwise(parts).alias("parts"))


def map_stage_keys(df: DataFrame, change: Change) -> DataFrame:
    """Rows outside the layers, with ``source_pp`` and ``source_parts``."""
    outside = df.filter(~names_layers(F.col("parts"))).withColumn("_s", _stage_source(F.col("parts"), change))
    return outside.select(*df.columns, F.col("_s.pp").alias("source_pp"), F.col("_s.parts").alias("source_parts"))


def stage_bases(sizes: DataFrame, prefix: str) -> DataFrame:
    """Per stage the size of group 0 and, per group, the sizes of all earlier stages.

    One row per pipeline stage, so the window over all rows is as small as the pipeline is deep.
    """
    stages = sizes.groupBy("pp").agg(*[F.sum(F.when(F.col("group") == g, F.col("size"))).alias(f"s{g}") for g in (0, 1)])
    before = Window.partitionBy(F.lit(0)).orderBy("pp").rowsBetween(Window.unboundedPreceding, -1)
    bases = [F.coalesce(F.sum(f"s{g}").over(before), F.lit(0)).alias(f"{prefix}base{g}") for g in (0, 1)]
    return stages.select("pp", F.col("s0").alias(f"{prefix}g0"), *bases)


def map_optimizer_keys(
    df: DataFrame,
    change: Change,
    target_groups: DataFrame,
    target_sizes: DataFrame,
    source_groups: DataFrame,
    source_sizes: DataFrame,
) -> DataFrame:
    """Optimizer rows with ``source_pp`` and ``source_parts`` (null when the index maps nowhere).

    Groups are ``(pp, mp, group, index, parts)`` of weight-decay splits at dp 0, sizes ``(pp, group, size)``.
    An index is made global by the sizes of earlier target stages, then local to the source stage.
    """
    is_state = F.array_contains("parts", "state")
    number = r"^[+-]?\d+$"
    n = F.size("parts")
    state_index = F.try_element_at(F.filter("parts", lambda p: p.rlike(number)), F.lit(1)).try_cast("bigint")
    keyed = df.withColumns(
        {
            "_state": is_state,
            "_x": F.when(is_state, state_index).otherwise(F.try_element_at("parts", n).try_cast("bigint")),
            "_told": F.when(~is_state, F.try_element_at("parts", n - 1).try_cast("bigint")),
        }
    )
    in_group = keyed.join(stage_bases(target_sizes, "_t"), "pp", "left").withColumn(
        "_group", F.when(F.col("_state"), (F.col("_x") >= F.col("_tg0")).cast("bigint")).otherwise(F.col("_told"))
    )
    in_group = in_group.withColumn(
        "_i", F.when(F.col("_state") & (F.col("_group") == 1), F.col("_x") - F.col("_tg0")).otherwise(F.col("_x"))
    )
    names = target_groups.select(
        "pp", "mp", F.col("group").alias("_group"), F.col("index").alias("_i"), F.col("parts").alias("_name")
    )
    named = in_group.join(names, ["pp", "mp", "_group", "_i"], "left")
    place = layer_place(layer_of(F.col("_name")), "pp", change.n_layers, change.source_pp, change.target_pp)
    tied = F.array_contains("_name", TIED_HEAD) & F.lit(change.source_pp == 1)
    staged = named.withColumn("_tied", F.coalesce(tied, F.lit(False))).withColumn(
        "source_pp",
        F.when(F.col("_tied"), F.lit(0).cast("bigint"))
        .when(names_layers(F.col("_name")), place["source_pp"])
        .otherwise(stage_of_key(F.col("_name"), change.source_pp)),
    )
    embedding = F.lit(None).cast("bigint")
    if change.source_pp == 1:
        sub_path = "/".join(TIED_SOURCE)
        embedding = (
            source_groups.filter((F.col("pp") == 0) & (F.col("mp") == 0) & (F.col("group") == 0))
            .filter(F.concat(F.lit("/"), F.array_join("parts", "/"), F.lit("/")).contains(f"/{sub_path}/"))
            .agg(F.min("index"))
            .scalar()
        )
    based = staged.join(stage_bases(source_sizes, "_s").withColumnRenamed("pp", "source_pp"), "source_pp", "left")

    def of_group(prefix: str) -> Column:
        return F.when(F.col("_group") == 0, F.col(f"{prefix}base0")).when(F.col("_group") == 1, F.col(f"{prefix}base1"))

    local = F.col("_i") + of_group("_t") - of_group("_s")
    shift = F.when(F.col("_state") & (F.col("_group") == 1), F.col("_sg0")).otherwise(F.lit(0))
    index = F.when(F.col("_tied"), embedding).when(local >= 0, local + shift)
    told = F.col("_x").cast("string")
    new = F.col("_new").cast("string")
    replaced = F.when(
        F.col("_state"), F.transform("parts", lambda p: F.when(p == told, new).otherwise(p))
    ).otherwise(F.concat(F.slice("parts", F.lit(1), n - 1), F.array(new)))
    out = based.withColumn("_new", index).withColumn("source_parts", F.when(F.col("_new").isNotNull(), replaced))
    return out.select(*df.columns, "source_pp", "source_parts")


def source_keys(
    target: DataFrame,
    change: Change,
    target_groups: DataFrame,
    target_sizes: DataFrame,
    source_groups: DataFrame,
    source_sizes: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Source stage and key of every target tensor, and the tensors that have none."""
    same = F.array_contains("parts", "rng_state") | ((F.size("shape") == 1) & (F.try_element_at("shape", F.lit(1)) == 1))
    kind = (
        F.when(same, "same")
        .when(F.array_contains("parts", "model"), "model")
        .when(F.array_contains("parts", "optimizer"), "optimizer")
        .otherwise("none")
    )
    tagged = target.withColumn("_kind", kind)
    parts = F.col("parts")
    nowhere = F.struct(F.lit(None).cast("bigint").alias("pp"), F.lit(None).cast("array<string>").alias("parts"))
    by_key = (
        F.when(F.col("_kind") == "same", F.struct(F.lit(0).cast("bigint").alias("pp"), parts.alias("parts")))
        .when((F.col("_kind") == "model") & names_layers(parts), _layer_source(parts, change))
        .when(F.col("_kind") == "model", _stage_source(parts, change))
        .otherwise(nowhere)
    )
    direct = tagged.filter("_kind <> 'optimizer'").withColumn("_s", by_key)
    optimizer = tagged.filter("_kind = 'optimizer'").drop("_kind")
    mapped = direct.select(
        *target.columns, F.col("_s.pp").alias("source_pp"), F.col("_s.parts").alias("source_parts")
    ).unionByName(map_optimizer_keys(optimizer, change, target_groups, target_sizes, source_groups, source_sizes))
    known = F.col("source_pp").isNotNull() & F.col("source_parts").isNotNull()
    found = mapped.filter(known).withColumn("source_path", F.array_join("source_parts", "/"))
    return found, mapped.filter(~known).drop("source_pp", "source_parts").withColumn("reason", F.lit("no source key"))


def overlap_parts(a: Column, b: Column, src_mp: Column, q: Column) -> Column:
    """Source parts that target part ``q`` of length ``b`` overlaps: structs ``(source_mp, lo, hi, dst_lo)``."""
    first = floor_div(q * b, a)
    last = F.least(floor_div((q + 1) * b - 1, a), src_mp - 1)
    ranks = F.when((b > 0) & (a > 0) & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    def one(r: Column) -> Column:
        start, stop = F.greatest(q * b, r * a), F.least((q + 1) * b, (r + 1) * a)
        return F.struct(
            r.alias("source_mp"), (start - r * a).alias("lo"), (stop - r * a).alias("hi"), (start - q * b).alias("dst_lo")
        )

    return F.transform(ranks, one)


def missing_rows(a: Column, b: Column, src_mp: Column, q: Column) -> Column:
    """Rows of the target part that lie beyond all source parts."""
    return b - F.greatest(F.lit(0).cast("bigint"), F.least((q + 1) * b, src_mp * a) - q * b)


def overlap_ranges(df: DataFrame, src_dim: str, dst_dim: str, src_mp, dst_rank: str) -> DataFrame:
    """Explode each target part into the overlapping source parts: ``(…, source_mp, lo, hi, dst_lo, pad)``.

    ``pad`` is the number of target rows that no source part holds; a target part without any source part
    keeps one row with null ranges.
    """
    box = [F.col(src_dim), F.col(dst_dim), as_col(src_mp).cast("bigint"), F.col(dst_rank)]
    return df.select(
        *df.columns, missing_rows(*box).alias("pad"), F.explode_outer(overlap_parts(*box)).alias("_o")
    ).select(*df.columns, "_o.source_mp", "_o.lo", "_o.hi", "_o.dst_lo", "pad")


def transfer_plan(target: DataFrame, source_shapes: DataFrame, change: Change) -> tuple[DataFrame, DataFrame]:
    """How every target tensor is filled, and the tensors that cannot be.

    ``target`` comes from :func:`source_keys`, ``source_shapes(pp, path, shape)`` from the source ranks with
    mp = dp = 0. Actions are ``replicate`` (a copy), ``repartition`` (rows ``[lo, hi)`` of dimension ``dim``
    of one source part go to ``dst_lo``) and ``pad`` (zero rows from ``dst_lo`` on).
    """
    shapes = source_shapes.select(
        F.col("pp").alias("source_pp"), F.col("path").alias("source_path"), F.col("shape").alias("source_shape")
    )
    joined = target.join(shapes, ["source_pp", "source_path"], "left")
    equal = F.col("shape") == F.col("source_shape")
    same_rank = F.size("shape") == F.size("source_shape")
    differ = F.expr("filter(transform(shape, (s, i) -> if(s <> source_shape[i], i, -1)), i -> i >= 0)")
    sized = joined.withColumn("_dims", F.when(same_rank & ~equal, differ)).withColumn(
        "dim", F.coalesce(F.try_element_at("_dims", F.lit(1)), F.lit(0)).cast("bigint")
    )
    sized = sized.withColumn("_a", F.expr("get(source_shape, int(dim))")).withColumn("_b", F.expr("get(shape, int(dim))"))
    box = [F.col("_a"), F.col("_b"), F.lit(change.source_mp).cast("bigint"), F.col("mp")]
    sized = sized.withColumn("_pad", F.when(same_rank & ~equal, missing_rows(*box)))
    reason = (
        F.when(F.col("source_shape").isNull(), "no source tensor")
        .when(~same_rank, "rank mismatch")
        .when(F.size("_dims") > 1, "several unequal dimensions")
        .when((F.col("_pad") > 0) & (F.col("dim") > 0), "only the leading dimension can grow")
    )
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")

    def action(name: str, source_mp: Column, lo: Column, hi: Column, dst_lo: Column) -> Column:
        fields = {"source_mp": source_mp, "lo": lo, "hi": hi, "dst_lo": dst_lo}
        return F.struct(F.lit(name).alias("action"), *[c.cast("bigint").alias(n) for n, c in fields.items()])

    whole = F.coalesce(F.try_element_at("shape", F.lit(1)), F.lit(1))
    copy = action("replicate", F.col("mp") if change.source_mp == change.target_mp else zero, zero, whole, zero)
    moves = F.transform(
        overlap_parts(*box), lambda o: action("repartition", o["source_mp"], o["lo"], o["hi"], o["dst_lo"])
    )
    pad = action("pad", none, zero, F.col("_pad"), F.col("_b") - F.col("_pad"))
    steps = (
        F.when(F.col("reason").isNotNull(), F.array(action("error", none, none, none, none)))
        .when(equal, F.array(copy))
        .when(F.col("_pad") > 0, F.concat(moves, F.array(pad)))
        .otherwise(moves)
    )
    planned = sized.withColumn("reason", reason).withColumn("_step", F.explode(steps)).select(
        "rank", "pp", "mp", "dp", "path", "shape", "source_pp", "source_path", "source_shape",
        "_step.action", "_step.source_mp", "dim", "_step.lo", "_step.hi", "_step.dst_lo", "reason",
    )
    planned = cut_lineage(planned)
    bad = planned.filter("action = 'error'").select("rank", "path", "source_path", "reason")
    return planned.filter("action <> 'error'").drop("reason"), bad


def apply_plan(tensors: DataFrame, plan: DataFrame) -> DataFrame:
    """Move chunks: ``tensors(pp, mp, path, …)`` of the source at dp 0 to ``(rank, path, …)`` of the target.

    Chunks are copied to every plan row that overlaps them. Copies keep their bytes; a cut on the leading
    dimension is a substring. Large tensors are many chunks, so their key is salted.
    """
    moves = plan.filter("action <> 'pad'").select(
        F.col("source_pp"), F.col("source_mp"), "source_path", "rank", "path", "shape", "action", "dim", "lo", "hi", "dst_lo"
    ).withColumnRenamed("shape", "target_shape")
    chunks = tensors.select(
        F.col("pp").alias("source_pp"), F.col("mp").alias("source_mp"), F.col("path").alias("source_path"),
        "dtype", "shape", "chunk_offset", "chunk_shape", "data",
    )
    joined = spread_join(
        chunks, moves, ["source_pp", "source_mp", "source_path"], ["chunk_offset"], weight=prod("chunk_shape") * item_size()
    )
    # Arrays without elements (scalars) have nothing to cut.
    boxed = joined.withColumn("_l", F.expr("transform(shape, (s, i) -> if(action = 'repartition' AND i = dim, lo, 0L))")).withColumn(
        "_h", F.expr("transform(shape, (s, i) -> if(action = 'repartition' AND i = dim, hi, s))")
    )
    cut = cut_chunks(boxed.drop("source_pp", "source_mp", "source_path", "lo", "hi", "action"), "_l", "_h")
    moved = cut.select(
        "rank", "path", "dtype", F.col("target_shape").alias("shape"),
        F.expr("transform(chunk_offset, (o, i) -> if(i = dim, o + dst_lo, o))").alias("chunk_offset"), "chunk_shape", "data",
    )
    types = tensors.select(
        F.col("pp").alias("source_pp"), F.col("path").alias("source_path"), "dtype"
    ).distinct()
    # Zero rows are chunks of a tensor that starts where the moved rows end.
    pads = plan.filter("action = 'pad'").join(types, ["source_pp", "source_path"]).select(
        "rank", "path", "dtype", F.expr("transform(shape, (s, i) -> if(i = 0, dst_lo, s))").alias("shape"),
        F.col("shape").alias("chunk_offset"), F.col("shape").alias("chunk_shape"), F.lit(None).cast("binary").alias("data"),
        F.col("shape").alias("_to"),
    )
    zeros = pad_tensors(pads, "_to")[0].filter(F.col("data").isNotNull())
    return moved.unionByName(zeros.select(*moved.columns))


def carry_values(target_values: DataFrame, source_values: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Values for ``target_values(rank, path)`` from ``source_values(pp, mp, dp, path, dtype, value)``.

    The value of rank (0, 0, 0) is taken, or of the first rank that has the path. Returns the values, the
    paths on which source ranks differ, and the target rows that no source rank has.
    """
    first = source_values.groupBy("path").agg(
        F.min_by(F.struct("dtype", "value"), F.struct("pp", "mp", "dp")).alias("v"),
        F.min(F.struct("dtype", "value")).alias("a"),
        F.max(F.struct("dtype", "value")).alias("b"),
    )
    carried = target_values.join(first, "path").select(*target_values.columns, "v.dtype", "v.value")
    differs = first.filter(~F.col("a").eqNullSafe(F.col("b"))).select(
        "path", F.col("a.value").alias("least"), F.col("b.value").alias("greatest")
    )
    return carried, differs, target_values.join(first.select("path"), "path", "left_anti")


def asked_arrays(target_values: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which tensors ``(path, pp, mp)`` the value leaves ``target_values(rank, path, …)`` take that the source stores as tensors.

    The tensor of rank (0, 0) is taken, or of the first rank that has the path. Returns ``rank, path, pp, mp`` and the
    leaves that no source rank stores as a tensor.
    """
    first = stored.groupBy("path").agg(F.min(F.struct("pp", "mp")).alias("_p")).select("path", "_p.pp", "_p.mp")
    asked = target_values.select("rank", "path").join(first, "path")
    return asked, target_values.join(first.select("path"), "path", "left_anti").select(*target_values.columns)


def param_pattern(precision: str) -> str:
    """Paths of parameter indices: groups (group, position)."""
    root = "optimizer/optimizer" if precision == "fp16" else "optimizer"
    return rf"^{root}/param_groups/(\d+)/params/(\d+)$"


def renumber_params(values: DataFrame, decay_sizes: DataFrame, precision: str) -> DataFrame:
    """Recompute ``param_groups/g/params/i``: group 1 counts on from the rank's group 0.

    ``values(rank, pp, path, …, value)``, ``decay_sizes(pp, size)``: group-0 size per target stage.
    """
    pattern = param_pattern(precision)
    group = F.regexp_extract("path", pattern, 1).try_cast("bigint")
    index = F.regexp_extract("path", pattern, 2).try_cast("bigint")
    joined = values.join(decay_sizes.select("pp", F.col("size").alias("_size")), "pp", "left")
    fresh = (index + F.when(group == 1, F.col("_size")).otherwise(F.lit(0))).cast("string")
    return joined.withColumn("value", F.when(F.col("path").rlike(pattern), fresh).otherwise(F.col("value"))).select(*values.columns)


def _place_text(pp: str, mp: str, dp) -> Column:
    return F.format_string("pp%d-mp%d-dp%d", F.col(pp), F.col(mp), as_col(dp))


def replicate_audit(plan: DataFrame, source_ranks: DataFrame) -> DataFrame:
    """Copied tensors with the columns of the published audit file."""
    ranks = source_ranks.filter("dp = 0").select(
        F.col("pp").alias("source_pp"), F.col("mp").alias("source_mp"), F.col("rank").alias("source-device")
    )
    copies = plan.filter("action = 'replicate'").join(ranks, ["source_pp", "source_mp"])
    return copies.select(
        F.replace("source_path", F.lit("/"), F.lit("-")).alias("source-key"),
        F.replace("path", F.lit("/"), F.lit("-")).alias("target-key"),
        "source-device",
        _place_text("source_pp", "source_mp", 0).alias("source-mdp-rank"),
        F.col("rank").alias("target-device"),
        _place_text("pp", "mp", "dp").alias("target-mdp-rank"),
    )


def repartition_audit(plan: DataFrame) -> DataFrame:
    """Repartitioned tensors; ``requests`` lists ``rank:[lo hi]`` in the published map format."""
    moves = plan.filter("action = 'repartition'")
    one = F.format_string("%d:[%d %d]", "source_mp", "lo", "hi")
    # A list holds the source parts of one target tensor, at most the source's mp degree.
    grouped = moves.groupBy("rank", "pp", "mp", "dp", "path", "shape", "source_pp", "source_path", "source_shape").agg(
        F.array_sort(F.collect_list(F.struct(F.col("source_mp").alias("r"), one.alias("t")))).alias("_r")
    )
    return grouped.select(
        F.array_join(F.col("source_shape").cast("array<string>"), "-").alias("source-shape"),
        F.array_join(F.col("shape").cast("array<string>"), "-").alias("target-shape"),
        F.col("rank").alias("target-device"),
        _place_text("pp", "mp", "dp").alias("target-mdp-rank"),
        F.col("source_pp").alias("source-pp-rank"),
        F.replace("source_path", F.lit("/"), F.lit("-")).alias("source-key"),
        F.replace("path", F.lit("/"), F.lit("-")).alias("target-key"),
        F.concat(F.lit("map["), F.array_join(F.transform("_r", lambda r: r["t"]), " "), F.lit("]")).alias("requests"),
    )


def plan_traffic(
    plan: DataFrame,
    source_ranks: DataFrame,
    types: DataFrame,
    gpus_per_host: int,
    gpus_per_container: int | None = None,
    central: bool = False,
) -> DataFrame:
    """Bytes per (source host, target host, locality) with totals; ``central`` keeps all state on host 0.

    ``types(source_pp, source_path, dtype)`` gives element sizes. Rolled-up keys are null.
    """
    per_container = gpus_per_container or gpus_per_host
    ranks = source_ranks.filter("dp = 0").select(
        F.col("pp").alias("source_pp"), F.col("mp").alias("source_mp"), F.col("rank").alias("_from")
    )
    moved = plan.filter("action <> 'pad'").join(ranks, ["source_pp", "source_mp"]).join(types, ["source_pp", "source_path"])
    elements = F.expr(
        "aggregate(transform(shape, (s, i) -> if(action = 'repartition' AND i = dim, hi - lo, s)), 1L, (a, x) -> a * x)"
    )
    zero = F.lit(0).cast("bigint")
    source_host = zero if central else floor_div("_from", gpus_per_host)
    target_host = floor_div("rank", gpus_per_host)
    source_box = floor_div(F.col("_from") % gpus_per_host, per_container)
    target_box = floor_div(F.col("rank") % gpus_per_host, per_container)
    local = (
        F.when(source_host != target_host, "remote")
        .when(F.lit(central) | (source_box != target_box), "same host")
        .otherwise("same container")
    )
    sized = moved.select(
        source_host.alias("source_host"), target_host.alias("target_host"), local.alias("locality"),
        (elements * item_size()).alias("_bytes"),
    )
    pairs = sized.groupBy("source_host", "target_host", "locality").agg(F.sum("_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
    return pairs.rollup("source_host", "target_host", "locality").agg(F.sum("b").alias("bytes"), F.sum("n").alias("transfers"))


@dataclass(frozen=True)
class State:
    """Tables of one checkpoint: structures, the rank map, and (for a source) tensors and values.

    ``tensors(rank, path, …chunks)``, ``values(rank, path, dtype, value)``.
    """

    structure: DataFrame
    rank_map: DataFrame
    tensors: DataFrame | None = None
    values: DataFrame | None = None


def _places(rank_map: DataFrame) -> DataFrame:
    return rank_map.select("rank", "pp", "mp", "dp")


def _groups(state: State) -> DataFrame:
    keys = st.split_weight_decay(st.model_keys(state.structure))
    first = _places(state.rank_map).filter("dp = 0").select("rank", "pp", "mp")
    return keys.join(first, "rank").select("pp", "mp", "group", "index", "parts")


def target_tensors(target: State) -> DataFrame:
    """All target ranks' tensors; replicas beyond dp 0 take the structure of dp 0."""
    tensors = st.state_leaves(target.structure)[0]
    ranks = _places(target.rank_map)
    first = ranks.filter("dp = 0").select("rank", "pp", "mp")
    wanted = tensors.join(first, "rank").drop("rank").join(ranks, ["pp", "mp"])
    return wanted.select("rank", "pp", "mp", "dp", "path", "parts", "shape")


def plan_migration(source: State, target: State, change: Change) -> tuple[DataFrame, DataFrame]:
    """Plan rows of a whole change of degrees, and the violations of both steps."""
    sizes = {
        side: st.group_sizes(s.structure, s.rank_map, change.precision).select("pp", "group", "size")
        for side, s in (("source", source), ("target", target))
    }
    wanted = target_tensors(target)
    found, lost = source_keys(wanted, change, _groups(target), sizes["target"], _groups(source), sizes["source"])
    first = _places(source.rank_map).filter("mp = 0 AND dp = 0").select("rank", "pp")
    shapes = st.state_leaves(source.structure)[0].join(first, "rank").select("pp", "path", "shape")
    plan, bad = transfer_plan(found, shapes, change)
    lost = lost.select("rank", "path", F.lit(None).cast("string").alias("source_path"), "reason")
    return plan, lost.unionByName(bad)


def _migration(source: State, target: State, change: Change, step: int, stored: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables of the target but its tensors, and the leaves that the structure calls values and ``stored`` holds as tensors."""
    plan, violations = plan_migration(source, target, change)
    places = _places(source.rank_map)
    ranks = _places(target.rank_map)
    first = ranks.filter("dp = 0").select("rank", "pp", "mp")

    def everywhere(df: DataFrame) -> DataFrame:
        return df.join(first, "rank").drop("rank").join(ranks, ["pp", "mp"])

    sizes = st.group_sizes(target.structure, target.rank_map, change.precision).filter("`group` = 0")
    wanted = everywhere(st.state_leaves(target.structure)[1]).select("rank", "pp", "path")
    # What the structure calls a value may be stored as a tensor, as the numpy random state is: it moves as stored.
    asked, wanted = asked_arrays(wanted, stored)
    # Parameter indices are made anew, whatever the source lists hold; all other values are carried.
    is_param = F.col("path").rlike(param_pattern(change.precision))
    params = renumber_params(
        wanted.filter(is_param).select("*", F.lit("int").alias("dtype"), F.lit("0").alias("value")), sizes.select("pp", "size"), change.precision
    )
    carried, differs, missing = carry_values(
        wanted.filter(~is_param), source.values.filter(~is_param).join(places, "rank")
    )
    values = carried.unionByName(params)
    no_path = F.lit(None).cast("string").alias("source_path")
    differing = differs.select(
        F.lit(None).cast("bigint").alias("rank"), "path", no_path, F.lit("source ranks differ").alias("reason")
    )
    absent = missing.select("rank", "path", no_path, F.lit("no source value").alias("reason"))
    return {
        "values": values.select("rank", "path", "dtype", "value"),
        "lists": everywhere(st.state_lists(target.structure)).select("rank", "path", "length"),
        "step": ranks.select("rank", F.lit(step).cast("bigint").alias("step")),
        "plan": plan,
        "violations": violations.unionByName(differing).unionByName(absent),
    }, asked


def _stored(source: State) -> DataFrame:
    """The source's tensors at dp 0, by stage and part."""
    return source.tensors.join(_places(source.rank_map).filter("dp = 0").select("rank", "pp", "mp"), "rank").drop("rank")


def migrate_state(source: State, target: State, change: Change, step: int) -> dict[str, DataFrame]:
    """Tables of the target checkpoint: tensors, values, lists, the step marker, plan and violations.

    Source tensors may be described (``file, begin`` instead of ``data``); then they are read where the target is made.
    """
    stored = _stored(source)
    out, asked = _migration(source, target, change, step, stored)
    if "data" in stored.columns:
        arrays = stored.join(asked, ["path", "pp", "mp"]).select("rank", "path", "dtype", "shape", "chunk_offset", "chunk_shape", "data")
        return {**out, "tensors": apply_plan(stored, out["plan"]).unionByName(arrays)}
    return {**out, "tensors": byref.read_targets(_targets(stored, out["plan"], asked))}


def _targets(stored: DataFrame, plan: DataFrame, asked: DataFrame) -> DataFrame:
    """Target tensors and what they are made of."""
    return byref.targets_of(stored, plan).unionByName(byref.whole_tensors(stored.join(asked, ["path", "pp", "mp"])))


def migrate_files(
    spark: SparkSession, directory: str, snapshot: str, source: State, target: State, change: Change, step: int, out: str, out_snapshot: str
) -> dict[str, DataFrame]:
    """Migrate ``directory/<snapshot>`` into ``out/<out_snapshot>``, both state directories, and set the step marker of ``out``.

    ``source`` and ``target`` give structures and rank maps. The plan meets the files' descriptions; a target's bytes are read by the task that writes
    it. All files are written aside, then the folder is moved into place and replaces the one before, and the marker is written last. Returns
    ``files`` (``file, bytes``), ``plan`` and ``violations`` of the migration, and ``unread``: the violations of the source directory.
    """
    tensors, values, _, unread = state.describe_state_dir(spark, directory)
    mine = lambda df: df.filter(F.col("snapshot") == snapshot).drop("snapshot")
    source = replace(source, tensors=mine(tensors), values=mine(values))
    stored = _stored(source)
    tables, asked = _migration(source, target, change, step, stored)
    staged = f"{out.rstrip('/')}/.{out_snapshot}-{uuid.uuid4().hex}"
    # Named tables, so that the files are written once however often the result is read.
    files = store(
        byref.write_targets(_targets(stored, tables["plan"], asked), staged).unionByName(state.write_leaves(tables["values"], tables["lists"], staged)), "files"
    )
    final = f"{out.rstrip('/')}/{out_snapshot}"
    state.replace_folder(spark, staged, final)
    state.write_step(spark, out, step)
    begin, end = len(qualify(spark, staged)) + 1, qualify(spark, final)
    moved = files.withColumn("file", F.concat(F.lit(end), F.expr(f"substring(file, {begin})")))
    return {"files": moved, "plan": tables["plan"], "violations": tables["violations"], "unread": unread}
