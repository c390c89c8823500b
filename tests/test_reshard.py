from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardframe.operators import reshard, structure
from shardframe.operators.reshard import Change, State
from test_tensors import SCHEMA, chunked, whole


@pytest.mark.parametrize(
    "a, b, mp, q, parts, pad",
    [
        (256, 512, 4, 1, [(2, 0, 256), (3, 0, 256)], 0),
        (512, 256, 2, 3, [(1, 256, 512)], 0),
        (25216, 12672, 2, 3, [(1, 12800, 25216)], 256),
        (12672, 25216, 4, 1, [(1, 12544, 12672), (2, 0, 12672), (3, 0, 12416)], 0),
        (3, 2, 2, 1, [(0, 2, 3), (1, 0, 1)], 0),
    ],
)
def test_overlap(spark, a, b, mp, q, parts, pad):
    df = spark.createDataFrame([(a, b, q)], "a bigint, b bigint, q bigint")
    got = reshard.overlap_ranges(df, "a", "b", mp, "q").collect()
    assert sorted((r.source_mp, r.lo, r.hi) for r in got) == parts
    assert {r["pad"] for r in got} == {pad}


def test_vocab_and_layers(spark):
    df = spark.createDataFrame([(v, m) for v in (30524, 50257) for m in (1, 2, 4, 8)], "v bigint, m bigint")
    got = [r.p for r in df.select("v", "m", reshard.vocab_padding("v", F.col("m")).alias("p")).sort("v", "m").collect()]
    assert got == [30592, 30720, 30720, 30720, 50304, 50432, 50688, 51200]
    cases = {(24, 3, 2, 1, 3): (15, 1, 7), (24, 4, 2, 0, 11): (11, 1, 5), (24, 2, 4, 3, 5): (23, 1, 11), (24, 1, 8, 7, 2): (23, 0, 23)}
    grid = spark.createDataFrame([k for k in cases], "n bigint, s bigint, t bigint, stage bigint, l bigint")
    for r in grid.select("*", reshard.layer_place("l", "stage", "n", "s", "t").alias("p")).collect():
        assert tuple(r.p) == cases[(r.n, r.s, r.t, r.stage, r.l)]


WORD = "model/language_model/embedding/word_embeddings/weight"
HEAD = "model/word_embeddings_for_head/weight"
ENCODER = "model/language_model/encoder"


def model(pp, mp, layers=4, vocab=300, tied=False):
    """Full arrays per stage in key order; ``split`` is the dimension that mp cuts, or None."""
    padded = -(-vocab // (128 * mp)) * 128 * mp
    rng = np.random.default_rng(1)
    table = np.zeros((padded, 4), "<f4")
    table[:vocab] = rng.random((vocab, 4))
    stages = []
    for p in range(pp):
        keys = {}
        if p == 0:
            keys[WORD] = (table, 0)
        for l in range(layers // pp):
            g = p * (layers // pp) + l
            r = np.random.default_rng(100 + g)
            keys[f"{ENCODER}/layers.{l}.weight"] = (r.random((12, 6)).astype("<f4"), 1)
            keys[f"{ENCODER}/layers.{l}.bias"] = (r.random(12).astype("<f4"), 0)
            keys[f"{ENCODER}/layers.{l}.ln"] = (r.random(6).astype("<f4"), None)
        if p == pp - 1:
            r = np.random.default_rng(999)
            keys[f"{ENCODER}/final_layernorm.weight"] = (r.random(6).astype("<f4"), None)
            keys[f"{ENCODER}/final_layernorm.bias"] = (r.random(6).astype("<f4"), None)
            if tied and pp > 1:
                keys[HEAD] = (table, 0)
        stages.append(keys)
    return stages


def state(spark, pp, mp, dp, **kw):
    """Checkpoint tables of a configuration, all tensors three times as in an fp16 optimizer."""
    docs, chunks, values, ranks, content = [], [], [], [], {}
    for p, keys in enumerate(model(pp, mp, **kw)):
        groups = [[k for k, (a, _) in keys.items() if not ("bias" in k or a.ndim == 1)], [k for k, (a, _) in keys.items() if "bias" in k or a.ndim == 1]]
        for m in range(mp):
            rank = p * mp + m
            tensors = {}
            for k, (a, d) in keys.items():
                part = a if d is None else np.split(a, mp, d)[m]
                g = 0 if k in groups[0] else 1
                i = groups[g].index(k)
                tensors[k] = part
                tensors[f"optimizer/optimizer/state/{i + g * len(groups[0])}/exp_avg"] = part + 1
                tensors[f"optimizer/fp32_from_fp16_params/{g}/{i}"] = part + 2
            tensors["rng_state/0/np_rng_state/1"] = np.arange(5, dtype="<u4")
            tensors["model/one"] = np.ones(1, "<f4")
            content[(p, m)] = tensors
            ord_ = {k: i for i, k in enumerate(keys)}
            docs += [("c", rank, k, k.split("/"), ord_.get(k, 10**6), "tensor", list(a.shape), None, None, None) for k, a in tensors.items()]
            scalars = {"iteration": "50"}
            for g in (0, 1):
                path = f"optimizer/optimizer/param_groups/{g}/params"
                docs.append(("c", rank, path, path.split("/"), 10**6, "list", None, len(groups[g]), None, None))
                scalars |= {f"{path}/{i}": str(i + g * len(groups[0])) for i in range(len(groups[g]))}
            docs += [("c", rank, k, k.split("/"), 10**6, "value", None, None, v, "int") for k, v in scalars.items()]
            values += [(rank, k, "int", v) for k, v in scalars.items()]
            chunks += [(x[0], rank, *x[2:]) for x in chunked(tensors, {0: 7})]
    for d in range(dp):
        ranks += [("c", d * pp * mp + p * mp + m, p, m, d) for p in range(pp) for m in range(mp)]
    tables = State(
        spark.createDataFrame(docs, structure.STRUCTURE),
        spark.createDataFrame(ranks, "config_id string, rank bigint, pp bigint, mp bigint, dp bigint"),
        spark.createDataFrame(chunks, SCHEMA).drop("snapshot"),
        spark.createDataFrame(values, "rank bigint, path string, dtype string, value string"),
    )
    return tables, content


@pytest.mark.parametrize(
    "src, dst, tied",
    [((1, 1, 1), (2, 2, 2), False), ((2, 2, 1), (1, 3, 1), True), ((1, 2, 1), (4, 1, 1), True), ((2, 3, 2), (4, 2, 1), True)],
)
def test_migration_moves_every_tensor(spark, src, dst, tied):
    source, _ = state(spark, *src, tied=tied)
    target, want = state(spark, *dst, tied=tied)
    change = Change(src[0], src[1], dst[0], dst[1], 4)
    out = reshard.migrate_state(source, target, change, 50)
    assert out["violations"].collect() == []
    moved = out["tensors"].withColumn("path", F.concat_ws(":", "rank", "path"))
    got = whole(moved)
    ranks = {r["rank"]: (r.pp, r.mp) for r in target.rank_map.collect()}
    assert set(got) == {f"{r}:{k}" for r, place in ranks.items() for k in want[place]}
    for r, place in ranks.items():
        for key, array in want[place].items():
            mine = got[f"{r}:{key}"]
            assert mine.shape == array.shape
            # Vocabulary rows that padding adds are zero whatever the optimizer's twins hold there.
            real = array.shape[0]
            if array.ndim == 2 and array.shape[1] == 4:
                real = max(0, min(array.shape[0], 300 - place[1] * array.shape[0]))
            assert (mine[:real] == array[:real]).all(), (r, key)
    values = {(r["rank"], r.path): r.value for r in out["values"].collect()}
    expected = {
        (r, v.path): v.value
        for r, (p, m) in ranks.items()
        for v in target.values.collect()
        if v["rank"] == p * dst[1] + m
    }
    assert values == expected
    assert out["lists"].count() == 2 * len(ranks)
    assert {r.step for r in out["step"].collect()} == {50}


def test_random_state_moves_as_it_is_stored(spark):
    """A generated structure names it a value although it is a tensor file."""
    source, _ = state(spark, 2, 1, 1)
    target, want = state(spark, 1, 2, 1)
    named = lambda s: replace(
        s,
        structure=s.structure.withColumn("_r", F.col("path").contains("np_rng_state/1"))
        .withColumn("kind", F.when(F.col("_r"), "value").otherwise(F.col("kind")))
        .withColumn("shape", F.when(~F.col("_r"), F.col("shape")))
        .withColumn("value", F.when(F.col("_r"), "NotPrimitiveNorTensor").otherwise(F.col("value")))
        .withColumn("dtype", F.when(F.col("_r"), "str").otherwise(F.col("dtype")))
        .drop("_r"),
    )
    out = reshard.migrate_state(named(source), named(target), Change(2, 1, 1, 2, 4), 50)
    assert out["violations"].collect() == []
    moved = whole(out["tensors"].withColumn("path", F.concat_ws(":", "rank", "path")))
    for rank in (0, 1):
        assert moved[f"{rank}:rng_state/0/np_rng_state/1"].tolist() == list(range(5))
    assert out["values"].filter(F.col("path").contains("np_rng_state")).count() == 0


def test_optimizer_index_example(spark):
    """4 layers of weight, bias, ln; PP 1 -> 2: state 0 of stage 1 is layer 2's weight at source index 3."""
    source, _ = state(spark, 1, 1, 1)
    target, _ = state(spark, 2, 1, 1)
    plan, bad = reshard.plan_migration(source, target, Change(1, 1, 2, 1, 4))
    assert bad.count() == 0
    keys = {(r.pp, r.path): r.source_path for r in plan.collect()}
    assert keys[(1, "optimizer/optimizer/state/0/exp_avg")] == "optimizer/optimizer/state/3/exp_avg"
    assert keys[(1, "optimizer/optimizer/state/3/exp_avg")] == "optimizer/optimizer/state/10/exp_avg"
    back, _ = reshard.plan_migration(target, source, Change(2, 1, 1, 1, 4))
    there = {r.path: (r.source_pp, r.source_path) for r in back.collect()}
    assert there["optimizer/optimizer/state/3/exp_avg"] == (1, "optimizer/optimizer/state/0/exp_avg")
    assert there["optimizer/optimizer/state/10/exp_avg"] == (1, "optimizer/optimizer/state/3/exp_avg")


def test_plan_violations(spark, rows):
    target = spark.createDataFrame(
        [(0, 0, 0, 0, k, s, 0, k) for k, s in (("two", [3, 3]), ("rank", [4]), ("none", [2]), ("wide", [2, 9]), ("same", [2, 2]))],
        "rank bigint, pp bigint, mp bigint, dp bigint, path string, shape array<bigint>, source_pp bigint, source_path string",
    )
    shapes = spark.createDataFrame(
        [(0, "two", [2, 2]), (0, "rank", [2, 2]), (0, "wide", [2, 2]), (0, "same", [2, 2])], "pp bigint, path string, shape array<bigint>"
    )
    plan, bad = reshard.transfer_plan(target, shapes, Change(1, 2, 1, 1, 4))
    assert rows(plan, "path", "action") == [("same", "replicate")]
    assert rows(bad, "path", "reason") == [
        ("none", "no source tensor"), ("rank", "rank mismatch"), ("two", "several unequal dimensions"), ("wide", "only the leading dimension can grow"),
    ]


def test_unknown_keys_are_reported(spark, rows):
    target = spark.createDataFrame(
        [(0, 0, 0, 0, p, p.split("/"), [4, 4]) for p in ("model/odd", "other/x", f"{ENCODER}/layers.9.weight", f"{ENCODER}/layers.weight")],
        "rank bigint, pp bigint, mp bigint, dp bigint, path string, parts array<string>, shape array<bigint>",
    )
    source, _ = state(spark, 2, 1, 1)
    groups = reshard._groups(source)
    sizes = structure.group_sizes(source.structure, source.rank_map, "fp16")
    found, lost = reshard.source_keys(target, Change(2, 1, 2, 1, 4), groups, sizes, groups, sizes)
    assert found.count() == 0 and lost.count() == 4
