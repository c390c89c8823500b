import json
import random
import tracemalloc

from pyspark.sql import functions as F

from shardframe.operators import structure
from shardframe.plans import QUERIES

DOC = """{"model": {"language_model": {"embedding": {"word_embeddings": {"weight": {"tensor": [7680, 1024]}}}}},
 "optimizer": {"optimizer": {"param_groups": [{"lr": 0.1, "params": [0, 1]}, {"lr": 0.1, "params": [0]}]}},
 "rng_state": [{"np_rng_state": ["MT19937", {"tensor": [624]}, 5]}], "iteration": 50, "x.meta": 1}"""


def flat(spark, *docs):
    rows = [("c", i, d) for i, d in enumerate(docs)]
    return structure.flatten_structure(spark.createDataFrame(rows, "config_id string, rank bigint, json string"))


def test_leaves_and_lists(spark, rows):
    df = flat(spark, DOC)
    tensors, values = structure.state_leaves(df)
    word = "model/language_model/embedding/word_embeddings/weight"
    assert rows(tensors, "path", "shape") == [(word, [7680, 1024]), ("rng_state/0/np_rng_state/1", [624])]
    group = "optimizer/optimizer/param_groups"
    assert rows(values, "path", "dtype", "value") == sorted(
        [
            (f"{group}/0/lr", "float", "0.1"), (f"{group}/1/lr", "float", "0.1"), (f"{group}/0/params/0", "int", "0"),
            (f"{group}/0/params/1", "int", "1"), (f"{group}/1/params/0", "int", "0"), ("iteration", "int", "50"),
            ("rng_state/0/np_rng_state/0", "str", "MT19937"), ("rng_state/0/np_rng_state/2", "int", "5"),
        ]
    )
    assert rows(structure.state_lists(df), "path", "length") == sorted(
        [(group, 2), (f"{group}/0/params", 2), (f"{group}/1/params", 1), ("rng_state", 1), ("rng_state/0/np_rng_state", 3)]
    )
    ranks = spark.createDataFrame([("c", 0, 0, 0, 0)], "config_id string, rank bigint, pp bigint, mp bigint, dp bigint")
    assert rows(structure.group_sizes(df, ranks, "fp16"), "group", "size") == [(0, 2), (1, 1)]
    assert structure.group_sizes(df, ranks, "fp32").count() == 0
    assert rows(structure.model_keys(df), "key_ord", "path") == [(0, word)]


def test_key_order_is_document_order(spark):
    doc = json.dumps({"model": {"z": {"tensor": [2, 2]}, "a.bias": {"tensor": [2, 2]}, "m": {"tensor": [4]}, "b": {"tensor": [1, 4]}}})
    split = structure.split_weight_decay(structure.model_keys(flat(spark, doc))).collect()
    assert sorted((r["group"], r["index"], r.path) for r in split) == [
        (0, 0, "model/z"), (0, 1, "model/b"), (1, 0, "model/a.bias"), (1, 1, "model/m"),
    ]


def test_shapes_and_duplicates(spark, rows):
    df = flat(spark, DOC)
    keys = spark.createDataFrame([("c", 0, "rng_state"), ("c", 0, "rng_state/0/np_rng_state/1"), ("c", 0, "no")], "config_id string, rank bigint, path string")
    found, bad = structure.shapes_of(df, keys)
    assert rows(found, "path", "shape") == [("rng_state/0/np_rng_state/1", [624])]
    assert rows(bad, "path", "reason") == [("no", "no such key"), ("rng_state", "not a tensor")]
    assert rows(structure.duplicate_keys(keys.unionByName(keys.limit(1))), "path", "n") == [("rng_state", 2)]


def test_nodes_are_not_broadcast(spark):
    df = flat(spark, DOC)
    for side in structure.shapes_of(df, df.select("config_id", "rank", "path")):
        plan = side._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_layer_map(spark, rows):
    files = spark.createDataFrame(
        [("c", 1, f"r/layer_{n:02d}-model_03-model_states.json") for n in (2, 0, 11)] + [("c", 0, "r/mp_rank_00.json")],
        "config_id string, rank bigint, path string",
    )
    assert rows(structure.layer_map(files), "rank", "mp", "layers") == [(1, 3, [0, 2, 11])]


def test_rank_map_violations(spark, rows):
    ranks = spark.createDataFrame(
        [("c", 0, 0, 0, 0), ("c", 0, 1, 0, 0), ("c", 5, 1, 0, 0)], "config_id string, rank bigint, pp bigint, mp bigint, dp bigint"
    )
    assert rows(structure.rank_map_violations(ranks), "rank", "reason") == [(0, "position repeated"), (0, "rank repeated")]


def test_parse_values(spark, rows):
    df = spark.createDataFrame(
        [("a", "bool", "False"), ("b", "int", "x"), ("c", "none", "None"), ("d", "float", "1e3"), ("e", "date", "1")],
        "path string, dtype string, value string",
    )
    good, bad = structure.parse_values(df)
    assert rows(good, "path", "bool_value", "float_value") == [("a", False, None), ("c", None, None), ("d", None, 1000.0)]
    assert rows(bad, "path", "reason") == [("b", "value does not fit its type"), ("e", "unknown type")]


def test_restore_is_the_inverse(spark):
    docs = [DOC, json.dumps({"a": [[], [{"b": None, "c": True}, 1.5, "s"]], "7": {"d": {"tensor": [2, 3]}}})]
    df = flat(spark, *docs).withColumnRenamed("config_id", "snapshot")
    tensors = df.filter("kind = 'tensor'")
    values = df.filter("kind = 'value'")
    lists = df.filter("kind = 'list'")
    restored = {r["rank"]: json.loads(r["json"]) for r in structure.restore_state(tensors, values, lists).collect()}
    assert restored == {i: json.loads(d) for i, d in enumerate(docs)}
    summary = structure.summarize_state(tensors, values, lists)
    assert summary.groupBy("kind").agg(F.count("*").alias("n")).count() == 3


def test_split_suffix(spark):
    df = spark.createDataFrame([("a/w.x.numpy.ndarray",), ("a/it.int",), ("a/b.c.str",)], "p string")
    got = sorted((r.s.path, r.s.dtype) for r in df.select(structure.split_suffix("p").alias("s")).collect())
    assert got == [("a/b.c", "str"), ("a/it", "int"), ("a/w.x", "numpy.ndarray")]


def test_missing_list_items_are_named(spark, rows):
    values = spark.createDataFrame([("s", 0, "a/0", "int", "1"), ("s", 0, "a/2/x", "int", "1")], "snapshot string, rank bigint, path string, dtype string, value string")
    lists = spark.createDataFrame([("s", 0, "a", 3), ("s", 0, "b", 1), ("s", 0, "c", 0)], "snapshot string, rank bigint, path string, length bigint")
    tensors = spark.createDataFrame([("s", 0, "t", [1])], "snapshot string, rank bigint, path string, shape array<bigint>")
    assert rows(structure.missing_items(tensors, values, lists), "path", "reason") == [("a/1", "missing list item"), ("b/0", "missing list item")]


def key(path):
    """The order of paths in plain Python."""
    return [(not p.isdigit(), int(p) if p.isdigit() else 0, p) for p in path.split("/")]


def written_json(rows):
    """One rank's rows through the writer."""
    pieces = []
    writer = structure.JsonWriter(pieces.append)
    for path, dtype, value in sorted(rows, key=lambda r: (key(r[0]), r[1] == "list", r[1], r[2])):
        writer.add(path, dtype, value)
    writer.close()
    return json.loads("".join(pieces))


def nested(r, depth):
    """A random document, and its rows."""
    if depth == 0 or r.random() < 0.2:
        return r.choice([1, 0.5, "x\"y", True, None, {"tensor": [2, 3]}])
    if r.random() < 0.4:
        return [nested(r, depth - 1) for _ in range(r.choice([0, 1, 3, 12]))]
    return {r.choice(["a", "b/".strip("/"), "ä", "10", "9", "k k"]) + str(k): nested(r, depth - 1) for k in range(r.randint(1, 4))}


def rows_of_document(doc, path=()):
    name = "/".join(path)
    if isinstance(doc, dict) and set(doc) != {"tensor"}:
        return [row for k, v in doc.items() for row in rows_of_document(v, (*path, k))]
    if isinstance(doc, list):
        return [(name, "list", str(len(doc)))] + [row for k, v in enumerate(doc) for row in rows_of_document(v, (*path, str(k)))]
    kinds = {int: "int", float: "float", str: "str", bool: "bool", type(None): "none", dict: "tensor"}
    return [(name, kinds[type(doc)], json.dumps(doc["tensor"]) if isinstance(doc, dict) else str(doc))]


def test_writer_is_the_inverse_of_any_document():
    r = random.Random(6)
    for _ in range(300):
        doc = {"top": nested(r, 5), "b": nested(r, 3)}
        assert written_json(rows_of_document(doc)) == doc


def test_writer_with_gaps_and_strays():
    rows = [("a", "list", "4"), ("a/2/x", "int", "7"), ("a/02", "int", "1"), ("a/9", "int", "1"), ("a/k", "int", "1"), ("b", "int", "1"), ("b/c", "int", "2"), ("b", "list", "3")]
    assert written_json(rows) == {"a": [{}, {}, {"x": 7}, {}], "b": 1}
    assert written_json([("l", "list", "0"), ("m/l", "list", "2"), ("m/l", "list", "2")]) == {"l": [], "m": {"l": [{}, {}]}}
    assert written_json([(f"l/{k}", "int", str(k)) for k in range(25)] + [("l", "list", "25")]) == {"l": list(range(25))}


def tables(spark, docs):
    """Tensors, values and lists of documents, a rank for each."""
    df = flat(spark, *docs).withColumn("config_id", F.lit("s")).withColumnRenamed("config_id", "snapshot")
    return [df.filter(f"kind = '{kind}'") for kind in ("tensor", "value", "list")]


def test_json_files_equal_restored_cells(spark, tmp_path):
    docs = [DOC, DOC.replace("50", "51")]
    tensors, values, lists = tables(spark, docs)
    told = {r["file"]: r["bytes"] for r in structure.write_state_json(tensors, values, lists, str(tmp_path)).collect()}
    assert len(told) == 2
    for rank, text in enumerate(docs):
        data = (tmp_path / "s" / f"{rank}.json").read_bytes()
        assert json.loads(data) == json.loads(text) and told[f"file:{tmp_path}/s/{rank}.json"] == len(data)
    assert structure.write_state_json(tensors.limit(0), values.limit(0), lists.limit(0), str(tmp_path)).count() == 0


def test_json_leaves_are_shuffled_without_their_file_names(spark, tmp_path):
    """Names and sort keys are several times a leaf's bytes, and they are made behind the shuffle."""
    none = "snapshot string, rank bigint, path string"
    tensors, values, lists = (spark.createDataFrame([], f"{none}, {rest}") for rest in ("shape array<bigint>", "dtype string, value string", "length bigint"))
    plan = structure.write_state_json(tensors, values, lists, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    behind = plan[plan.index("RepartitionByExpression") :]
    assert "json" in plan and "_order" not in behind and "AS file" not in behind


def test_memory_follows_the_depth():
    """A million leaves of one rank pass through without being held."""

    class File:
        size = 0

        def write(self, data):
            self.size += len(data)

        def close(self):
            return self.size

    sink = structure._Pieces(File())
    writer = structure.JsonWriter(sink.write)
    tracemalloc.start()
    writer.add("g", "list", "1000")
    for g in range(1000):
        writer.add(f"g/{g}/p", "list", "1000")
        for k in range(1000):
            writer.add(f"g/{g}/p/{k}", "int", str(k))
    writer.add("h", "list", "1000000")
    writer.close()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sink.close() > 8_000_000 and peak < 4_000_000


def test_keys_in_both_are_one_aggregate(spark, rows):
    """Repeated and null keys; each common key is given once, and no join sorts the sets."""
    schema = "config_id string, rank bigint, path string"
    one = spark.createDataFrame([("c", 0, "a"), ("c", 0, "a"), ("c", 1, "a"), (None, 0, "a"), ("c", 2, None)], schema)
    two = spark.createDataFrame([("c", 0, "a"), ("c", 1, "b"), (None, 0, "a"), ("c", 2, None)], schema)
    both = structure.duplicate_keys(one, two)
    assert rows(both) == [("c", 0, "a")]
    assert "Join" not in both._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_read_once(spark, tmp_path):
    """All kinds of nodes of a document come from one reading."""
    order = [(1, 7, "O", 10.5, "5-LOW")]
    spark.createDataFrame(order, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    for name, n in (("c2_state_leaves", 10), ("c5_summarize_state", 13)):
        made = QUERIES[name].run(spark, str(tmp_path))
        assert "MapInArrow" not in made._jdf.queryExecution().optimizedPlan().toString()
        assert made.count() == n


def test_paths_of_odd_documents():
    """Empty keys, a root that is a list, a tensor or a value, and a depth that recursion wouldn't reach."""
    found = lambda text: [(path, parts, kind) for path, parts, kind, *_ in structure._leaves(json.loads(text))]
    assert found('{"": {"a": [1]}}') == [("", ("",), "dict"), ("/a", ("", "a"), "list"), ("/a/0", ("", "a", "0"), "value")]
    assert found("[null]") == [("0", ("0",), "value")]
    assert found("3") == [("", (), "value")] and found('{"tensor": [1]}') == [("", (), "tensor")]
    deep = 1
    for _ in range(3_000):
        deep = {"k": deep}
    assert sum(1 for _ in structure._leaves(deep)) == 3_000
