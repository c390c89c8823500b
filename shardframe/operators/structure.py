"""Nested checkpoint structures as rows ``(config_id, rank, path, parts, ord, kind, shape, length, value, dtype)``."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from shardframe.functions.paths import trim_last_ext
from shardframe.session import qualify
from shardframe.sources.files import AsideFile, io_parts

# Fixed values.
LAYER_FILE = r"layer_(\d+)-model_(\d+)-model_states\.json$"
VALUE_TYPES = ("none", "str", "int", "float", "bool")

STRUCTURE = (
    "config_id string, rank bigint, path string, parts array<string>, ord bigint, kind string,"
    " shape array<bigint>, length bigint, value string, dtype string"
)
NAMES = [field.split()[0] for field in STRUCTURE.split(", ")]
ARROW_TYPES = [
    pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.string(),
    pa.list_(pa.int64()), pa.int64(), pa.string(), pa.string(),
]
BATCH_ROWS = 20_000
#: Pieces of JSON that are joined before they are written.
JSON_PIECES = 10_000
#: Keys that one task compares, about.
TASK_KEYS = 2_000_000


def _value(parts: tuple[str, ...], path: str, node) -> tuple:
    return path, parts, "value", None, None, "None" if node is None else str(node), "none" if node is None else type(node).__name__


def _leaves(root) -> Iterator[tuple]:
    """Rows ``(path, parts, kind, shape, length, value, dtype)`` of one document in document order, the root's own only if it has no children."""
    if isinstance(root, dict) and "tensor" in root:
        yield "", (), "tensor", root["tensor"], None, None, None
        return
    if not isinstance(root, (dict, list)):
        yield _value((), "", root)
        return
    # Open parents with the children that are left.
    items = lambda node: iter(node.items()) if isinstance(node, dict) else zip(map(str, itertools.count()), node)
    stack = [("", (), items(root))]
    while stack:
        above, parents, left = stack[-1]
        for key, node in left:
            parts = (*parents, key)
            path = f"{above}/{key}" if parents else key
            if isinstance(node, dict) and "tensor" in node:
                yield path, parts, "tensor", node["tensor"], None, None, None
            elif isinstance(node, (dict, list)):
                is_list = isinstance(node, list)
                yield path, parts, "list" if is_list else "dict", None, len(node) if is_list else None, None, None
                stack.append((path, parts, items(node)))
                break
            else:
                yield _value(parts, path, node)
        else:
            stack.pop()


def _to_arrow(rows: list[tuple]) -> pa.RecordBatch:
    columns = dict(zip(NAMES, zip(*rows)))
    arrays = {name: pa.array(columns[name], kind) for name, kind in zip(NAMES, ARROW_TYPES) if name != "parts"}
    offsets = np.cumsum([0, *map(len, columns["parts"])], dtype=np.int32)
    arrays["parts"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(list(itertools.chain.from_iterable(columns["parts"])), pa.string()))
    return pa.RecordBatch.from_arrays([arrays[name] for name in NAMES], names=NAMES)


def flatten_structure(df: DataFrame) -> DataFrame:
    """Rows for every node of ``(config_id, rank, json)``; key order is kept in ``ord``.

    JSON objects keep their key order only through a parser that does, so one document (a rank's
    structure without data) is read by Python and its rows leave at once.
    """

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for config, rank, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for i, (path, parts, kind, shape, length, value, dtype) in enumerate(_leaves(json.loads(text))):
                    rows.append((config, rank, path, parts, i, kind, shape, length, value, dtype))
                    if len(rows) >= BATCH_ROWS:
                        yield _to_arrow(rows)
                        rows = []
            if rows:
                yield _to_arrow(rows)

    typed = df.select(F.col("config_id").cast("string"), F.col("rank").cast("bigint"), "json")
    return typed.mapInArrow(flatten, STRUCTURE)


def state_leaves(structure: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tensor rows and value rows; keys that end in ``.meta`` are skipped."""
    kept = structure.filter(~F.exists("parts", lambda p: p.endswith(".meta")))
    tensors = kept.filter(F.col("kind") == "tensor").select("config_id", "rank", "path", "parts", "ord", "shape")
    values = kept.filter(F.col("kind") == "value").select("config_id", "rank", "path", "parts", "ord", "dtype", "value")
    return tensors, values


def state_lists(structure: DataFrame) -> DataFrame:
    """All lists with their length."""
    return structure.filter(F.col("kind") == "list").select("config_id", "rank", "path", "length")


def shapes_of(structure: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shapes of ``keys(config_id, rank, path, …)``; keys that name no tensor are violations."""
    on = ["config_id", "rank", "path"]
    # Spark's estimate takes the nodes for as small as the documents that they come from; there are many to a document, so they aren't broadcast.
    nodes = structure.select(*on, "kind", "shape").hint("merge")
    joined = keys.join(nodes, on, "left")
    found = joined.filter(F.col("kind") == "tensor").drop("kind")
    missing = joined.filter(F.coalesce(F.col("kind") != "tensor", F.lit(True)))
    reason = F.when(F.col("kind").isNull(), "no such key").otherwise("not a tensor")
    return found, missing.withColumn("reason", reason).drop("kind", "shape")


def summarize_state(tensors: DataFrame, values: DataFrame, lists: DataFrame) -> DataFrame:
    """Structure rows (without order) of state tables; tensors show their shape only."""
    none = F.lit(None)
    parts = F.split("path", "/")

    def row(df: DataFrame, kind: str, shape: Column, length: Column, value: Column, dtype: Column) -> DataFrame:
        return df.select(
            F.col("snapshot").alias("config_id"), F.col("rank").cast("bigint").alias("rank"), "path", parts.alias("parts"),
            F.lit(kind).alias("kind"), shape.cast("array<bigint>").alias("shape"), length.cast("bigint").alias("length"),
            value.cast("string").alias("value"), dtype.cast("string").alias("dtype"),
        )

    chunks = tensors.select("snapshot", "rank", "path", "shape").distinct()
    return (
        row(chunks, "tensor", F.col("shape"), none, none, none)
        .unionByName(row(values, "value", none, none, F.col("value"), F.col("dtype")))
        .unionByName(row(lists, "list", none, F.col("length"), none, none))
    )


def model_keys(structure: DataFrame) -> DataFrame:
    """Ordered model tensors per rank without random-state ones: ``(config_id, rank, key_ord, path, parts, shape)``."""
    chosen = structure.filter(
        (F.col("kind") == "tensor") & (F.col("parts")[0] == "model") & ~F.exists("parts", lambda p: p.contains("rng"))
    )
    # A group is one rank's document, which is a single input row.
    place = F.row_number().over(Window.partitionBy("config_id", "rank").orderBy("ord")) - 1
    return chosen.select("config_id", "rank", place.cast("bigint").alias("key_ord"), "path", "parts", "shape")


def rank_map_violations(rank_map: DataFrame) -> DataFrame:
    """Ranks or positions that occur more than once; gaps are allowed."""
    ranks = rank_map.groupBy("config_id", "rank").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    places = rank_map.groupBy("config_id", "pp", "mp", "dp").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("rank")).filter("n > 1")
    return ranks.select("config_id", "rank", "n", F.lit("rank repeated").alias("reason")).unionByName(
        places.select("config_id", "rank", "n", F.lit("position repeated").alias("reason"))
    )


def layer_map(files: DataFrame) -> DataFrame:
    """Per ``(config_id, rank)`` of ``files(config_id, rank, path)``: tensor-parallel rank and layer numbers."""
    named = files.filter(F.col("path").rlike(LAYER_FILE)).select(
        "config_id", "rank",
        F.regexp_extract("path", LAYER_FILE, 1).try_cast("bigint").alias("layer"),
        F.regexp_extract("path", LAYER_FILE, 2).try_cast("bigint").alias("mp"),
    )
    # A list holds the layers of one rank, so it is as short as the model is deep.
    return named.groupBy("config_id", "rank").agg(F.max("mp").alias("mp"), F.array_sort(F.collect_set("layer")).alias("layers"))


def split_weight_decay(keys: DataFrame) -> DataFrame:
    """Add ``group`` (0 decay, 1 no decay) and ``index`` in it; keys come from :func:`model_keys`."""
    plain = F.exists("parts", lambda p: p.contains("bias")) | (F.size("shape") == 1)
    grouped = keys.filter(F.col("parts")[0] == "model").withColumn("group", F.when(plain, 1).otherwise(0).cast("bigint"))
    place = F.row_number().over(Window.partitionBy("config_id", "rank", "group").orderBy("key_ord")) - 1
    return grouped.withColumn("index", place.cast("bigint"))


def group_sizes(structure: DataFrame, rank_map: DataFrame, precision: str) -> DataFrame:
    """Optimizer group sizes per stage: ``(config_id, pp, group, size)`` from the first rank of each."""
    root = "optimizer/optimizer" if precision == "fp16" else "optimizer"
    pattern = rf"^{root}/param_groups/(\d+)/params$"
    lists = state_lists(structure).filter(F.col("path").rlike(pattern))
    first = rank_map.filter("mp = 0 AND dp = 0").select("config_id", "rank", "pp")
    return lists.join(first, ["config_id", "rank"]).select(
        "config_id", "pp", F.regexp_extract("path", pattern, 1).try_cast("bigint").alias("group"), F.col("length").alias("size")
    )


def duplicate_keys(leaves: DataFrame, other: DataFrame | None = None, by: tuple[str, ...] = ("config_id", "rank")) -> DataFrame:
    """Paths that occur more than once in a leaf set, or in both of two."""
    on = [*by, "path"]
    if other is None:
        return leaves.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # One aggregate over both sets, instead of two and a join; a null is no key. Adaptive execution would join the partitions, which pack well, into few.
    sides = [df.select(*on).dropna(subset=on).withColumn("_side", F.lit(side)) for side, df in ((1, leaves), (2, other))]
    both = sides[0].unionByName(sides[1])
    dealt = both.repartition(max(io_parts(leaves.sparkSession), -(-both.count() // TASK_KEYS)), *on)
    return dealt.groupBy(*on).agg(F.bit_or("_side").alias("_side")).filter("_side = 3").drop("_side")


def parse_values(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed columns for ``(…, dtype, value)``; texts that do not fit their type are violations."""
    text = F.col("value")
    typed = values.withColumns(
        {
            "str_value": F.when(F.col("dtype") == "str", text),
            "int_value": F.when(F.col("dtype") == "int", text.try_cast("bigint")),
            "float_value": F.when(F.col("dtype") == "float", text.try_cast("double")),
            "bool_value": F.when(F.col("dtype") == "bool", F.lower(text).try_cast("boolean")),
        }
    )
    unfit = (
        ((F.col("dtype") == "int") & F.col("int_value").isNull())
        | ((F.col("dtype") == "float") & F.col("float_value").isNull())
        | ((F.col("dtype") == "bool") & F.col("bool_value").isNull())
    )
    reason = F.when(~F.coalesce(F.col("dtype").isin(*VALUE_TYPES), F.lit(False)), "unknown type").when(unfit, "value does not fit its type")
    checked = typed.withColumn("reason", reason)
    bad = checked.filter(F.col("reason").isNotNull()).select(*values.columns, "reason")
    return checked.filter(F.col("reason").isNull()).drop("reason"), bad


def split_suffix(path: Column | str) -> Column:
    """Struct of the path without its type suffix, and the suffix (``numpy.ndarray`` is one)."""
    path = F.col(path) if isinstance(path, str) else path
    tensor = path.endswith(".numpy.ndarray")
    stem = F.when(tensor, F.regexp_replace(path, r"\.numpy\.ndarray$", "")).otherwise(trim_last_ext(path))
    return F.struct(
        stem.alias("path"), F.when(tensor, "numpy.ndarray").otherwise(F.regexp_extract(path, r"\.([^./]*)$", 1)).alias("dtype")
    )


def _tree(leaves: dict[tuple[str, ...], object], lists: dict[tuple[str, ...], int]):
    """Nested value from leaves and list lengths."""
    root: dict = {}
    for parts in [*leaves, *lists]:
        node = root
        for part in parts[:-1]:
            node = node.setdefault(part, {})
        node.setdefault(parts[-1], {})

    def build(node: dict, parts: tuple[str, ...]):
        if parts in leaves:
            return leaves[parts]
        if parts in lists:
            return [build(node.get(str(i), {}), (*parts, str(i))) for i in range(lists[parts])]
        return {key: build(child, (*parts, key)) for key, child in node.items()}

    return build(root, ())


def missing_items(tensors: DataFrame, values: DataFrame, lists: DataFrame) -> DataFrame:
    """List items below the list's length that no row lies at or under: ``(snapshot, rank, path, reason)``."""
    cols = ["snapshot", "rank", "path"]
    step = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1))
    item = F.when(F.col("path") == "", F.col("_i").cast("string")).otherwise(F.concat_ws("/", "path", F.col("_i").cast("string")))
    wanted = lists.filter("length > 0").select(*cols, step.alias("_i")).select("snapshot", "rank", item.alias("path"))
    rows = tensors.select(*cols).unionByName(values.select(*cols)).unionByName(lists.select(*cols)).distinct()
    parts = F.split("path", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    present = rows.select("snapshot", "rank", above.alias("path")).distinct()
    return wanted.join(present, cols, "left_anti").withColumn("reason", F.lit("missing list item"))


def restore_state(tensors: DataFrame, values: DataFrame, lists: DataFrame) -> DataFrame:
    """Nested JSON per ``(snapshot, rank)``; tensors stay references by shape.

    A group holds the scalars of one rank and no tensor data: one JSON per rank is the format, so a rank's scalars
    must fit a cell. List items without a row are empty objects; :func:`missing_items` names them.
    """
    cols = ["snapshot", "rank", "path"]
    rows = (
        tensors.select(*cols, F.lit("tensor").alias("dtype"), F.to_json("shape").alias("value")).distinct()
        .unionByName(values.select(*cols, "dtype", "value"))
        .unionByName(lists.select(*cols, F.lit("list").alias("dtype"), F.col("length").cast("string").alias("value")))
    )
    readers = {
        "tensor": lambda v: {"tensor": json.loads(v)},
        "none": lambda v: None,
        "str": str,
        "int": int,
        "float": float,
        "bool": lambda v: v.strip().lower() == "true",
    }

    @F.pandas_udf(StringType())
    def nest(paths: pd.Series, dtypes: pd.Series, values: pd.Series) -> pd.Series:
        texts = []
        for row in zip(paths, dtypes, values):
            leaves, lengths = {}, {}
            for path, dtype, value in zip(*row):
                parts = tuple(path.split("/"))
                if dtype == "list":
                    lengths[parts] = int(value)
                else:
                    leaves[parts] = readers[dtype](value)
            texts.append(json.dumps(_tree(leaves, lengths), sort_keys=True))
        return pd.Series(texts, dtype=object)

    whole = rows.groupBy("snapshot", "rank").agg(F.collect_list(F.struct("path", "dtype", "value")).alias("r"))
    return whole.select("snapshot", "rank", nest("r.path", "r.dtype", "r.value").alias("json"))


def leaf_order(path: Column | str = "path") -> Column:
    """Sort key that puts a path before all below it, what lies under one path together, and numbers in their order."""
    parts = F.split(path, "/", -1)
    number = lambda p: F.when(p.rlike("^[0-9]{1,18}$"), p.try_cast("bigint"))
    return F.transform(parts, lambda p: F.struct(number(p).isNull().alias("is_text"), F.coalesce(number(p), F.lit(0).cast("bigint")).alias("number"), p.alias("text")))


# How a value of a type is written.
JSON_TEXT = {
    "tensor": lambda v: json.dumps({"tensor": json.loads(v)}),
    "none": lambda v: "null",
    "str": json.dumps,
    "int": lambda v: json.dumps(int(v)),
    "float": lambda v: json.dumps(float(v)),
    "bool": lambda v: json.dumps(v.strip().lower() == "true"),
}


class JsonWriter:
    """Writes rows ``(path, dtype, value)`` in the order of :func:`leaf_order` as one nested JSON, holding the open parents only.

    A list's row comes before its items; items that no row lies at or under are empty objects, rows beyond its length or not under an item are left
    out. Of several rows of a path the first counts, a leaf before a list, and nothing is written under a leaf.
    """

    def __init__(self, write):
        self.write = write
        # Open parents: part, length of a list or None, items written.
        self.open: list[list] = [["", None, 0]]
        self.skipped: tuple[str, ...] | None = None
        write("{")

    def _close(self, depth: int) -> None:
        while len(self.open) > depth:
            _, length, n = self.open.pop()
            if length is None:
                self.write("}")
            else:
                # A list may have any number of items without a row.
                for k in range(n, length):
                    self.write(", {}" if k else "{}")
                self.write("]")

    def _key(self, part: str) -> bool:
        """Write what stands before a child of the innermost parent; false if the parent has no such child."""
        parent = self.open[-1]
        if parent[1] is None:
            self.write((", " if parent[2] else "") + json.dumps(part) + ": ")
            parent[2] += 1
            return True
        index = int(part) if part.isascii() and part.isdigit() and str(int(part)) == part else -1
        if not parent[2] <= index < parent[1]:
            return False
        for k in range(parent[2], index):
            self.write(", {}" if k else "{}")
        if index:
            self.write(", ")
        parent[2] = index + 1
        return True

    def add(self, path: str, dtype: str, value: str) -> None:
        """The next row."""
        parts = tuple(path.split("/"))
        if self.skipped is not None and parts[: len(self.skipped)] == self.skipped:
            return
        self.skipped = None
        same = 0
        while same + 1 < len(self.open) and same < len(parts) and self.open[same + 1][0] == parts[same]:
            same += 1
        if same == len(parts) and dtype == "list":
            return  # repeated
        self._close(same + 1)
        for depth in range(same, len(parts)):
            if not self._key(parts[depth]):
                self.skipped = parts[: depth + 1]
                return
            if depth + 1 < len(parts):
                self.write("{")
                self.open.append([parts[depth], None, 0])
        if dtype == "list":
            self.write("[")
            self.open.append([parts[-1], int(value), 0])
        else:
            self.write(JSON_TEXT[dtype](value))
            self.skipped = parts

    def close(self) -> None:
        """Close all parents."""
        self._close(0)


class _Pieces:
    """Text for a file, joined from short pieces."""

    def __init__(self, out):
        self.out, self.held = out, []

    def write(self, piece: str) -> None:
        """Append a piece."""
        self.held.append(piece)
        if len(self.held) >= JSON_PIECES:
            self._flush()

    def _flush(self) -> None:
        self.out.write("".join(self.held).encode())
        self.held.clear()

    def close(self) -> int:
        """Close the file; returns its size."""
        self._flush()
        return self.out.close()


def write_state_json(tensors: DataFrame, values: DataFrame, lists: DataFrame, directory: str) -> DataFrame:
    """Write ``directory/<snapshot>/<rank>.json`` for every rank; ``file, bytes`` of each.

    The nested form of :func:`restore_state` as files: a rank's leaves are sorted and pass through one writer, so a rank of any number of leaves takes the
    memory of its open parents. Keys stand in the order of :func:`leaf_order`.
    """
    spark = values.sparkSession
    directory = qualify(spark, directory).rstrip("/")
    cols = ["snapshot", "rank", "path"]
    rows = (
        tensors.select(*cols, F.lit("tensor").alias("dtype"), F.to_json("shape").alias("value")).distinct()
        .unionByName(values.select(*cols, "dtype", "value"))
        .unionByName(lists.select(*cols, F.lit("list").alias("dtype"), F.col("length").cast("string").alias("value")))
    )
    file = F.format_string(f"{directory}/%s/%d.json", "snapshot", "rank")
    # Names of files and sort keys are several times a leaf's bytes, so they are made where the leaves are sorted and not shuffled.
    placed = rows.repartition(io_parts(spark), file).select(file.alias("file"), leaf_order().alias("_order"), "path", "dtype", "value")
    # A leaf comes before a list of its path, equal rows in the order of their values.
    is_list = F.col("dtype") == "list"
    dealt = placed.sortWithinPartitions("file", "_order", is_list, "dtype", "value")

    def write(batches):
        current, writer, done = None, None, []

        def finish() -> None:
            writer.close()
            done.append((current, sink.close()))

        for batch in batches:
            for file, path, dtype, value in zip(*(batch[c].to_pylist() for c in ("file", "path", "dtype", "value"))):
                if file != current:
                    if writer is not None:
                        finish()
                    current, sink = file, _Pieces(AsideFile(file))
                    writer = JsonWriter(sink.write)
                writer.add(path, dtype, value)
        if writer is not None:
            finish()
        names, sizes = zip(*done) if done else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["file", "bytes"])

    return dealt.select("file", "path", "dtype", "value").mapInArrow(write, "file string, bytes bigint")
