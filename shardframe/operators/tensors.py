"""Chunked tensors: ``(…, dtype, shape, chunk_offset, chunk_shape, data)``, row-major, any other columns kept.

A tensor is a set of chunks; slices, concatenations and padding are arithmetic on the chunk boxes. Bytes
are touched only in chunks that a cut goes through: cuts of the leading dimension are ``substring``,
others go to numpy.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from shardframe.functions.numbers import prod
from shardframe.functions.paths import path_parts
from shardframe.operators.ordinal import running
from shardframe.operators.skew import spread_join
from shardframe.session import qualify
from shardframe.sources.files import AsideFile, write_file

# Element types and their long names.
DTYPES = ("i8", "u8", "i16", "u16", "f16", "i32", "u32", "f32", "i64", "u64", "f64")
LONG_NAMES = {
    "int8": "i8", "int16": "i16", "int32": "i32", "int64": "i64",
    "uint8": "u8", "uint16": "u16", "uint32": "u32", "uint64": "u64",
    "float16": "f16", "float32": "f32", "float64": "f64",
}

TENSOR_COLUMNS = ("dtype", "shape", "chunk_offset", "chunk_shape", "data")
# Largest zero chunk that padding creates; a larger padding is several chunks.
MAX_PAD_BYTES = 64 << 20


def numpy_type(dtype: str) -> np.dtype:
    """Little-endian numpy type of a short name."""
    return np.dtype(f"<{dtype[0]}{int(dtype[1:]) // 8}")


def item_size(dtype: Column | str = "dtype") -> Column:
    """Bytes per element."""
    dtype = F.col(dtype) if isinstance(dtype, str) else dtype
    return F.expr("1L") * F.call_function("div", F.substring(dtype, 2, 2).cast("bigint"), F.lit(8).cast("bigint"))


def normal_dtype(dtype: Column | str = "dtype") -> Column:
    """Short type name for a long one; other texts unchanged."""
    dtype = F.col(dtype) if isinstance(dtype, str) else dtype
    pairs = [F.lit(x) for pair in LONG_NAMES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), dtype), dtype)


def other_columns(df: DataFrame) -> list[str]:
    """Columns that identify a tensor."""
    return [c for c in df.columns if c not in TENSOR_COLUMNS]


def rows_expr(shape: str) -> Column:
    """Elements per index of the leading dimension."""
    return prod(F.slice(F.col(shape), F.lit(2), F.greatest(F.size(shape) - 1, F.lit(0))))


def validate_tensors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normalise type names and split into good chunks and violations with a reason.

    A violation is a chunk with an error of its own, or a whole tensor (without chunk columns) whose chunks don't
    have as many elements as its shape.
    """
    named = df.withColumn("dtype", normal_dtype())
    inside = F.forall(
        F.arrays_zip("shape", "chunk_offset", "chunk_shape"),
        lambda d: (d["chunk_offset"] >= 0) & (d["chunk_shape"] >= 0) & (d["chunk_offset"] + d["chunk_shape"] <= d["shape"]),
    )
    ranks = (F.size("shape") == F.size("chunk_offset")) & (F.size("shape") == F.size("chunk_shape"))
    reason = (
        F.when(~F.col("dtype").isin(*DTYPES) | F.col("dtype").isNull(), "unknown dtype")
        .when(~ranks, "rank mismatch")
        .when(~F.coalesce(inside, F.lit(False)), "chunk outside shape")
        .when(F.length("data") != item_size() * prod("chunk_shape"), "wrong byte length")
    )
    checked = named.withColumn("reason", reason)
    single = checked.filter(F.col("reason").isNull()).drop("reason")
    keys = other_columns(df)
    covered = single.groupBy(*keys, "dtype", "shape").agg(F.sum(prod("chunk_shape")).alias("_n"))
    partial = covered.filter(F.col("_n") != prod("shape")).drop("_n")
    wrong = checked.filter(F.col("reason").isNotNull()).drop("data")
    none = F.lit(None).cast("array<bigint>")
    gaps = partial.select(
        *keys, "dtype", "shape", none.alias("chunk_offset"), none.alias("chunk_shape"), F.lit("chunks do not cover the shape").alias("reason")
    )
    # Tensors with gaps are few, and none of their chunks is good. Nulls are keys like any others.
    marked = partial.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "dtype", "shape"])])
    same = [single[k].eqNullSafe(marked[f"_k{i}"]) for i, k in enumerate([*keys, "dtype", "shape"])]
    good = single.join(marked, reduce(and_, same), "left_anti")
    return good, wrong.select(*gaps.columns).unionByName(gaps)


def flatten_tensors(df: DataFrame) -> DataFrame:
    """One-dimensional tensors; chunks that are not contiguous are cut into their contiguous runs."""
    scalar = F.size("shape") == 0
    lead = "coalesce(array_max(filter(transform(shape, (s, i) -> if(chunk_shape[i] <> s, i, -1)), x -> x >= 0)), 0)"
    keep = other_columns(df)
    runs = df.withColumn("_d", F.expr(lead)).select(
        *keep, *TENSOR_COLUMNS, "_d",
        F.explode(F.expr("sequence(0L, aggregate(slice(chunk_shape, 1, _d), 1L, (a, x) -> a * x) - 1)")).alias("_r"),
    )
    run_elements = F.expr("aggregate(slice(chunk_shape, _d + 1, size(chunk_shape)), 1L, (a, x) -> a * x)")
    at = F.expr(
        """aggregate(sequence(0, _d), 0L, (acc, i) -> acc
             + (chunk_offset[i] + if(i < _d,
                  (_r div aggregate(slice(chunk_shape, i + 2, _d - i - 1), 1L, (a, x) -> a * x)) % chunk_shape[i], 0L))
             * aggregate(slice(shape, i + 2, size(shape)), 1L, (a, x) -> a * x))"""
    )
    return runs.select(
        *keep,
        "dtype",
        F.array(prod("shape")).alias("shape"),
        F.array(F.when(scalar, F.lit(0).cast("bigint")).otherwise(at)).alias("chunk_offset"),
        F.array(run_elements).alias("chunk_shape"),
        F.substring(
            F.col("data"), (F.col("_r") * run_elements * item_size() + 1).cast("int"), (run_elements * item_size()).cast("int")
        ).alias("data"),
    )


@F.arrow_udf(BinaryType())
def _cut_bytes(data: pa.Array, size: pa.Array, shape: pa.Array, lo: pa.Array, hi: pa.Array) -> pa.Array:
    """Box ``[lo, hi)`` of a row-major chunk; null data stays null."""

    def cut(i: int) -> bytes | None:
        if not data[i].is_valid:
            return None
        whole = np.frombuffer(data[i].as_buffer(), f"V{size[i].as_py()}").reshape(tuple(shape[i].as_py()))
        return whole[tuple(slice(a, b) for a, b in zip(lo[i].as_py(), hi[i].as_py()))].tobytes()

    return pa.array([cut(i) for i in range(len(data))], pa.binary())


def cut_chunks(df: DataFrame, lo: str, hi: str) -> DataFrame:
    """Cut every tensor to its box ``[lo, hi)`` (array columns, consumed); chunks outside are dropped first.

    A tensor whose box has no elements becomes one empty chunk, made from its chunk at the origin.
    """
    keep = [c for c in other_columns(df) if c not in (lo, hi)]
    empty = F.expr(f"size(filter({lo}, (a, i) -> a >= {hi}[i])) > 0")
    origin = F.expr("forall(chunk_offset, o -> o = 0)")
    boxed = df.withColumn("_empty", empty).filter(~F.col("_empty") | origin).select(
        *keep, *TENSOR_COLUMNS, "_empty",
        F.expr(f"transform(chunk_offset, (o, i) -> if(_empty, 0L, greatest({lo}[i] - o, 0L)))").alias("_a"),
        F.expr(f"transform(chunk_offset, (o, i) -> if(_empty, greatest({hi}[i] - {lo}[i], 0L), least({hi}[i] - o, chunk_shape[i])))").alias("_b"),
        F.col(lo).alias("_lo"),
        F.col(hi).alias("_hi"),
    ).filter(F.col("_empty") | F.expr("size(filter(_a, (a, i) -> a >= _b[i])) = 0"))
    whole = F.expr("size(filter(_a, (a, i) -> a > 0 OR _b[i] < chunk_shape[i])) = 0")
    lead_only = F.expr("size(filter(_a, (a, i) -> i > 0 AND (a > 0 OR _b[i] < chunk_shape[i]))) = 0")
    flagged = boxed.withColumn("_whole", whole).withColumn("_lead", lead_only)
    stride = rows_expr("chunk_shape") * item_size()
    lead_cut = F.substring(
        F.col("data"), (F.col("_a")[0] * stride + 1).cast("int"), ((F.col("_b")[0] - F.col("_a")[0]) * stride).cast("int")
    )
    inner = _cut_bytes(
        F.when(~F.col("_lead") & ~F.col("_empty"), F.col("data")), item_size().cast("int"), F.col("chunk_shape"), F.col("_a"), F.col("_b")
    )
    data = F.when(F.col("_empty"), F.lit(b"")).when(F.col("_whole"), F.col("data")).when(F.col("_lead"), lead_cut).otherwise(inner)
    return flagged.select(
        *keep,
        "dtype",
        F.expr("transform(_hi, (h, i) -> greatest(h - _lo[i], 0L))").alias("shape"),
        F.expr("transform(chunk_offset, (o, i) -> if(_empty, 0L, greatest(o - _lo[i], 0L)))").alias("chunk_offset"),
        F.expr("transform(_b, (b, i) -> b - _a[i])").alias("chunk_shape"),
        data.alias("data"),
    )


def slice_rows(df: DataFrame, lo: int, hi: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``[lo, hi)`` of the leading dimension; tensors without such rows are violations."""
    first = F.try_element_at(F.col("shape"), F.lit(1))
    good = F.coalesce((F.lit(lo) >= 0) & (F.lit(lo) <= F.lit(hi)) & (F.lit(hi) <= first), F.lit(False))
    cut = df.filter(good).withColumn("_l", F.expr(f"transform(shape, (s, i) -> if(i = 0, {lo}L, 0L))"))
    cut = cut.withColumn("_h", F.expr(f"transform(shape, (s, i) -> if(i = 0, {hi}L, s))"))
    bad = df.filter(~good).drop("data", "chunk_offset", "chunk_shape").distinct()
    return cut_chunks(cut, "_l", "_h"), bad.withColumn("reason", F.lit("rows out of range"))


def sub(df: DataFrame, index: int) -> tuple[DataFrame, DataFrame]:
    """One index of the leading dimension; the rank drops by one."""
    rows, bad = slice_rows(df, index, index + 1)
    rest = {c: F.slice(F.col(c), F.lit(2), F.size(c)) for c in ("shape", "chunk_offset", "chunk_shape")}
    return rows.withColumns(rest), bad


def parse_range(text: str) -> list[tuple[int, int]]:
    """``a:b,c:d`` as bounds, -1 for an open one."""
    if not text:
        return []
    bounds = []
    for part in text.split(","):
        lo, hi = part.split(":")
        bounds.append((int(lo) if lo else -1, int(hi) if hi else -1))
    return bounds


def tensor_range(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """N-dimensional range with open bounds; missing trailing dimensions are taken whole."""
    bounds = parse_range(text)
    n = len(bounds)
    los = ", ".join(f"{max(lo, 0)}L" for lo, _ in bounds)
    his = ", ".join(f"{hi}L" for _, hi in bounds)
    boxed = df.withColumn("_l", F.expr(f"transform(shape, (s, i) -> if(i < {n}, coalesce(get(array({los}), i), 0L), 0L))" if n else "transform(shape, s -> 0L)"))
    boxed = boxed.withColumn(
        "_h", F.expr(f"transform(shape, (s, i) -> if(i < {n} AND get(array({his}), i) >= 0, get(array({his}), i), s))" if n else "shape")
    )
    good = (F.size("shape") >= n) & F.expr("size(filter(shape, (s, i) -> _l[i] > _h[i] OR _h[i] > s)) = 0")
    bad = boxed.filter(~good).drop("_l", "_h", "data", "chunk_offset", "chunk_shape").distinct()
    return cut_chunks(boxed.filter(good), "_l", "_h"), bad.withColumn("reason", F.lit("range out of bounds"))


def concat_tensors(df: DataFrame, keys: Sequence[str], order: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """Join the parts of each key along ``dim`` in ``order``; keys with unequal parts are violations."""
    keys = list(keys)
    other = F.expr(f"filter(shape, (s, i) -> i <> {dim})")
    parts = df.groupBy(*keys, order).agg(
        F.min(F.try_element_at("shape", F.lit(dim + 1))).alias("_len"),
        F.min("dtype").alias("_type"),
        F.max("dtype").alias("_type2"),
        F.min(other).alias("_rest"),
        F.max(other).alias("_rest2"),
        F.min(F.size("shape")).alias("_rank"),
    )
    reason = (
        F.when(F.min("_rank") <= dim, "no such dimension")
        .when(F.min("_type") != F.max("_type2"), "unequal dtype")
        .when(F.min("_rest") != F.max("_rest2"), "unequal dimension")
    )
    checked = parts.groupBy(*keys).agg(reason.alias("reason"), F.sum("_len").alias("_total"))
    good = checked.filter(F.col("reason").isNull()).drop("reason")
    based = running(parts.select(*keys, order, "_len"), [order], keys, sums={"_base": F.col("_len")}, position="_p")
    placed = based.join(good, keys).select(*keys, order, "_base", "_total")
    joined = spread_join(df, placed, [*keys, order], ["chunk_offset"], weight=prod("chunk_shape") * item_size())
    # Arrays index from 0 in expressions.
    shifted = joined.withColumns(
        {
            "shape": F.expr(f"transform(shape, (s, i) -> if(i = {dim}, _total, s))"),
            "chunk_offset": F.expr(f"transform(chunk_offset, (o, i) -> if(i = {dim}, o + _base, o))"),
        }
    )
    return shifted.drop("_base", "_total", order), checked.filter(F.col("reason").isNotNull()).drop("_total")


def pad_tensors(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Zero rows at the end of the leading dimension up to the shape in column ``target`` (consumed)."""
    keys = [c for c in other_columns(df) if c != target]
    fits = F.expr(f"size({target}) = size(shape) AND {target}[0] >= shape[0] AND slice({target}, 2, size(shape)) = slice(shape, 2, size(shape))")
    good = F.when(F.size("shape") > 0, fits).otherwise(F.lit(False))
    chosen = df.filter(good)
    tensors = chosen.select(*keys, "dtype", "shape", target).distinct().filter(F.expr(f"{target}[0] > shape[0]"))
    row_bytes = F.greatest(rows_expr("shape") * item_size(), F.lit(1).cast("bigint"))
    per = F.greatest(F.call_function("div", F.lit(MAX_PAD_BYTES).cast("bigint"), row_bytes), F.lit(1).cast("bigint"))
    zeros = (
        tensors.withColumn("_per", per)
        .withColumn("_at", F.explode(F.expr(f"sequence(shape[0], {target}[0] - 1, _per)")))
        .withColumn("_n", F.expr(f"least(_per, {target}[0] - _at)"))
        .select(
            *keys,
            "dtype",
            F.col(target).alias("shape"),
            F.expr("transform(shape, (s, i) -> if(i = 0, _at, 0L))").alias("chunk_offset"),
            F.expr("transform(shape, (s, i) -> if(i = 0, _n, s))").alias("chunk_shape"),
            F.unhex(F.repeat(F.lit("00"), (F.col("_n") * rows_expr("shape") * item_size()).cast("int"))).alias("data"),
        )
    )
    grown = chosen.select(*keys, "dtype", F.col(target).alias("shape"), "chunk_offset", "chunk_shape", "data")
    bad = df.filter(~F.coalesce(good, F.lit(False))).select(*keys, "dtype", "shape", target).distinct()
    return grown.unionByName(zeros), bad.withColumn("reason", F.lit("only the leading dimension can grow"))


def _encoded(arrays: pa.Array, kind: str) -> pa.Array:
    """Bytes of each array, made from the elements of all at once."""
    flat = arrays.flatten()  # without those of nulls
    simple = pa.types.is_floating(flat.type) or pa.types.is_integer(flat.type) and not flat.null_count
    if not simple:
        return pa.array([None if a is None else np.asarray(a).astype(kind).tobytes() for a in arrays.to_pandas()], pa.binary())
    data = flat.to_numpy(zero_copy_only=False).astype(kind)
    lengths = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False).astype(np.int64) * data.itemsize
    offsets = np.r_[0, np.cumsum(lengths)]
    if offsets[-1] > np.iinfo(np.int32).max:
        raise ValueError("a batch of tensors is larger than 2 GB")
    made = pa.Array.from_buffers(pa.binary(), len(arrays), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    return pc.if_else(arrays.is_valid(), made, pa.scalar(None, pa.binary())) if arrays.null_count else made


def _decoded(cells: pa.Array, kind: str, wide: type) -> pa.Array:
    """Elements of each cell, made from the bytes of all at once."""
    filled = pc.fill_null(cells, b"").cast(pa.large_binary())
    _, offsets, data = filled.buffers()
    item = np.dtype(kind).itemsize
    ends = np.frombuffer(offsets, np.int64, len(filled) + 1, filled.offset * 8) if len(filled) else np.zeros(1, np.int64)
    if (np.diff(ends) % item).any():
        raise ValueError("buffer size must be a multiple of element size")
    n = int(ends[-1] - ends[0])
    values = np.frombuffer(data, np.uint8, n, int(ends[0])).view(kind).astype(wide) if n else np.zeros(0, wide)
    places = pa.array(((ends - ends[0]) // item).astype(np.int32), pa.int32())
    # A NaN is a null element, as pandas has it.
    return pa.ListArray.from_arrays(places, pa.array(values, from_pandas=True), mask=cells.is_null() if cells.null_count else None)


def _row_sums(values: pa.Array, rows: pa.Array, width: pa.Array) -> pa.Array:
    """Sums of rows of ``width`` elements, made from the elements of all arrays at once."""
    n, w = (a.to_numpy(zero_copy_only=False).astype(np.int64) for a in (rows, width))
    held = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = values.flatten()  # without those of nulls
    owner = np.repeat(np.arange(len(n)), n)
    first = np.r_[0, np.cumsum(n)]
    r, base = np.arange(len(owner)) - first[owner], (np.cumsum(held) - held)[owner]
    begin, end = (base + np.minimum(k * w[owner], held[owner]) for k in (r, r + 1))
    # Every second run is a row; a run can't begin at the end.
    full = end > begin
    edges = np.column_stack([begin, end])[full].ravel()

    def of(elements: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(owner), elements.dtype)
        if len(edges):
            sums[full] = np.add.reduceat(np.r_[elements, elements[:1]], edges)[::2]
        return sums

    sums = of(pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False))
    unknown = of(flat.is_null().to_numpy(zero_copy_only=False).astype(np.int64)) > 0 if flat.null_count else np.zeros(len(owner), bool)
    if values.null_count:
        unknown |= values.is_null().to_numpy(zero_copy_only=False)[owner]
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(sums, pa.float64(), mask=unknown))


def row_sums(values: Column, rows: Column, width: Column) -> Column:
    """Sums of the first ``rows`` rows of ``width`` elements of row-major arrays of doubles; a row with a null is null."""

    @F.arrow_udf("array<double>")
    def sums(values: pa.Array, rows: pa.Array, width: pa.Array) -> pa.Array:
        return _row_sums(values, rows, width)

    return sums(values, rows, width)


def encode_elements(values: Column, dtype: str) -> Column:
    """Little-endian bytes of an array column."""
    kind = numpy_type(dtype).str

    @F.arrow_udf(BinaryType())
    def encode(arrays: pa.Array) -> pa.Array:
        return _encoded(arrays, kind)

    return encode(values)


def decode_array(dtype: str, data: Column | str = "data") -> Column:
    """Elements of one type as an array: integers widen to bigint (``u64`` to decimal), floats to double."""
    kind = numpy_type(dtype).str
    out = "double" if dtype[0] == "f" else ("decimal(20,0)" if dtype == "u64" else "bigint")
    column = F.col(data) if isinstance(data, str) else data
    if dtype == "u64":

        @F.pandas_udf("array<string>")
        def decode(cells: pd.Series) -> pd.Series:
            return pd.Series([None if c is None else [str(x) for x in np.frombuffer(c, kind)] for c in cells], dtype=object)

        return decode(column).cast(f"array<{out}>")
    wide = np.float64 if dtype[0] == "f" else np.int64

    @F.arrow_udf(f"array<{out}>")
    def decode_all(cells: pa.Array) -> pa.Array:
        return _decoded(cells, kind, wide)

    return decode_all(column)


def decode_elements(df: DataFrame, dtype: str) -> DataFrame:
    """Element rows ``(…, at, value)`` of the tensors of one type; ``at`` is the global index per dimension."""
    keep = other_columns(df)
    # Strides are made once per chunk, so an element costs one division per dimension.
    strides = F.expr("transform(chunk_shape, (s, d) -> aggregate(slice(chunk_shape, d + 2, size(chunk_shape)), 1L, (a, x) -> a * x))")
    cells = df.filter(F.col("dtype") == dtype).select(
        *keep, "chunk_offset", "chunk_shape", strides.alias("_strides"), F.posexplode(decode_array(dtype)).alias("_i", "value")
    )
    at = F.expr("transform(chunk_offset, (o, d) -> o + (_i div _strides[d]) % chunk_shape[d])")
    return cells.select(*keep, at.alias("at"), "value")


def write_tensors(df: DataFrame, directory: str) -> DataFrame:
    """Write each tensor as ``directory/<snapshot>/<rank>/<path>.numpy.ndarray`` with its meta file; a row per file.

    Bytes go to the file row by row in offset order, so a tensor of any size passes through: chunks that are cut
    along other dimensions than the first are dealt into runs of the flat tensor first.
    """
    keys = ["snapshot", "rank", "path"]
    directory = qualify(df.sparkSession, directory).rstrip("/")
    meta = df.groupBy(*keys).agg(F.min(format_meta()).alias("_meta"))
    flat = flatten_tensors(df).select(*keys, F.col("chunk_offset")[0].alias("at"), "data")
    rows = flat.withColumn("meta", F.lit(None).cast("string")).unionByName(
        meta.select(*keys, F.lit(-1).cast("bigint").alias("at"), F.lit(b"").alias("data"), F.col("_meta").alias("meta"))
    )
    file = F.format_string(f"{directory}/%s/%d/%s.numpy.ndarray", *keys)
    placed = rows.select(file.alias("file"), "at", "data", "meta").repartition("file").sortWithinPartitions("file", "at")

    def write(batches):
        current, out, done = None, None, []
        for batch in batches:
            for file, data, text in zip(*(batch[c].to_pylist() for c in ("file", "data", "meta"))):
                if file != current:
                    if out is not None:
                        done.append((current, out.close()))
                    current, out = file, AsideFile(file)
                if text is not None:
                    write_file(f"{file}.meta", iter([text.encode()]))
                out.write(data)
        if out is not None:
            done.append((current, out.close()))
        names, sizes = zip(*done) if done else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["file", "bytes"])

    return placed.mapInArrow(write, "file string, bytes bigint")


def tensor_stats(df: DataFrame, by: str = "snapshot") -> DataFrame:
    """Tensors, elements and bytes per first path part, per ``by`` and in all (rolled-up keys null)."""
    bytes_ = item_size() * prod("chunk_shape")
    prefix = F.try_element_at(path_parts("path"), F.lit(1))
    per_tensor = df.groupBy(by, "rank", "path").agg(F.sum(prod("chunk_shape")).alias("e"), F.sum(bytes_).alias("b"))
    per_prefix = per_tensor.groupBy(by, prefix.alias("prefix")).agg(
        F.count(F.lit(1)).alias("t"), F.sum("e").alias("e"), F.sum("b").alias("b")
    )
    return per_prefix.rollup(by, "prefix").agg(
        F.sum("t").alias("tensors"), F.sum("e").alias("elements"), F.sum("b").alias("bytes")
    )


def format_meta(dtype: Column | str = "dtype", shape: Column | str = "shape") -> Column:
    """Meta text: type, rank and dimensions, one per line."""
    shape = F.col(shape) if isinstance(shape, str) else shape
    dtype = F.col(dtype) if isinstance(dtype, str) else dtype
    lines = F.concat(F.array(dtype, F.size(shape).cast("string")), F.transform(shape, lambda d: d.cast("string")))
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))


def parse_meta(df: DataFrame, column: str) -> DataFrame:
    """Add ``dtype`` and ``shape`` read from meta text, null when the text is not one."""
    lines = F.split(F.trim(F.col(column), F.lit("\n")), "\n")
    dims = F.expr("transform(slice(_lines, 3, size(_lines)), x -> try_cast(x AS bigint))")
    rank = F.expr("try_cast(get(_lines, 1) AS int)")
    good = F.coalesce(rank == F.size("_lines") - 2, F.lit(False)) & F.expr("forall(slice(_lines, 3, size(_lines)), x -> try_cast(x AS bigint) IS NOT NULL)")
    return df.withColumn("_lines", lines).select(
        *df.columns, F.when(good, F.col("_lines")[0]).alias("dtype"), F.when(good, dims).alias("shape")
    )
