"""Moves by reference: a plan meets where the chunks lie, and bytes are read once, by the task that makes the target.

A chunk is described by the file it lies in and where it begins there, beside its box ``(chunk_offset, chunk_shape)`` in its tensor. A plan
joined with such rows gives, for each target tensor, its pieces: a box of a chunk in a file, and its place in the target. Only these
rows are shuffled; payloads never are. Places of a target that no piece covers are zeros, so padding has no rows.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from shardframe.functions.numbers import prod
from shardframe.operators.tensors import format_meta, item_size, rows_expr
from shardframe.session import qualify, store
from shardframe.sources.files import FLUSH_BYTES, GAP, AsideFile, io_parts, open_file, read_at, small_batches, write_file

BLOCK_BYTES = 64 << 20
#: Bytes of a file whose pieces one task reads.
SPOT_BYTES = 8 << 20
#: Files that a task keeps open.
OPEN_FILES = 16
#: Bytes of target files that one task writes, about.
TASK_BYTES = 256 << 20

BOX = "array<bigint>"
PIECE = f"struct<file:string,begin:bigint,size:{BOX},lo:{BOX},hi:{BOX},at:{BOX}>"


def store_chunks(df: DataFrame, directory: str) -> DataFrame:
    """Write the ``data`` of chunk rows into files, one for each task; the rows with ``file, begin`` instead, as a table.

    A task that runs twice writes another file, and the rows name the file of the run that counted.
    """
    directory = qualify(df.sparkSession, directory).rstrip("/")
    kept = [c for c in df.columns if c != "data"]
    schema = StructType([*[df.schema[c] for c in kept], StructField("file", StringType()), StructField("begin", LongType())])
    return store(df.select(*kept, "data").mapInArrow(lambda batches: write_chunks(batches, directory, kept), schema), "chunk-places")


def write_chunks(batches: Iterator[pa.RecordBatch], directory: str, kept: list[str]) -> Iterator[pa.RecordBatch]:
    """Write the ``data`` of a task's batches into one file of ``directory``; the ``kept`` columns with ``file, begin``.

    Rows leave batch by batch, as any column that a task keeps holds the bytes of its whole batch.
    """
    out = None
    for batch in batches:
        if out is None:
            path = f"{directory}/chunks-{uuid.uuid4().hex}"
            out = AsideFile(path)
        begins = []
        for cell in batch.column("data"):
            begins.append(out.size)
            out.write(cell.as_buffer() if cell.is_valid else b"")
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array([path] * len(begins), pa.string()), pa.array(begins, pa.int64())], names=[*kept, "file", "begin"])
    if out is not None:
        out.close()


def _boxed(joined: DataFrame) -> DataFrame:
    """Chunks cut to ``[_l, _h)`` of their tensor; those outside are dropped. Adds the piece, placed by ``dst_lo`` along ``dim``."""
    cut = joined.withColumns(
        {
            "_a": F.expr("transform(chunk_offset, (o, i) -> greatest(_l[i] - o, 0L))"),
            "_b": F.expr("transform(chunk_offset, (o, i) -> least(_h[i] - o, chunk_shape[i]))"),
        }
    ).filter(F.expr("size(filter(_a, (a, i) -> a >= _b[i])) = 0"))
    at = F.expr("transform(_a, (a, i) -> chunk_offset[i] + a - _l[i] + if(i = dim, dst_lo, 0L))")
    return cut.withColumn(
        "piece", F.struct("file", "begin", F.col("chunk_shape").alias("size"), F.col("_a").alias("lo"), F.col("_b").alias("hi"), at.alias("at")).cast(PIECE)
    )


def targets_of(chunks: DataFrame, plan: DataFrame) -> DataFrame:
    """``rank, path, dtype, shape, pieces`` of every target tensor of a transfer plan.

    ``chunks(pp, mp, path, dtype, shape, chunk_offset, chunk_shape, file, begin)`` describe the source at dp 0. A target's pieces are the chunks that
    overlap it.
    """
    key = ["source_pp", "source_path"]
    described = chunks.withColumnsRenamed({"pp": "source_pp", "mp": "source_mp", "path": "source_path"})
    moves = plan.filter("action <> 'pad'").select("source_pp", "source_mp", "source_path", "rank", "path", "action", "dim", "lo", "hi", "dst_lo")
    joined = described.select("source_pp", "source_mp", "source_path", "shape", "chunk_offset", "chunk_shape", "file", "begin").join(moves, ["source_pp", "source_mp", "source_path"])
    boxed = joined.withColumns(
        {
            "_l": F.expr("transform(shape, (s, i) -> if(action = 'repartition' AND i = dim, lo, 0L))"),
            "_h": F.expr("transform(shape, (s, i) -> if(action = 'repartition' AND i = dim, hi, s))"),
        }
    )
    found = _boxed(boxed).groupBy("rank", "path").agg(F.collect_list("piece").alias("pieces"))
    types = described.groupBy(*key).agg(F.min("dtype").alias("dtype"))
    wanted = plan.groupBy("rank", "path").agg(F.min("shape").alias("shape"), F.min("source_pp").alias("source_pp"), F.min("source_path").alias("source_path"))
    none = F.array().cast(f"array<{PIECE}>")
    return (
        wanted.join(types, key)
        .join(found, ["rank", "path"], "left")
        .select("rank", "path", "dtype", "shape", F.coalesce("pieces", none).alias("pieces"))
    )


def whole_tensors(chunks: DataFrame) -> DataFrame:
    """``rank, path, dtype, shape, pieces`` that copy the tensors of described chunks ``(rank, path, …, file, begin)``."""
    zero = F.lit(0).cast("bigint")
    boxed = chunks.withColumns({"_l": F.expr("transform(shape, s -> 0L)"), "_h": F.col("shape"), "dim": zero, "dst_lo": zero})
    found = _boxed(boxed).groupBy("rank", "path").agg(F.collect_list("piece").alias("pieces"))
    named = chunks.groupBy("rank", "path").agg(F.min("dtype").alias("dtype"), F.min("shape").alias("shape"))
    return named.join(found, ["rank", "path"], "left").select(
        "rank", "path", "dtype", "shape", F.coalesce("pieces", F.array().cast(f"array<{PIECE}>")).alias("pieces")
    )


# Bytes


class Handles:
    """The files a task reads, the last few kept open."""

    def __init__(self, opener=open_file, most: int = OPEN_FILES):
        self.opener, self.most, self.open = opener, most, OrderedDict()

    def get(self, path: str):
        """An open file."""
        if path in self.open:
            self.open.move_to_end(path)
        else:
            if len(self.open) >= self.most:
                self.open.popitem(last=False)[1].close()
            self.open[path] = self.opener(path)
        return self.open[path]

    def close(self) -> None:
        """Close them all."""
        while self.open:
            self.open.popitem()[1].close()


def _box(handle, begin: int, size: list[int], lo: list[int], hi: list[int], item: int) -> np.ndarray:
    """A box of a row-major chunk: whole rows at once where what lies between is little, else a row after the other."""
    inner = int(np.prod(size[1:], dtype=np.int64)) * item
    wanted = int(np.prod([b - a for a, b in zip(lo[1:], hi[1:])], dtype=np.int64)) * item
    n = hi[0] - lo[0]
    if inner - wanted <= GAP or n == 1 and len(size) == 1:
        data = read_at(handle, begin + lo[0] * inner, n * inner)
        rows = np.frombuffer(data, f"V{item}").reshape(n, *size[1:])
        return rows[(slice(None), *(slice(a, b) for a, b in zip(lo[1:], hi[1:])))]
    return np.stack([_box(handle, begin + r * inner, size[1:], lo[1:], hi[1:], item) for r in range(lo[0], hi[0])])


def assemble(handles: Handles, item: int, shape: list[int], pieces: list[dict], first: int, last: int) -> bytes:
    """Rows ``[first, last)`` of a target tensor."""
    shape = shape or [1]
    out = None
    for p in pieces:
        size, lo, hi, at = p["size"] or [1], p["lo"] or [0], p["hi"] or [1], p["at"] or [0]
        a, b = max(first, at[0]), min(last, at[0] + hi[0] - lo[0])
        if a >= b:
            continue
        start = lo[0] + a - at[0]
        found = _box(handles.get(p["file"]), p["begin"], size, [start, *lo[1:]], [start + b - a, *hi[1:]], item)
        if found.shape == (last - first, *shape[1:]):
            return found.tobytes()
        if out is None:
            out = np.zeros((last - first, *shape[1:]), f"V{item}")
        out[(slice(a - first, b - first), *(slice(t, t + y - x) for t, x, y in zip(at[1:], lo[1:], hi[1:])))] = found
    return bytes((last - first) * int(np.prod(shape[1:], dtype=np.int64)) * item) if out is None else out.tobytes()


def _row_blocks(shape: list[int], item: int, block: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``block`` bytes."""
    shape = shape or [1]
    per = max(1, block // max(1, int(np.prod(shape[1:], dtype=np.int64)) * item))
    for first in range(0, shape[0], per):
        yield first, min(first + per, shape[0])


def read_targets(targets: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """Chunk rows ``(…, dtype, shape, chunk_offset, chunk_shape, data)`` of target tensors, in blocks of rows."""
    keep = [c for c in targets.columns if c not in ("dtype", "shape", "pieces")]
    rows = F.when(F.size("shape") == 0, F.lit(1).cast("bigint")).otherwise(F.try_element_at("shape", F.lit(1)))
    per = F.greatest(F.lit(1).cast("bigint"), F.call_function("div", F.lit(block).cast("bigint"), F.greatest(F.lit(1).cast("bigint"), rows_expr("shape") * item_size())))
    cut = targets.withColumns({"_rows": rows, "_per": per}).withColumn("_at", F.explode(F.expr("sequence(0L, greatest(_rows - 1, 0L), _per)")))
    cut = cut.withColumn("_to", F.least(F.col("_at") + F.col("_per"), F.col("_rows")))
    mine = F.expr("filter(pieces, p -> size(p.at) = 0 OR (p.at[0] < _to AND p.at[0] + p.hi[0] - p.lo[0] > _at))")
    chunks = cut.select(
        *keep, "dtype", "shape", F.expr("transform(shape, (s, i) -> if(i = 0, _at, 0L))").alias("chunk_offset"),
        F.expr("transform(shape, (s, i) -> if(i = 0, _to - _at, s))").alias("chunk_shape"), mine.alias("pieces"), item_size().cast("int").alias("item"),
    )
    # What lies near in a file is read by one task, in order.
    spot = chunks.withColumn("_file", F.expr("get(pieces, 0).file")).withColumn("_spot", F.expr(f"get(pieces, 0).begin div {SPOT_BYTES}L"))
    dealt = spot.repartition(io_parts(targets.sparkSession), "_file", "_spot").sortWithinPartitions("_file", F.expr("get(pieces, 0).begin")).drop("_file", "_spot")
    schema = StructType([*[f for f in chunks.schema.fields if f.name not in ("pieces", "item")], StructField("data", BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handles = Handles()
        for batch in small_batches(batches):
            described = batch.drop_columns(["pieces", "item"])
            data, held, start = [], 0, 0
            columns = (batch.column(c).to_pylist() for c in ("item", "shape", "chunk_offset", "chunk_shape", "pieces"))
            for k, (item, shape, offset, size, pieces) in enumerate(zip(*columns)):
                first = offset[0] if offset else 0
                data.append(assemble(handles, item, shape, pieces, first, first + (size[0] if size else 1)))
                held += len(data[-1])
                if held >= FLUSH_BYTES or k + 1 == batch.num_rows:
                    part = described.slice(start, k + 1 - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], names=[*part.schema.names, "data"])
                    data, held, start = [], 0, k + 1
        handles.close()

    return dealt.mapInArrow(read, schema)


def write_targets(targets: DataFrame, directory: str, block: int = BLOCK_BYTES) -> DataFrame:
    """Write each target tensor as ``directory/<rank>/<path>.numpy.ndarray`` with its meta file; ``file, bytes`` of each.

    The task that writes a file reads its pieces, a block of rows at a time, so memory doesn't follow the tensor's size.
    """
    spark = targets.sparkSession
    directory = qualify(spark, directory).rstrip("/")
    named = targets.select(
        F.format_string(f"{directory}/%d/%s.numpy.ndarray", "rank", "path").alias("file"), item_size().cast("int").alias("item"), "shape", "pieces",
        format_meta().alias("meta"), (prod("shape") * item_size()).alias("bytes"),
    )
    named = store(named, "target-files")
    total = named.agg(F.sum("bytes")).first()[0] or 0
    dealt = named.repartition(max(io_parts(spark), -(-total // TASK_BYTES)), "file")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handles = Handles()
        for batch in small_batches(batches):
            sizes = []
            for file, item, shape, pieces, meta in zip(*(batch.column(c).to_pylist() for c in ("file", "item", "shape", "pieces", "meta"))):
                write_file(f"{file}.meta", iter([meta.encode()]))
                sizes.append(write_file(file, (assemble(handles, item, shape, pieces, a, b) for a, b in _row_blocks(shape, item, block))))
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(sizes, pa.int64())], names=["file", "bytes"])
        handles.close()

    return dealt.mapInArrow(write, "file string, bytes bigint")
