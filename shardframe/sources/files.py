"""Byte ranges and text lines of files on any filesystem that the executors can open."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from shardframe.session import qualify, store

READ_BLOCK = 64 << 20
FLUSH_BYTES = 16 << 20
BATCH_LINES = 50_000
#: Entries of folders that the driver lists, and that a task lists before it leaves the rest to others.
DRIVER_ENTRIES = 1000
TASK_ENTRIES = 20_000
#: Bytes between two ranges that are read along with them, and bytes of one request.
GAP = 1 << 20
REQUEST = 8 << 20
#: Bytes of payloads after which a task hands them on; requests that bring less share a batch.
HAND_ON_BYTES = 4 << 20
#: Rows that are turned into Python objects at once where each may be large, and bytes of a record file that a query writes.
SMALL_ROWS = 256
FILE_BYTES = 128 << 20


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """Filesystem and path inside it for a qualified path, or for a plain path of this machine.

    What comes from a caller is qualified on the driver first (:func:`shardframe.session.qualify`), so a plain path
    names the cluster's default filesystem there and never an executor's own disk.
    """
    scheme, found, rest = path.partition(":")
    if not found or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    # Names that Spark's connectors use for stores that Arrow knows by another.
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + found + rest)


def root_of(path: str) -> str:
    """What stands before a path inside its filesystem, so that a listing's paths can be named in full."""
    scheme, found, rest = path.partition(":")
    if not found or "/" in scheme:
        return ""
    if scheme in ("s3", "s3a", "s3n", "gs"):
        return f"{scheme}://"
    return f"{scheme}://{rest[2:].partition('/')[0]}" if rest.startswith("//") and not rest.startswith("///") else f"{scheme}:"


def open_file(path: str):
    """Seekable input file."""
    system, inner = filesystem(path)
    return system.open_input_file(inner)


class AsideFile:
    """A file written under another name and moved into place when it is whole.

    A task that runs twice writes the same bytes and the last move wins.
    """

    def __init__(self, path: str) -> None:
        self.system, self.inner = filesystem(path)
        folder, _, name = self.inner.rpartition("/")
        self.part = f"{folder}/.{name}.{uuid.uuid4().hex}"
        # A folder takes many files, so it is made only when it isn't there.
        try:
            self.out = self.system.open_output_stream(self.part)
        except FileNotFoundError:
            self.system.create_dir(folder, recursive=True)
            self.out = self.system.open_output_stream(self.part)
        self.size = 0

    def write(self, data: bytes) -> None:
        """Append bytes."""
        self.out.write(data)
        self.size += len(data)

    def close(self) -> int:
        """Move the file into place; returns its size."""
        self.out.close()
        self.system.move(self.part, self.inner)
        return self.size


def write_file(path: str, chunks: Iterator[bytes]) -> int:
    """Write a file aside and move it into place; returns its size."""
    out = AsideFile(path)
    for chunk in chunks:
        out.write(chunk)
    return out.close()


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = SMALL_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of few, so that a task holds the Python objects of few rows at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def file_count(texts: DataFrame, column: str, least: int, limit: int = FILE_BYTES) -> int:
    """Files that keep the bytes of a column below a limit each, ``least`` at least."""
    return max(least, -(-(texts.agg(F.sum(F.octet_length(column))).first()[0] or 0) // limit))


def io_parts(spark: SparkSession) -> int:
    """Partitions for rows that only name bytes to read.

    The rows are tiny, so adaptive execution would join them into one task by their size; an explicit
    number keeps every core reading.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def list_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(path, size)`` of files, folders (recursively) or globs; names that start with ``_`` or ``.`` are left out.

    The driver lists the named folders up to ``DRIVER_ENTRIES`` entries. All else is listed by tasks in rounds: the folders of a round are dealt
    out, a task lists a folder and what lies below it until it has ``TASK_ENTRIES`` entries, and the folders that it leaves make up the next round. So neither
    a folder of any number of files nor a tree of any depth is the work of the driver, and a wide tree is many tasks.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files, folders = [], []
    for path in [paths] if isinstance(paths, str) else paths:
        where = jvm.org.apache.hadoop.fs.Path(qualify(spark, path))
        system = where.getFileSystem(conf)
        found = system.globStatus(where)
        if not found:
            raise FileNotFoundError(path)
        for status in found:
            if not status.isDirectory():
                files.append((status.getPath().toString(), status.getLen()))
                continue
            level = system.listStatusIterator(status.getPath())
            inside, below = [], []
            while level.hasNext() and len(inside) + len(below) <= DRIVER_ENTRIES:
                child = level.next()
                if child.getPath().getName()[0] not in "_.":
                    (below if child.isDirectory() else inside).append((child.getPath().toString(), child.getLen()))
            if len(files) + len(folders) + len(inside) + len(below) > DRIVER_ENTRIES:
                folders.append((status.getPath().toString(), 0))
            else:
                files += inside
                folders += below
    listed = spark.createDataFrame(files, "path string, size bigint")
    frontier = spark.createDataFrame(folders, "path string, size bigint").select("path") if folders else None
    while frontier is not None:
        level = store(frontier.repartition(io_parts(spark), "path").mapInArrow(_list_below, "path string, size bigint, is_dir boolean"), "listing")
        listed = listed.unionByName(level.filter("NOT is_dir").drop("is_dir"))
        frontier = level.filter("is_dir").select("path")
        if frontier.isEmpty():
            break
    return listed


def _list_below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files in and below folders, and the folders left for others."""

    def give(rows: list[tuple]) -> pa.RecordBatch:
        names, sizes, is_dir = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(is_dir)], names=["path", "size", "is_dir"])

    for batch in batches:
        for folder in batch["path"].to_pylist():
            system, inner = filesystem(folder)
            root, waiting, seen = root_of(folder), [inner], 0
            while waiting and seen <= TASK_ENTRIES:
                rows = []
                for f in system.get_file_info(fs.FileSelector(waiting.pop())):
                    seen += 1
                    if f.base_name[0] in "_.":
                        continue
                    if f.type == fs.FileType.Directory:
                        waiting.append(f.path)
                    elif f.type == fs.FileType.File:
                        rows.append((root + f.path, f.size, False))
                    if len(rows) == BATCH_LINES:
                        yield give(rows)
                        rows = []
                if rows:
                    yield give(rows)
            if waiting:
                yield give([(root + path, 0, True) for path in waiting])


def spread_blocks(df: DataFrame, begin: str = "begin", block: int = READ_BLOCK) -> DataFrame:
    """Put ranges of one file region into one task in offset order; a large file spans many tasks."""
    keyed = df.withColumn("_block", F.expr(f"{begin} div {block}L"))
    return keyed.repartition(io_parts(df.sparkSession), "path", "_block").sortWithinPartitions("path", begin).drop("_block")


def read_at(handle, begin: int, size: int) -> bytes:
    """``size`` bytes from ``begin`` on, in one request."""
    handle.seek(begin)
    return handle.read(size)


def request_cuts(begins: np.ndarray, ends: np.ndarray, gap: int = GAP, most: int = REQUEST) -> list[int]:
    """Where requests begin in ranges ordered by their begin, and the end.

    Ranges share a request of at most ``most`` bytes if no more than ``gap`` bytes lie between them; a longer range is a request of its own.
    """
    cuts, start, stop = [0], 0, 0
    for k, (begin, end) in enumerate(zip(begins.tolist(), ends.tolist())):
        if k == 0:
            start, stop = begin, end
        elif begin < start or begin - stop > gap or max(stop, end) - start > most:
            cuts.append(k)
            start, stop = begin, end
        else:
            stop = max(stop, end)
    return [*cuts, len(begins)] if len(begins) else []


def read_vectored(handle, begins: np.ndarray, ends: np.ndarray, gap: int = GAP, most: int = REQUEST) -> Iterator[list[bytes]]:
    """Payloads of ranges of one file, for one request after the other: slices of what the request brought."""
    for found in read_arrays(handle, begins, ends, gap, most):
        yield found.to_pylist()


def read_arrays(handle, begins: np.ndarray, ends: np.ndarray, gap: int = GAP, most: int = REQUEST) -> Iterator[pa.Array]:
    """As :func:`read_vectored`, with the payloads of a request as one Arrow array; those without gaps lie in the bytes that the request brought."""
    cuts = request_cuts(begins, ends, gap, most)
    for a, b in zip(cuts, cuts[1:]):
        start = int(begins[a])
        held = read_at(handle, start, int(ends[a:b].max()) - start)
        yield _slices(held, begins[a:b] - start, ends[a:b] - start)


def _slices(held: bytes, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Ranges of ``held``, ordered by their begin."""
    edges = np.minimum(np.column_stack([begins, ends]).ravel(), len(held))
    if (edges[1:] < edges[:-1]).any():
        # Ranges that overlap have bytes of their own.
        return pa.array([held[x:y] for x, y in zip(begins.tolist(), ends.tolist())], pa.binary())
    if (edges[1:-1:2] == edges[2::2]).all():
        return _pieces(held, np.r_[edges[::2], edges[-1:]])
    # Every second piece is a range, the others are gaps.
    return _pieces(held, edges).take(pa.array(np.arange(0, len(edges), 2)))


def _pieces(held: bytes, edges: np.ndarray) -> pa.Array:
    # The conversion fails for places that don't fit the offsets of a binary array.
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.array(edges, pa.int32()).buffers()[1], pa.py_buffer(held)])


def read_ranges(ranges: DataFrame, block: int = READ_BLOCK) -> DataFrame:
    """Add ``payload`` to ``(path, begin, end, …)``: each file region is read once, in offset order, neighbours in one request."""
    schema = StructType([*ranges.schema.fields, StructField("payload", BinaryType())])
    at = [ranges.columns.index(c) for c in ("path", "begin", "end")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, handle = None, None
        for batch in batches:
            paths, (begins, ends) = batch.column(at[0]).to_pylist(), (batch.column(i).to_numpy(zero_copy_only=False) for i in at[1:])
            parts, rows, size, first = [], 0, 0, 0
            edges = [k for k in range(len(paths)) if k == 0 or paths[k] != paths[k - 1]]
            for a, b in zip(edges, [*edges[1:], len(paths)]):
                if paths[a] != current:
                    if handle is not None:
                        handle.close()
                    current, handle = paths[a], open_file(paths[a])
                for found in read_arrays(handle, begins[a:b], ends[a:b]):
                    parts.append(found)
                    rows += len(found)
                    size += found.nbytes
                    if size >= HAND_ON_BYTES:
                        yield _with_payload(batch.slice(first, rows), parts)
                        parts, rows, size, first = [], 0, 0, first + rows
            if parts:
                yield _with_payload(batch.slice(first), parts)
        if handle is not None:
            handle.close()

    return spread_blocks(ranges, "begin", block).mapInArrow(read, schema)


def read_texts(spark: SparkSession, paths: str | list[str], names: str = "") -> DataFrame:
    """``(file, text)`` of whole small files, those whose path matches ``names``; tasks list them and read many each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts, held = [], [], 0
            for path in batch["path"].to_pylist():
                with open_file(path) as handle:
                    data = handle.read()
                found.append(path)
                texts.append(data.decode("utf-8", "replace"))
                held += len(data)
                if held >= FLUSH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(texts, pa.string())], names=["file", "text"])
                    found, texts, held = [], [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(texts, pa.string())], names=["file", "text"])

    listed = list_files(spark, paths).filter(F.col("path").rlike(names)).select("path")
    return listed.repartition(io_parts(spark), "path").mapInArrow(read, "file string, text string")


def _with_payload(batch: pa.RecordBatch, parts: list[pa.Array]) -> pa.RecordBatch:
    payloads = parts[0] if len(parts) == 1 else pa.concat_arrays(parts)
    return pa.RecordBatch.from_arrays([*batch.columns, payloads], names=[*batch.schema.names, "payload"])


def read_lines(spark: SparkSession, paths: str | list[str], block: int = READ_BLOCK) -> DataFrame:
    """``(path, line_no, text)`` with 0-based line numbers.

    Files are cut at fixed offsets, so a large file is read by many tasks. A first pass counts the lines that begin in each block; the sums of the blocks
    before make the numbers, and the second pass reads the text. No text is written or shuffled. A task holds some reads and one line.
    """
    files = list_files(spark, paths).filter("size > 0")
    blocks = store(files.select("path", "size", F.explode(F.expr(f"sequence(0L, (size - 1) div {block}L)")).alias("block")), "blocks")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for path, size, number in zip(*(batch[c].to_pylist() for c in ("path", "size", "block"))):
                with open_file(path) as handle:
                    counts.append(lines_begun(handle, number * block, min((number + 1) * block, size)))
            yield pa.RecordBatch.from_arrays([batch["path"], batch["block"], pa.array(counts, pa.int64())], names=["path", "block", "n"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, numbers, texts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            columns = [pa.array(paths, pa.string()), pa.array(numbers, pa.int64()), pa.array(texts, pa.string())]
            for cells in (paths, numbers, texts):
                cells.clear()
            held = 0
            return pa.RecordBatch.from_arrays(columns, names=["path", "line_no", "text"])

        for batch in batches:
            for path, size, number, base in zip(*(batch[c].to_pylist() for c in ("path", "size", "block", "base"))):
                with open_file(path) as handle:
                    for k, line in enumerate(lines_of(handle, number * block, min((number + 1) * block, size))):
                        paths.append(path)
                        numbers.append(base + k)
                        texts.append(line.rstrip(b"\r").decode("utf-8", "replace"))
                        held += len(line)
                        # Small files share a batch, large blocks fill several.
                        if len(texts) >= BATCH_LINES or held >= FLUSH_BYTES:
                            yield flush()
        if texts:
            yield flush()

    def spread(df: DataFrame) -> DataFrame:
        return df.repartition(io_parts(spark), "path", "block")

    numbered = blocks.withColumn("base", F.lit(0).cast("bigint"))
    if not blocks.filter("block > 0").isEmpty():
        # One row per block of a file; files of one block need no numbers from others.
        many = blocks.filter(F.col("size") > block)
        counts = spread(many).mapInArrow(count, "path string, block bigint, n bigint")
        before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        bases = counts.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        numbered = numbered.filter(F.col("size") <= block).unionByName(many.join(bases, ["path", "block"]).select(*numbered.columns))
    return spread(numbered).mapInArrow(split, "path string, line_no bigint, text string")


def lines_begun(handle, start: int, stop: int) -> int:
    """Lines that begin in ``[start, stop)`` of a file: those after a line end, and the first of the file."""
    n, at = int(start == 0), max(start - 1, 0)
    handle.seek(at)
    while at < stop - 1:
        data = handle.read(min(REQUEST, stop - 1 - at))
        if not data:
            break
        n += data.count(b"\n")
        at += len(data)
    return n


def lines_of(handle, start: int, stop: int) -> Iterator[bytes]:
    """Lines that begin in ``[start, stop)`` of a file, without their ends; a line that runs on is read to its end."""
    at = max(start - 1, 0)
    handle.seek(at)
    # Before the first line end after start - 1 lies the end of a line that began before.
    inside, parts = start == 0, []
    while True:
        data = handle.read(min(REQUEST, stop - at) if at < stop else 1 << 20)
        if not data:
            break
        begin = 0
        while True:
            end = data.find(b"\n", begin)
            if end < 0:
                break
            if inside:
                parts.append(data[begin:end])
                yield b"".join(parts)
                parts = []
            inside, begin = True, end + 1
            if at + begin >= stop:
                return
        if inside:
            parts.append(data[begin:])
        at += len(data)
    last = b"".join(parts)
    if inside and last:
        yield last
