"""Length-prefixed record files.

A record is a little-endian int64 length, the masked CRC-32C of those 8 bytes, the payload, and the masked
CRC-32C of the payload.
"""

from __future__ import annotations

import struct
import uuid
from array import array
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage

from shardframe.session import qualify, store
from shardframe.sources.files import READ_BLOCK, filesystem, io_parts, list_files, open_file, spread_blocks

# The reversed Castagnoli polynomial and the mask constant.
POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8
HEAD, TAIL = 12, 4
CHECK_BYTES = 4 << 20
READ_AHEAD = 64 << 10
#: Bytes in which a region looks for its first record at once.
SEARCH_BYTES = 1 << 20
MOVES_AT_ONCE = 32

_LANE = 64


# Tables made once per worker. A plain dict, because cached functions do not travel to executors by value.
_MADE: dict = {}


def _table() -> np.ndarray:
    """CRC of each single byte."""
    if "bytes" not in _MADE:
        _MADE["bytes"] = _byte_table()
    return _MADE["bytes"]


def _byte_table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(POLYNOMIAL), crc >> 1)
    return crc


def _advance(crc: np.ndarray, zeros: int) -> np.ndarray:
    """CRC registers after ``zeros`` zero bytes (a power of two times the lane)."""
    parts = _advance_table(zeros)
    return parts[0][crc & 255] ^ parts[1][(crc >> 8) & 255] ^ parts[2][(crc >> 16) & 255] ^ parts[3][crc >> 24]


def _advance_table(zeros: int) -> np.ndarray:
    """The linear map of ``zeros`` zero bytes, tabled per register byte."""
    if zeros not in _MADE:
        _MADE[zeros] = _make_advance_table(zeros)
    return _MADE[zeros]


def _make_advance_table(zeros: int) -> np.ndarray:
    inputs = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])
    if zeros == _LANE:
        table = _table()
        for _ in range(_LANE):
            inputs = table[inputs & 255] ^ (inputs >> 8)
        return inputs
    return _advance(_advance(inputs, zeros // 2), zeros // 2)


def crc32c_many(texts: list[bytes]) -> list[int]:
    """CRC-32C of each text.

    Texts are cut into lanes of 64 bytes, numpy runs the lanes of all texts side by side, and the lanes of a
    text are folded pairwise. Leading zeros do not change a register that starts at 0, so lanes are filled
    up in front; the usual start value is the same as flipping the first four bytes.
    """
    table = _table()
    sums = [0] * len(texts)
    by_lanes: dict[int, list[int]] = {}
    for i, data in enumerate(texts):
        if len(data) < 4:
            crc = 0xFFFFFFFF
            for byte in data:
                crc = int(table[(crc ^ byte) & 255]) ^ (crc >> 8)
            sums[i] = crc ^ 0xFFFFFFFF
        else:
            by_lanes.setdefault(1 << (-(-len(data) // _LANE) - 1).bit_length(), []).append(i)
    for lanes, members in by_lanes.items():
        width = lanes * _LANE
        filled = np.zeros((len(members), width), np.uint8)
        for row, i in enumerate(members):
            first = width - len(texts[i])
            filled[row, first:] = np.frombuffer(texts[i], np.uint8)
            filled[row, first : first + 4] ^= 0xFF
        columns = np.ascontiguousarray(filled.reshape(-1, _LANE).T)
        crc = np.zeros(columns.shape[1], np.uint32)
        for column in columns:
            crc = table[(crc ^ column) & 255] ^ (crc >> 8)
        crc = crc.reshape(len(members), lanes)
        step = _LANE
        while crc.shape[1] > 1:
            crc = _advance(crc[:, 0::2], step) ^ crc[:, 1::2]
            step *= 2
        for row, i in enumerate(members):
            sums[i] = int(crc[row, 0]) ^ 0xFFFFFFFF
    return sums


def crc32c(data: bytes) -> int:
    """CRC-32C of one text."""
    return crc32c_many([data])[0]


def masked(crc: int) -> int:
    """A checksum as it is stored."""
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def masked_crc(data: bytes) -> int:
    """Stored checksum of one text."""
    return masked(crc32c(data))


def _head_crc(head: bytes) -> int:
    """Stored checksum of the eight bytes of a length."""
    table, crc = _table(), 0xFFFFFFFF
    for byte in head:
        crc = int(table[(crc ^ byte) & 255]) ^ (crc >> 8)
    return masked(crc ^ 0xFFFFFFFF)


def encode_records(payloads: list[bytes]) -> Iterator[bytes]:
    """Records of some payloads."""
    for payload, crc in zip(payloads, crc32c_many(payloads)):
        head = struct.pack("<q", len(payload))
        yield b"".join((head, struct.pack("<I", _head_crc(head)), payload, struct.pack("<I", masked(crc))))


def batches_of(items: Iterator[bytes], limit: int = 4 << 20) -> Iterator[list[bytes]]:
    """Lists of items of about ``limit`` bytes."""
    held, size = [], 0
    for item in items:
        held.append(item)
        size += len(item)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


class _Window:
    """Reads at rising offsets with a read-ahead, so that short records share a request."""

    def __init__(self, handle, size: int) -> None:
        self.handle, self.size, self.start, self.held = handle, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        """``n`` bytes from ``at``, fewer at the end of the file."""
        if at < self.start or at + n > self.start + len(self.held):
            self.handle.seek(at)
            self.start, self.held = at, self.handle.read(min(max(n, READ_AHEAD), self.size - at))
        return self.held[at - self.start : at - self.start + n]


def scan_chain(window: _Window, at: int, stop: int, dead: set[int] | None = None) -> tuple[array, int, str]:
    """Begins of the records from ``at`` on that begin before ``stop``, where the next one begins, and a status.

    A length whose checksum is wrong says nothing about where the next record begins, so the chain ends there. A place in ``dead`` is known to end so.
    """
    begins, size = array("q"), window.size
    while at < stop:
        if dead is not None and at in dead:
            return begins, at, "bad length checksum"
        head = window.read(at, HEAD)
        if len(head) == HEAD and struct.unpack("<I", head[8:])[0] != _head_crc(head[:8]):
            return begins, at, "bad length checksum"
        length = struct.unpack("<q", head[:8])[0] if len(head) == HEAD else -1
        end = at + HEAD + length + TAIL
        if length < 0 or end > size:
            return begins, at, "truncated"
        begins.append(at)
        at = end
    return begins, at, "ok"


def head_places(data: bytes, base: int, size: int) -> np.ndarray:
    """Places in ``data``, which lies at ``base`` of a file, where a length with its checksum stands."""
    n = len(data) - HEAD + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    lengths = np.ndarray((n,), "<i8", data, strides=(1,)).copy()
    at = np.flatnonzero((lengths >= 0) & (lengths <= size - HEAD - TAIL - base - np.arange(n)))
    table, raw = _table(), np.frombuffer(data, np.uint8)
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for k in range(8):
        crc = table[(crc ^ raw[at + k]) & 255] ^ (crc >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    stored = ((crc >> 15) | (crc << 17)) + np.uint32(MASK_DELTA)
    return at[stored == np.ndarray((n,), "<u4", data, offset=8, strides=(1,)).copy()[at]] + base


def guess_chain(window: _Window, start: int, stop: int) -> tuple[int, array, int]:
    """The first place from ``start`` on whose records follow each other up to ``stop``, their begins, and the next one.

    The place is -1 if there is none. It may be wrong: a payload can hold whole records.
    """
    dead: set[int] = set()
    for base in range(start, stop, SEARCH_BYTES):
        window.handle.seek(base)
        # A head may begin at the last byte looked at.
        data = window.handle.read(min(SEARCH_BYTES, stop - base) + HEAD - 1)
        for place in head_places(data, base, window.size).tolist():
            begins, after, status = scan_chain(window, place, stop, dead)
            if status == "ok":
                return place, begins, after
            # A chain that ends early ends for each record on it.
            dead.update(begins)
            dead.add(place)
    return -1, array("q"), -1


HEADS = "path string, region bigint, entry bigint, after bigint, first bigint, begin bigint, end bigint, status string"


def _scan_regions(rows: DataFrame, region: int) -> DataFrame:
    """Records of regions ``(path, size, region, start)``; ``start`` is null where the first record has to be found.

    A row for each record, and one without ``begin`` for each region with its ``entry`` and what comes ``after`` (the end of the file if the chain is broken).
    ``first`` counts the region's records before the row.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), *[pa.int64()] * 6, pa.string()]
        names = [c.split()[0] for c in HEADS.split(", ")]

        def give(path, number, entry, after, first, begin, end, status):
            n = len(begin)
            columns = [[path] * n, [number] * n, [entry] * n, [after] * n, first, begin, end, [status] * n]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            for path, size, number, start in zip(*(batch[c].to_pylist() for c in ("path", "size", "region", "start"))):
                stop = min((number + 1) * region, size)
                with open_file(path) as handle:
                    window = _Window(handle, size)
                    if start is None:
                        entry, begins, after = guess_chain(window, number * region, stop)
                        status = "ok"
                    else:
                        begins, after, status = scan_chain(window, start, stop)
                        entry = start
                n = len(begins)
                begin = np.frombuffer(begins, np.int64) if n else np.zeros(0, np.int64)
                end = np.r_[begin[1:], after] if n else begin
                for a in range(0, n, 50_000):
                    b = min(a + 50_000, n)
                    yield give(path, number, entry, after, np.arange(a, b), begin[a:b], end[a:b], "ok")
                if status != "ok":
                    yield give(path, number, entry, after, [n], [after], [size], status)
                    after = size
                yield give(path, number, entry, after, [n], [None], [None], status)

    spread = rows.repartition(io_parts(rows.sparkSession), "path", "region")
    return spread.select("path", "size", "region", F.col("start").cast("bigint").alias("start")).mapInArrow(scan, HEADS)


VERDICTS = "path string, size bigint, region bigint, round int, base bigint, again bigint"


def _stitch(region: int):
    def run(regions: pd.DataFrame) -> pd.DataFrame:
        """The regions of one file whose records count, with the number of records before them; ``again`` is where others begin.

        A region whose guess isn't where the records before it lead is read again. Those behind it count on their guesses until then.
        """
        regions = regions.sort_values("region")
        at, base, out = 0, 0, []
        columns = (regions[c].tolist() for c in ("path", "size", "region", "round", "entry", "after", "first", "status"))
        for path, size, number, turn, entry, after, first, status in zip(*columns):
            if at >= min((number + 1) * region, size):
                continue  # all of it lies in a record that began before, or behind the end of the chain
            if entry == at:
                out.append((path, size, number, turn, base, None))
                at, base = after, base + first
            else:
                out.append((path, size, number, turn, base, at))
                # Where it leads is not known yet; the next guess stands in.
                later = regions[(regions["region"] > number) & (regions["entry"] >= 0)]
                at = int(later["entry"].iloc[0]) if len(later) else size
        made = pd.DataFrame(out, columns=["path", "size", "region", "round", "base", "again"])
        return made.astype({"base": "int64", "again": "Int64"})

    return run


def _headers(files: DataFrame, region: int) -> DataFrame:
    """Rows ``(path, range_ord, begin, end, status)`` of files, each cut into regions that are read by tasks of their own.

    Region 0 begins with a record. Every other region guesses its first record and reads on from there. Then the chains of a file's regions are
    stitched: where the records before a region lead elsewhere than its guess, it is read again from there, until all chains fit.
    """
    files = store(files, "record-files").filter("size > 0")
    cut = files.withColumn("region", F.explode(F.expr(f"sequence(0L, (size - 1) div {region}L)")))
    cut = cut.withColumn("start", F.when(F.col("region") == 0, F.lit(0).cast("bigint")))
    rows = store(_scan_regions(cut, region).withColumn("round", F.lit(0)), "heads")
    if files.filter(F.col("size") > region).isEmpty():
        # Files of one region have nothing to stitch.
        return rows.filter("begin IS NOT NULL").select("path", F.col("first").alias("range_ord"), "begin", "end", "status")
    turn = 0
    while True:
        latest = rows.filter("begin IS NULL").groupBy("path", "region").agg(F.max_by(F.struct("round", "entry", "after", "first", "status"), "round").alias("r"))
        known = latest.select("path", "region", "r.*").join(files, "path").select("path", "size", "region", "round", "entry", "after", "first", "status")
        verdicts = store(known.groupBy("path").applyInPandas(_stitch(region), VERDICTS), "verdicts")
        again = verdicts.filter("again IS NOT NULL")
        if again.isEmpty():
            break
        turn += 1
        more = _scan_regions(again.select("path", "size", "region", F.col("again").alias("start")), region)
        rows = rows.unionByName(store(more.withColumn("round", F.lit(turn)), "heads"))
    used = verdicts.select("path", "region", "round", "base")
    return rows.filter("begin IS NOT NULL").join(used, ["path", "region", "round"]).select(
        "path", (F.col("base") + F.col("first")).alias("range_ord"), "begin", "end", "status"
    )


def build_record_index(
    spark: SparkSession, paths: str | list[str], verify: bool = True, region: int = READ_BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Index ``(path, range_ord, begin, end)`` of record files and the violations with a reason.

    A range covers the whole record, so it is 16 bytes longer than the payload. Heads are found by hopping from
    length to length, in every ``region`` bytes of a file at once; the payload checksums are then verified by file region, so a large
    file is many tasks in both passes. Every record has one status: it is either in the index or a violation. After a bad length
    the rest of the file is one violation.
    """
    heads = _headers(list_files(spark, paths), region)
    if not verify:
        return heads.filter("status = 'ok'").drop("status"), heads.filter("status <> 'ok'").withColumnRenamed("status", "reason")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, handle = None, None
        for batch in batches:
            statuses, held, rows, size = batch["status"].to_pylist(), [], [], 0

            def settle():
                for row, body, crc in zip(rows, held, crc32c_many([b[:-TAIL] for b in held])):
                    if struct.unpack("<I", body[-TAIL:])[0] != masked(crc):
                        statuses[row] = "bad payload checksum"
                held.clear()
                rows.clear()

            for row, (path, begin, end) in enumerate(zip(*(batch[c].to_pylist() for c in ("path", "begin", "end")))):
                if statuses[row] != "ok":
                    continue
                if path != current:
                    if handle is not None:
                        handle.close()
                    current, handle = path, open_file(path)
                handle.seek(begin + HEAD)
                held.append(handle.read(end - begin - HEAD))
                rows.append(row)
                size += end - begin
                if size >= CHECK_BYTES:
                    settle()
                    size = 0
            settle()
            keep = [batch[c] for c in ("path", "range_ord", "begin", "end")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(statuses, pa.string())], names=["path", "range_ord", "begin", "end", "status"])
        if handle is not None:
            handle.close()

    checked = spread_blocks(heads).mapInArrow(check, heads.schema)
    good = checked.filter("status = 'ok'").drop("status")
    return good, checked.filter("status <> 'ok'").withColumnRenamed("status", "reason")


@dataclass
class WrittenFile(WriterCommitMessage):
    """A finished part and the name it gets on commit."""

    part: str
    final: str


class RecordFiles(DataSource):
    """Batch sink ``record_files``: one record file per partition under ``path``, payload column first.

    Files of one write share a name of their own, so an append adds to what is there; an overwrite removes the record
    files that were there before.
    """

    @classmethod
    def name(cls) -> str:
        """Format name."""
        return "record_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        """Writer of one file per task."""
        return _RecordWriter(self.options["path"], overwrite)


class _RecordWriter(DataSourceArrowWriter):
    # Rows would be made a whole Arrow batch at once.
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.write_id = path.rstrip("/"), overwrite, uuid.uuid4().hex[:12]

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, inner = filesystem(self.path)
        system.create_dir(inner, recursive=True)
        # Attempts write under their own names; only the committed one is moved.
        part = f"{inner}/.part-{uuid.uuid4().hex}"
        with system.open_output_stream(part) as out:
            for payloads in batches_of(payload.as_py() for batch in iterator for payload in batch.column(0)):
                for record in encode_records(payloads):
                    out.write(record)
        return WrittenFile(part, f"{inner}/part-{context.partitionId():05d}-{self.write_id}.rec")

    def commit(self, messages) -> None:
        system, inner = filesystem(self.path)
        old = []
        if self.overwrite:
            new = {m.final.rpartition("/")[2] for m in messages}
            listed = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
            old = [f.path for f in listed if f.base_name.endswith(".rec") and f.base_name not in new]
        with ThreadPoolExecutor(MOVES_AT_ONCE) as pool:
            list(pool.map(lambda m: system.move(m.part, m.final), messages))
            list(pool.map(system.delete_file, old))

    def abort(self, messages) -> None:
        system, _ = filesystem(self.path)
        for message in messages:
            if message is not None:
                system.delete_file(message.part)


def write_records(df: DataFrame, payload: str, directory: str, mode: str = "append") -> None:
    """Write the payload column as record files, one per partition of ``df``; ``mode`` is append or overwrite."""
    df.sparkSession.dataSource.register(RecordFiles)
    payloads = df.select(F.col(payload).cast("binary").alias("payload"))
    payloads.write.format("record_files").option("path", qualify(df.sparkSession, directory)).mode(mode).save()


def record_payload(record: str) -> Column:
    """Payload bytes of whole records read by range."""
    return F.substring(record, HEAD + 1, F.length(record) - HEAD - TAIL)
