import os
import random
import tracemalloc
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shardframe.operators import byref, reshard, tensors
from shardframe.operators.reshard import Change
from shardframe.sources import files
from shardframe.sources import state as state_source
from test_reshard import state
from test_tensors import whole


class Counting:
    """A file that counts requests."""

    def __init__(self, data):
        self.data, self.at, self.requests, self.bytes = data, 0, 0, 0

    def seek(self, at):
        self.at = at

    def read(self, size):
        self.requests += 1
        out = self.data[self.at : self.at + size]
        self.bytes += len(out)
        return out

    def close(self):
        pass


@pytest.mark.parametrize("gap, most", [(0, 1000), (50, 300), (10**6, 10**9), (7, 1)])
def test_vectored_reads(gap, most):
    r = random.Random(gap)
    data = r.randbytes(20_000)
    begins = np.sort(np.array([r.randrange(19_000) for _ in range(300)]))
    ends = begins + np.array([r.choice([0, 1, 30, 900]) for _ in range(300)])
    handle = Counting(data)
    got = [p for part in files.read_vectored(handle, begins, ends, gap, most) for p in part]
    assert got == [data[a:b] for a, b in zip(begins, ends)]
    # A request ends where a gap or its size makes it, so two neighbours never fit into one.
    cuts = files.request_cuts(begins, ends, gap, most)
    assert handle.requests == len(cuts) - 1
    for a, b, c in zip(cuts, cuts[1:], cuts[2:]):
        assert begins[b] - ends[a:b].max() > gap or ends[a : b + 1].max() - begins[a] > most


def test_payloads_lie_in_their_request():
    """A request's payloads aren't copied into an object each, so a task holds what the request brought and little else."""
    size = 1000
    begins = np.arange(0, 6 << 20, size)
    handle = Counting(bytes(7 << 20))
    tracemalloc.start()
    (found,) = files.read_arrays(handle, begins, begins + size)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(begins) and found.nbytes >= 6 << 20
    assert peak < 9 << 20  # the request, and the places of its ranges


@pytest.mark.parametrize("begins, ends", [([0, 3, 3, 9], [3, 3, 7, 12]), ([2, 2, 5], [9, 4, 6]), ([4], [9]), ([0, 8, 14], [8, 14, 30]), ([3, 3], [3, 3])])
def test_slices_of_a_request(begins, ends):
    data = bytes(range(20))
    (found,) = files.read_arrays(Counting(data), np.array(begins), np.array(ends))
    assert found.to_pylist() == [data[a:b] for a, b in zip(begins, ends)]


def test_requests_of_many_files_share_a_batch(spark, tmp_path):
    r = random.Random(5)
    ranges = []
    for k in range(60):
        data = r.randbytes(r.choice([0, 1, 70, 300_000]))
        (tmp_path / f"f{k}").write_bytes(data)
        cuts = sorted(r.randrange(len(data) + 1) for _ in range(5))
        ranges += [(str(tmp_path / f"f{k}"), a, b, data[a:b]) for a, b in zip(cuts, cuts[1:])]
    df = spark.createDataFrame(ranges, "path string, begin bigint, end bigint, wanted binary")
    got = files.read_ranges(df.coalesce(1)).collect()
    assert len(got) == len(ranges) and all(x.payload == x.wanted for x in got)


def test_neighbours_share_a_request():
    data = bytes(range(256)) * (1 << 16)  # 16 MB
    begins = np.arange(0, 1 << 24, 4096)
    handle = Counting(data)
    assert sum(len(p) for part in files.read_vectored(handle, begins, begins + 100) for p in part) == 100 * len(begins)
    assert handle.requests == 2 or handle.requests == 3
    assert list(files.read_vectored(handle, np.zeros(0, np.int64), np.zeros(0, np.int64))) == []


def test_ranges_in_any_order(spark, tmp_path):
    r = random.Random(5)
    blobs = {f"{tmp_path}/f{k}": r.randbytes(200_000) for k in range(3)}
    for path, data in blobs.items():
        open(path, "wb").write(data)
    rows = []
    for k in range(500):
        path = r.choice(list(blobs))
        a = r.randrange(190_000)
        rows.append((k, path, a, a + r.choice([0, 3, 5000])))
    df = spark.createDataFrame(rows, "k long, path string, begin long, end long")
    got = {x["k"]: bytes(x["payload"]) for x in files.read_ranges(df, block=50_000).collect()}
    assert got == {k: blobs[p][a:b] for k, p, a, b in rows}


def random_box(r, size):
    lo = [r.randrange(s) for s in size]
    return lo, [r.randint(a + 1, s) for a, s in zip(lo, size)]


@pytest.mark.parametrize("gap", [0, 10, 1 << 20])
def test_assemble_against_numpy(monkeypatch, gap):
    """Boxes of chunks at any place of targets of any rank, read whole or row by row."""
    monkeypatch.setattr(byref, "GAP", gap)
    r = random.Random(gap)
    for _ in range(60):
        rank = r.randint(0, 3)
        shape = [r.randint(1, 7) for _ in range(rank)]
        want, taken = np.zeros(shape, "<i4"), np.zeros(shape, bool)
        data, pieces = b"", []
        for _ in range(r.randint(0, 4)):
            size = [s + r.randint(0, 4) for s in shape]
            chunk = np.array(r.choices(range(10**6), k=int(np.prod(size, dtype=int))), "<i4").reshape(size)
            at, to = random_box(r, shape) if shape else ([], [])
            place = tuple(slice(a, b) for a, b in zip(at, to))
            if taken[place].any():
                continue  # pieces of a plan never overlap
            taken[place] = True
            lo = [r.randint(0, s - (b - a)) for s, a, b in zip(size, at, to)]
            hi = [x + b - a for x, a, b in zip(lo, at, to)]
            want[place] = chunk[tuple(slice(a, b) for a, b in zip(lo, hi))]
            pieces.append({"file": "f", "begin": len(data), "size": size, "lo": lo, "hi": hi, "at": at})
            data += chunk.tobytes()
        handles = byref.Handles(lambda _: Counting(data))  # noqa: B023
        got = b"".join(byref.assemble(handles, 4, shape, pieces, a, b) for a, b in byref._row_blocks(shape, 4, r.choice([1, 40, 10**6])))
        assert got == want.tobytes()


def test_narrow_cuts_of_long_rows_read_little():
    """Rows of 4 MB, of which 400 bytes are wanted, aren't read through."""
    size = [3, 1 << 20]
    handle = Counting(bytes(3 << 22))
    found = byref._box(handle, 0, size, [0, 100], [3, 200], 4)
    assert found.shape == (3, 100) and handle.bytes <= 3 * (files.GAP + 400)


def test_handles_are_few():
    made = []

    def opener(path):
        made.append(path)
        return Counting(b"x")

    handles = byref.Handles(opener, most=2)
    for path in "abacab":
        handles.get(path)
    assert made == ["a", "b", "c", "b"]
    handles.close()
    assert not handles.open


CHANGES = [((1, 1, 1), (2, 2, 2), False), ((2, 2, 1), (1, 3, 1), True), ((2, 3, 2), (4, 2, 1), True)]


def same_arrays(got, want):
    assert set(got) == set(want)
    for key, array in want.items():
        assert got[key].shape == array.shape and (got[key] == array).all(), key


@pytest.mark.parametrize("src, dst, tied", CHANGES)
def test_by_reference_equals_by_value(spark, tmp_path, src, dst, tied):
    source, _ = state(spark, *src, tied=tied)
    target, _ = state(spark, *dst, tied=tied)
    change = Change(src[0], src[1], dst[0], dst[1], 4)
    described = replace(source, tensors=byref.store_chunks(source.tensors, f"{tmp_path}/chunks"))
    arrays = []
    for s in (source, described):
        moved = reshard.migrate_state(s, target, change, 50)["tensors"]
        arrays.append(whole(moved.withColumn("path", F.concat_ws(":", "rank", "path"))))
    same_arrays(arrays[1], arrays[0])


def write_tree(spark, source, directory, step=3):
    """A source state as a directory."""
    tensors.write_tensors(source.tensors.withColumn("snapshot", F.lit("save")), directory).collect()
    lists = source.structure.filter("kind = 'list'").select("rank", "path", "length")
    state_source.write_leaves(source.values, lists, f"{directory}/save").collect()
    state_source.write_step(spark, directory, step)


@pytest.mark.parametrize("src, dst, tied", CHANGES[:2])
def test_directory_to_directory(spark, rows, tmp_path, src, dst, tied):
    source, _ = state(spark, *src, tied=tied)
    target, _ = state(spark, *dst, tied=tied)
    change = Change(src[0], src[1], dst[0], dst[1], 4)
    write_tree(spark, source, f"{tmp_path}/job")
    out = reshard.migrate_files(spark, f"{tmp_path}/job", "save", source, target, change, 50, f"{tmp_path}/new", "load")
    assert out["violations"].collect() == [] and out["unread"].collect() == []
    told = {r["file"].removeprefix("file:"): r["bytes"] for r in out["files"].collect()}
    assert told and all(os.path.getsize(f) == n for f, n in told.items() if n is not None)
    want = reshard.migrate_state(source, target, change, 50)
    found, values, lists, bad = state_source.read_state_dir(spark, f"{tmp_path}/new", chunk_bytes=100)
    assert bad.collect() == [] and {r[0] for r in found.select("snapshot").distinct().collect()} == {"load"}
    name = F.concat_ws(":", "rank", "path")
    same_arrays(whole(found.drop("snapshot").withColumn("path", name)), whole(want["tensors"].withColumn("path", name)))
    assert rows(values, "rank", "path", "dtype", "value") == rows(want["values"], "rank", "path", "dtype", "value")
    assert rows(lists, "rank", "path", "length") == rows(want["lists"], "rank", "path", "length")
    assert state_source.read_step(spark, f"{tmp_path}/new") == 50
    assert not [d for d in os.listdir(f"{tmp_path}/new") if d not in ("load", "iter", ".iter.crc")]


def test_replaces_a_snapshot_whole(spark, tmp_path):
    source, _ = state(spark, 1, 1, 1)
    write_tree(spark, source, f"{tmp_path}/job")
    change = Change(1, 1, 1, 1, 4)
    out = f"{tmp_path}/new"
    os.makedirs(f"{out}/load/7/model")
    open(f"{out}/load/7/model/old.int", "w").write("1")
    reshard.migrate_files(spark, f"{tmp_path}/job", "save", source, source, change, 1, out, "load")
    assert sorted(os.listdir(f"{out}/load")) == ["0"]


def test_a_failed_migration_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    source, _ = state(spark, 1, 1, 1)
    write_tree(spark, source, f"{tmp_path}/job")
    change = Change(1, 1, 1, 1, 4)
    out = f"{tmp_path}/new"
    reshard.migrate_files(spark, f"{tmp_path}/job", "save", source, source, change, 1, out, "load")

    def fails(*args):
        raise OSError("the driver ends here")

    monkeypatch.setattr(reshard.state, "write_leaves", fails)
    with pytest.raises(OSError):
        reshard.migrate_files(spark, f"{tmp_path}/job", "save", source, source, change, 2, out, "load")
    assert state_source.read_step(spark, out) == 1
    assert state_source.read_state_dir(spark, out)[1].count() == source.values.count()


def test_no_payload_is_shuffled(spark, tmp_path):
    source, _ = state(spark, 2, 1, 1)
    target, _ = state(spark, 1, 2, 1)
    described = replace(source, tensors=byref.store_chunks(source.tensors, f"{tmp_path}/chunks"))
    moved = reshard.migrate_state(described, target, Change(2, 1, 1, 2, 4), 50)["tensors"]
    plan = moved._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.partition("MapInArrow")
    assert "Exchange" not in above and "data#" not in below.split("MapInArrow")[0].split("\n", 1)[1]
    assert state_source.read_step(spark, str(tmp_path)) is None


def test_chunk_rows_leave_with_their_batch(tmp_path):
    """A task that writes chunks keeps no row, as a row's columns hold the bytes of its whole batch."""
    taken = []

    def batches():
        for k in range(3):
            taken.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([k, k]), pa.array([b"ab", None])], names=["rank", "data"])

    made = byref.write_chunks(batches(), str(tmp_path), ["rank"])
    first = next(made)
    assert taken == [0] and first.schema.names == ["rank", "file", "begin"]
    told = [row for batch in [first, *made] for row in batch.to_pylist()]
    assert [(r["rank"], r["begin"]) for r in told] == [(0, 0), (0, 2), (1, 2), (1, 4), (2, 4), (2, 6)]
    (file,) = {r["file"] for r in told}
    assert open(file, "rb").read() == b"ababab"
