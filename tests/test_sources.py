import io
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardframe.plans import file_queries
from shardframe.sources import checksums, files, index_files, logs, npz, records, state, structures


def test_crc32c():
    assert records.crc32c(b"123456789") == 0xE3069283
    data = np.random.default_rng(0).integers(0, 256, 100_003, np.uint8).tobytes()
    table = records._table().tolist()
    for n in (0, 511, 512, 513, 4096, 100_003):
        crc = 0xFFFFFFFF
        for byte in data[:n]:
            crc = table[(crc ^ byte) & 255] ^ (crc >> 8)
        assert records.crc32c(data[:n]) == crc ^ 0xFFFFFFFF


def test_records(spark, tmp_path, rows):
    out = str(tmp_path / "r")
    records.write_records(spark.range(64).select(F.expr("cast(repeat(char(0), 100) AS binary)").alias("p")).repartition(4), "p", out)
    good, bad = records.build_record_index(spark, out)
    assert good.count() == 64 and bad.count() == 0
    assert {r.n for r in good.select((F.col("end") - F.col("begin")).alias("n")).collect()} == {116}
    names = sorted(f for f in os.listdir(out) if f.endswith(".rec"))
    assert len(names) == 4

    def damage(name, at=None, cut=None):
        path = os.path.join(out, name)
        data = bytearray(open(path, "rb").read())
        if at is not None:
            data[at] ^= 1
        with open(path, "wb") as f:
            f.write(data[:cut])

    damage(names[0], at=20)
    damage(names[1], at=9)
    damage(names[2], cut=-5)
    good, bad = records.build_record_index(spark, out)
    # After a bad length nothing in the file can be trusted.
    assert good.count() == 64 - 1 - 16 - 1
    assert bad.count() == 3
    loose, unread = records.build_record_index(spark, out, verify=False)
    assert loose.count() == 64 - 16 - 1 and unread.count() == 2
    assert loose.join(unread, ["path", "range_ord"]).count() == 0
    assert rows(bad.select(F.element_at(F.split("path", "/"), -1), "range_ord", "reason"))[:2] == [
        (names[0], 0, "bad payload checksum"), (names[1], 0, "bad length checksum"),
    ]
    assert [r.reason for r in bad.collect() if r.path.endswith(names[2])] == ["truncated"]


def test_record_sink_holds_few_objects(tmp_path, monkeypatch):
    """The sink takes the payloads of an Arrow batch a few megabytes at a time, not all as objects at once."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa
    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    batch = pa.record_batch([pa.array([b"x" * 4096] * 16_000)], names=["payload"])
    tracemalloc.start()
    done = records.RecordFiles({"path": str(tmp_path)}).writer(None, False).write(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert os.path.getsize(done.part) == 16_000 * (4096 + 16)
    assert peak < 48 << 20


def test_records_append_and_overwrite(spark, tmp_path):
    out = str(tmp_path / "r")
    payloads = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("p")).repartition(2)
    read = lambda: sorted(
        int(bytes(r.p)) for r in files.read_ranges(records.build_record_index(spark, out)[0]).select(records.record_payload("payload").alias("p")).collect()
    )
    records.write_records(payloads(0, 5), "p", out)
    records.write_records(payloads(5, 8), "p", out)
    assert read() == list(range(8))
    records.write_records(payloads(20, 23), "p", out, mode="overwrite")
    assert read() == [20, 21, 22]
    assert not [f for f in os.listdir(out) if not f.endswith(".rec") and not f.endswith(".crc")]


@pytest.mark.parametrize(
    "path, inner, root",
    [
        ("/a/b", "/a/b", ""),
        ("file:/a/b", "/a/b", "file:"),
        ("file:///a/b", "/a/b", "file:"),
    ],
)
def test_local_paths(path, inner, root):
    from pyarrow import fs

    system, got = files.filesystem(path)
    assert isinstance(system, fs.LocalFileSystem) and got == inner and files.root_of(path) == root


def test_paths_of_other_stores(monkeypatch):
    from pyarrow import fs

    asked = []
    monkeypatch.setattr(files.fs, "FileSystem", type("F", (), {"from_uri": staticmethod(lambda u: (asked.append(u), "x"))}))
    for path, uri, root in (
        ("s3a://bucket/k", "s3://bucket/k", "s3a://"),
        ("hdfs://name:8020/a", "hdfs://name:8020/a", "hdfs://name:8020"),
        ("abfss://c@account/a", "abfss://c@account/a", "abfss://c@account"),
    ):
        files.filesystem(path)
        assert asked[-1] == uri and files.root_of(path) == root
    assert fs is not None


def test_bare_paths_are_qualified_on_the_driver(spark, tmp_path):
    from shardframe.session import qualify

    assert qualify(spark, "/a/b") == "file:/a/b" and qualify(spark, "file:///a/b") in ("file:/a/b", "file:///a/b")
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "f.txt").write_text("abc")
    (tmp_path / "d" / "g.txt").write_text("ab")
    (tmp_path / "d" / "_hidden").write_text("x")
    (tmp_path / "d" / "e" / ".part").write_text("x")
    found = {r.path: r.size for r in files.list_files(spark, str(tmp_path / "d")).collect()}
    assert found == {f"file:{tmp_path}/d/e/f.txt": 3, f"file:{tmp_path}/d/g.txt": 2}
    assert files.list_files(spark, f"{tmp_path}/*/*.txt").count() == 1
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, str(tmp_path / "nothing"))


def test_what_a_driver_writes_is_deleted(spark):
    from shardframe import session

    stored = session.store(spark.range(5), "x")
    assert stored.count() == 5
    path = session._made[-1]
    others, session._made[:] = session._made[:-1], [path]
    assert session.release_shared(spark) == 1 and not os.path.exists(path.removeprefix("file:"))
    session._made[:] = others


def test_shards_have_index_and_ids(spark, tmp_path, rows):
    from shardframe.operators import sharding
    from shardframe.sources import shards

    records.write_records(spark.range(40).select(F.repeat(F.lit("x"), F.col("id").cast("int") + 1).alias("p")).repartition(3), "p", str(tmp_path / "r"))
    found, _ = records.build_record_index(spark, str(tmp_path / "r"))
    ranges = found.withColumn("sample_id", F.col("end") - F.col("begin") - 17)
    packed = sharding.pack_shard_files(sharding.assign_shards(spark.range(40), "id", 8, 2), 8, 2, 8)
    local = sharding.shard_index(packed, ranges.select("sample_id", (F.col("end") - F.col("begin")).alias("length")))
    written = shards.write_shards(ranges, local, str(tmp_path / "s")).collect()
    for r in written:
        path = r.path.removeprefix("file:")
        mine = sorted((x.ord, x.begin, x.end, x.sample_id) for x in local.filter((F.col("dp_rank") == r.dp_rank) & (F.col("file_id") == r.file_id)).collect())
        lines = open(path + ".idx").read().splitlines()
        assert lines[0] == "1" and lines[1] == f"./{os.path.basename(path)} {len(mine)}"
        assert lines[2:] == [f"{b} {e}" for _, b, e, _ in mine]
        assert open(path + ".meta").read().split() == [str(i) for *_, i in mine]
        assert os.path.getsize(path) == r.bytes == mine[-1][2]
    idx, bad = index_files.read_index(spark, written[0].path + ".idx")
    assert bad.count() == 0 and idx.count() == written[0].n_samples


@pytest.mark.parametrize("block", [1, 2, 5, 7, 1000])
def test_lines_across_blocks(spark, tmp_path, block):
    texts = {"a": "one\n\ntwo\r\nthree", "b": "x\n", "c": "\n\n", "d": "no end", "e": ""}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    got = {}
    for r in files.read_lines(spark, str(tmp_path), block).collect():
        got.setdefault(r.path[-1], []).append((r.line_no, r.text))
    want = {k: list(enumerate(v.replace("\r\n", "\n").removesuffix("\n").split("\n"))) for k, v in texts.items() if v}
    assert {k: sorted(v) for k, v in got.items()} == want


INDEX = "2\n/data/a.rec 2\n0 116\n116 232\n/data/b b.rec 1\n0 66\n"


def test_index_round_trip(spark, tmp_path, rows):
    (tmp_path / "i").write_text(INDEX)
    idx, bad = index_files.read_index(spark, str(tmp_path / "i"))
    want = [(0, "/data/a.rec", 0, 0, 116), (0, "/data/a.rec", 1, 116, 232), (1, "/data/b b.rec", 0, 0, 66)]
    assert rows(idx) == want and bad.count() == 0
    index_files.write_index(idx, str(tmp_path / "o"))
    assert rows(index_files.read_index(spark, str(tmp_path / "o"))[0]) == want
    (tmp_path / "w").write_text("3\n/a 2\n0 1\n/b 1\n0 1\n1 2\nodd\n")
    _, bad = index_files.read_index(spark, str(tmp_path / "w"))
    assert rows(bad) == [(0, "wrong number of files"), (1, "count does not fit"), (5, "range without a file"), (6, "not an index line")]


def test_offsets(spark, tmp_path, rows):
    (tmp_path / "f").write_text("0 10\n10 25\n")
    assert rows(index_files.read_offsets(spark, str(tmp_path / "f")), "ord", "begin", "end") == [(0, 0, 10), (1, 10, 25)]
    df = spark.createDataFrame([("p", 0, 0), ("p", 1, 10), ("p", 2, 25)], "path string, ord bigint, offset bigint")
    assert rows(index_files.offsets_to_ranges(df), "begin", "end") == [(0, 10), (10, 25)]


@pytest.mark.parametrize("kind", ["gpt", "bert"])
def test_npz(spark, tmp_path, kind):
    arrays, scalars = npz.KINDS[kind]
    ranges, at = [], 0
    with open(tmp_path / "n", "wb") as f:
        for i in range(3):
            buffer = io.BytesIO()
            np.savez(buffer, **{a: np.array([i, 1, 2]) for a in arrays}, **{s: np.array(i) for s in scalars})
            f.write(buffer.getvalue())
            ranges.append((i, str(tmp_path / "n"), at, at + len(buffer.getvalue())))
            at = ranges[-1][3]
    df = spark.createDataFrame(ranges, "id bigint, path string, begin bigint, end bigint")
    got = npz.read_npz_samples(df, kind).sort("id").collect()
    assert [r.text for r in got] == [[i, 1, 2] for i in range(3)]
    assert all([r[s] for r in got] == [0, 1, 2] for s in scalars)


def test_state_dir(spark, tmp_path, rows):
    root = tmp_path / "st" / "snap" / "3"
    (root / "groups").mkdir(parents=True)
    a = np.arange(24, dtype="<f4").reshape(6, 4)
    (root / "w.0.numpy.ndarray").write_bytes(a.tobytes())
    (root / "w.0.numpy.ndarray.meta").write_text("float32\n2\n6\n4\n")
    (root / "it.int").write_text("50")
    (root / "groups" / "dir.meta").write_text("list\n1")
    (root / "groups" / "0.none").write_text("None")
    (root / "empty.numpy.ndarray").write_bytes(b"")
    (root / "empty.numpy.ndarray.meta").write_text("f32\n2\n0\n3\n")
    (root / "bare.numpy.ndarray").write_bytes(b"1234")
    (root / "short.numpy.ndarray").write_bytes(b"1234")
    (root / "short.numpy.ndarray.meta").write_text("f32\n1\n2\n")
    (root / "lone.numpy.ndarray.meta").write_text("f32\n1\n2\n")
    (root / "odd.numpy.ndarray").write_bytes(b"1234")
    (root / "odd.numpy.ndarray.meta").write_text("bf16\n1\n2\n")
    (root / "x.pickle").write_bytes(b"1")
    (root / "bad").mkdir()
    (root / "bad" / "dir.meta").write_text("list\nx")
    (tmp_path / "st" / "stray.int").write_text("1")
    tensors, values, lists, bad = state.read_state_dir(spark, str(tmp_path / "st"), chunk_bytes=40)
    name = F.regexp_extract("file", r"([^/]+(/dir\.meta)?)$", 1)
    assert rows(bad.select(name, "reason")) == [
        ("bad/dir.meta", "list without a length"),
        ("bare.numpy.ndarray", "tensor without a meta file"),
        ("lone.numpy.ndarray.meta", "meta file without its tensor"),
        ("odd.numpy.ndarray", "unreadable meta file"),
        ("short.numpy.ndarray", "size does not fit the shape"),
        ("stray.int", "not below a snapshot and rank"),
        ("x.pickle", "unknown type"),
    ]
    empty = tensors.filter("path = 'empty'").collect()
    assert [(r.shape, r.chunk_shape, bytes(r.data)) for r in empty] == [([0, 3], [0, 3], b"")]
    tensors = tensors.filter("path <> 'empty'")
    from test_tensors import whole

    assert tensors.count() == 3 and (whole(tensors)["w.0"] == a).all()
    assert rows(values) == [("snap", 3, "groups/0", "none", "None"), ("snap", 3, "it", "int", "50")]
    assert rows(lists) == [("snap", 3, "groups", 1)]


def test_json_sets(spark, tmp_path, rows):
    base = tmp_path / "pp02" / "mp01" / "dp01"
    (base / "rank01").mkdir(parents=True)
    (base / "rank01" / "mp_rank_00_001.json").write_text('{"model": {"b": {"tensor": [2]}, "a": 1.5}}')
    (base / "rank_map.json").write_text('{"1": {"pp_rank": 1, "mp_rank": 0, "dp_rank": 0}}')
    (base / "model_keys.json").write_text('{"1": [["model", "b"], ["model", "a"]]}')
    (tmp_path / "s.json").write_text('[{"step": 0, "size": 16}, {"time": 35, "size": 0}]')
    (tmp_path / "c.json").write_text('{"4": {"dp_size": 1, "pp_size": 2, "mp_size": 2}}')
    df = structures.config_degrees(structures.read_structures(spark, str(tmp_path)))
    assert rows(df, "rank", "path", "kind", "pp_size") == [(1, "model", "dict", 2), (1, "model/a", "value", 2), (1, "model/b", "tensor", 2)]
    assert rows(structures.read_rank_map(spark, str(tmp_path))) == [("pp02/mp01/dp01", 1, 1, 0, 0)]
    assert rows(structures.read_model_keys(spark, str(tmp_path)), "key_ord", "path") == [(0, "model/b"), (1, "model/a")]
    assert rows(structures.read_schedule(spark, str(tmp_path / "s.json"))) == [("s", 0, 0, None, 16), ("s", 1, None, 35, 0)]
    assert rows(structures.read_para_configs(spark, str(tmp_path / "c.json"))) == [("c", 4, 2, 1, 2)]


def test_logs_metrics_md5(spark, tmp_path, rows):
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1" / "w.log").write_text("a\nb\n")
    assert rows(logs.read_logs(spark, str(tmp_path / "run1"))) == [("run1", "run1/w.log", 0, "a"), ("run1", "run1/w.log", 1, "b")]
    df = spark.createDataFrame([(1, 2, 3, 4.5)], "tp int, dp int, pp int, throughput double")
    logs.write_metrics(df, str(tmp_path / "m"))
    assert rows(logs.read_metrics(spark, str(tmp_path / "m"), "tp int, dp int, pp int, throughput double")) == [(1, 2, 3, 4.5)]
    got = checksums.md5_manifest(spark, str(tmp_path / "run1"))
    assert [r.md5 for r in got.collect()] == ["dd8c6a395b5dd36c56d23275028f526c"]
    (tmp_path / "man").write_text("dd8c6a395b5dd36c56d23275028f526c  /a b\nno\n")
    assert rows(logs.read_manifest(spark, str(tmp_path / "man"))) == [("/a b", "dd8c6a395b5dd36c56d23275028f526c")]


def test_task_code_needs_no_package_on_executors():
    """Record code that travels to workers must load where the package is not installed."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    path = os.path.join(os.path.dirname(__file__), "pickled.tmp")
    code = f"import pickle; f = pickle.load(open({path!r}, 'rb')); print(f([b'123456789'])[0] == 0xE3069283)"
    try:
        with open(path, "wb") as f:
            f.write(cloudpickle.dumps(records.crc32c_many))
        done = subprocess.run([sys.executable, "-I", "-c", code], capture_output=True, text=True, cwd="/", timeout=60)
    finally:
        os.remove(path)
    assert done.stdout.strip() == "True", done.stderr


def test_many_small_json_files_are_few_tasks(spark, tmp_path):
    """Tasks list and read the files; neither the driver plans them nor is each a split."""
    from shardframe.sources import structures

    for k in range(300):
        (tmp_path / f"job{k}.json").write_text(json.dumps([{"step": k, "size": 4}, {"step": k + 1, "size": 0}]))
    read = structures.read_schedule(spark, str(tmp_path))
    assert sorted((r.job, r.point, r.step, r.size) for r in read.collect()) == sorted(
        (f"job{k}", p, k + p, 4 - 4 * p) for k in range(300) for p in (0, 1)
    )
    assert "FileScan text" not in read._jdf.queryExecution().executedPlan().toString()


def test_small_batches_and_file_counts(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(600))], names=["i"])
    parts = list(files.small_batches(iter([batch, batch.slice(0, 0)])))
    assert [p.num_rows for p in parts] == [256, 256, 88] and sum((p["i"].to_pylist() for p in parts), []) == list(range(600))
    texts = spark.createDataFrame([("ab",), (None,), ("é" * 10,)], "t string")
    assert [files.file_count(texts, "t", 2, limit) for limit in (100, 10, 5)] == [2, 3, 5]
    assert files.file_count(texts.filter("false"), "t", 4) == 4


def test_files_of_jobs_lie_in_many_folders(spark, rows, tmp_path, monkeypatch):
    """Forty customers with two orders each; a folder has few of their files, and the stages are those of all."""
    made = tmp_path / "made"
    monkeypatch.setattr(file_queries, "new_shared_path", lambda spark, name: str(made))
    spark.range(40).select(F.col("id").alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    orders = [(k, k % 40, "2-HIGH" if k < 40 else "5-LOW") for k in range(80)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    got = rows(file_queries.d15_json(spark, str(tmp_path)), "job", "stage", "start_step", "end_step", "size")
    want = [(f"job{k % 40}", k // 40, k, k + 40 if k < 40 else 100000000, 4 if k < 40 else 16) for k in range(80)]
    assert got == sorted(want, key=repr)
    for kind in ("schedules", "degrees"):
        assert sorted(f.name for f in made.glob(f"{kind}/*/*.json")) == sorted(f"job{k}.json" for k in range(40))
        assert max(len(list(f.iterdir())) for f in (made / kind).iterdir()) < 20
