import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardframe.operators import tensors

SCHEMA = (
    "snapshot string, rank bigint, path string, dtype string, shape array<bigint>, chunk_offset array<bigint>,"
    " chunk_shape array<bigint>, data binary"
)


def name_of(array):
    return {"f": "f", "i": "i", "u": "u"}[array.dtype.kind] + str(array.dtype.itemsize * 8)


def chunked(arrays, cuts=None):
    """Rows of named arrays, cut along each dimension in ``cuts``."""
    out = []
    for path, a in arrays.items():
        boxes = [()]
        for d, n in enumerate(a.shape):
            step = (cuts or {}).get(d, max(n, 1))
            boxes = [b + ((lo, min(lo + step, n)),) for b in boxes for lo in range(0, n, step)]
        for box in boxes:
            part = a[tuple(slice(lo, hi) for lo, hi in box)]
            out.append(("s", 0, path, name_of(a), list(a.shape), [lo for lo, _ in box], list(part.shape), bytearray(part.tobytes())))
    return out


def frame(spark, arrays, cuts=None):
    return spark.createDataFrame(chunked(arrays, cuts), SCHEMA)


def whole(df):
    """Arrays by path, from chunks; every element must be covered once."""
    out, seen = {}, {}
    for r in df.collect():
        shape = tuple(r.shape)
        a = out.setdefault(r.path, np.zeros(shape, tensors.numpy_type(r.dtype)))
        n = seen.setdefault(r.path, np.zeros(shape, int))
        assert a.shape == shape
        box = tuple(slice(o, o + s) for o, s in zip(r.chunk_offset, r.chunk_shape))
        a[box] = np.frombuffer(r.data, a.dtype).reshape(tuple(r.chunk_shape))
        n[box] += 1
    assert all((n == 1).all() for n in seen.values())
    return out


GRID = np.arange(16, dtype="<i4").reshape(4, 4)


@pytest.mark.parametrize("cuts", [None, {0: 3}, {1: 2}, {0: 1, 1: 3}])
@pytest.mark.parametrize("text, box", [("1:3,1:3", np.s_[1:3, 1:3]), ("1:3", np.s_[1:3]), (":,1:3", np.s_[:, 1:3]), ("", np.s_[:])])
def test_range(spark, cuts, text, box):
    cut, bad = tensors.tensor_range(frame(spark, {"t": GRID}, cuts), text)
    assert (whole(cut)["t"] == GRID[box]).all()
    assert bad.count() == 0


def test_range_out_of_bounds(spark):
    df = frame(spark, {"t": GRID, "v": np.arange(9, dtype="<i4")})
    cut, bad = tensors.tensor_range(df, "0:5,:")
    assert cut.count() == 0
    assert sorted(r.path for r in bad.collect()) == ["t", "v"]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.data())
def test_range_property(spark, data):
    shape = tuple(data.draw(st.lists(st.integers(1, 5), min_size=1, max_size=3)))
    a = np.arange(np.prod(shape), dtype="<f8").reshape(shape)
    cuts = {d: data.draw(st.integers(1, 5)) for d in range(len(shape))}
    bounds = [sorted(data.draw(st.lists(st.integers(0, n), min_size=2, max_size=2))) for n in shape]
    cut, _ = tensors.tensor_range(frame(spark, {"t": a}, cuts), ",".join(f"{lo}:{hi}" for lo, hi in bounds))
    want = a[tuple(slice(lo, hi) for lo, hi in bounds)]
    got = whole(cut)
    assert got["t"].shape == want.shape and (got["t"] == want).all()


def test_flatten_slice_sub(spark):
    a = np.arange(60, dtype="<f4").reshape(3, 4, 5)
    for cuts in (None, {0: 2}, {1: 3}, {1: 3, 2: 2}):
        df = frame(spark, {"t": a}, cuts)
        assert (whole(tensors.flatten_tensors(df))["t"] == a.ravel()).all()
        assert (whole(tensors.slice_rows(df, 1, 3)[0])["t"] == a[1:3]).all()
        assert (whole(tensors.sub(df, 2)[0])["t"] == a[2]).all()
    assert tensors.slice_rows(frame(spark, {"t": a}), 2, 9)[1].count() == 1


def test_concat(spark):
    a, b = np.arange(8, dtype="<i4").reshape(2, 2, 2), np.arange(8, 16, dtype="<i4").reshape(2, 2, 2)

    def parts(x, y, cuts=None):
        one = frame(spark, {"t": x}, cuts).withColumn("part", F.lit(0))
        return one.unionByName(frame(spark, {"t": y}, cuts).withColumn("part", F.lit(1)))

    joined, _ = tensors.concat_tensors(parts(a, b, {0: 1}), ["path"], "part", 1)
    assert whole(joined)["t"].ravel().tolist() == [0, 1, 2, 3, 8, 9, 10, 11, 4, 5, 6, 7, 12, 13, 14, 15]
    line, _ = tensors.concat_tensors(parts(np.arange(4, dtype="<i4"), np.arange(4, 8, dtype="<i4")), ["path"], "part", 0)
    assert whole(line)["t"].tolist() == list(range(8))
    reasons = {
        "unequal dimension": (a, np.zeros((2, 2, 3), "<i4"), 1),
        "unequal dtype": (a, b.astype("<f4"), 1),
        "no such dimension": (a, b, 3),
    }
    for reason, (x, y, dim) in reasons.items():
        good, bad = tensors.concat_tensors(parts(x, y), ["path"], "part", dim)
        assert good.count() == 0 and [r.reason for r in bad.collect()] == [reason]


def test_pad(spark, monkeypatch):
    monkeypatch.setattr(tensors, "MAX_PAD_BYTES", 40)
    a = np.ones((2, 3), "<f4")
    df = frame(spark, {"t": a}, {0: 1}).withColumn("to", F.expr("array(9L, 3L)"))
    padded = whole(tensors.pad_tensors(df, "to")[0])["t"]
    assert padded.shape == (9, 3) and (padded[:2] == 1).all() and (padded[2:] == 0).all()
    bad = tensors.pad_tensors(df.withColumn("to", F.expr("array(2L, 4L)")), "to")[1]
    assert bad.count() == 1


def test_validate(spark, rows):
    good = chunked({"ok": GRID.astype("<f4")})[0]
    bad = [
        (*good[:2], "type", "bool", *good[4:]),
        (*good[:2], "bytes", *good[3:7], bytearray(b"123")),
        (*good[:2], "box", good[3], [3, 4], *good[5:]),
        (*good[:2], "rank", good[3], [4, 4, 1], *good[5:]),
    ]
    long = (*good[:3], "float32", *good[4:])
    ok, wrong = tensors.validate_tensors(spark.createDataFrame([long, *bad], SCHEMA))
    assert rows(ok, "path", "dtype") == [("ok", "f32")]
    half = (*good[:2], "half", "f32", good[4], good[5], [2, 4], bytearray(bytes(good[7])[:32]))
    fine, gap = tensors.validate_tensors(spark.createDataFrame([long, half], SCHEMA))
    assert rows(fine, "path") == [("ok",)] and rows(gap, "path", "reason") == [("half", "chunks do not cover the shape")]
    assert rows(wrong, "path", "reason") == [
        ("box", "chunk outside shape"), ("bytes", "wrong byte length"), ("rank", "rank mismatch"), ("type", "unknown dtype"),
    ]


@pytest.mark.parametrize("dtype", tensors.DTYPES)
def test_decode(spark, dtype):
    a = np.array([[1, 2], [3, 120]]).astype(tensors.numpy_type(dtype))
    df = tensors.decode_elements(frame(spark, {"t": a}, {1: 1}), dtype)
    assert {tuple(r["at"]): float(r["value"]) for r in df.collect()} == {(0, 0): 1, (0, 1): 2, (1, 0): 3, (1, 1): 120}


def test_empty_slices_are_empty_tensors(spark):
    a = np.arange(8, dtype="<f4").reshape(4, 2)
    for cuts in (None, {0: 1}, {1: 1}):
        df = frame(spark, {"t": a}, cuts)
        none, bad = tensors.slice_rows(df, 2, 2)
        assert bad.count() == 0 and whole(none)["t"].shape == (0, 2)
        none, bad = tensors.tensor_range(df, "1:3,1:1")
        assert bad.count() == 0 and whole(none)["t"].shape == (2, 0)


def test_files_and_meta(spark, rows, tmp_path):
    arrays = {"a": np.arange(6, dtype="<f4").reshape(2, 3), "b": np.arange(9, dtype="i1").reshape(3, 3)}
    from shardframe.sources.state import read_state_dir

    files = tensors.write_tensors(frame(spark, arrays, {1: 2}), str(tmp_path / "t")).collect()
    assert sorted(r.bytes for r in files) == [9, 24]
    back, _, _, bad = read_state_dir(spark, str(tmp_path / "t"), chunk_bytes=12)
    assert bad.count() == 0 and all((whole(back)[k] == v).all() for k, v in arrays.items())
    meta = spark.createDataFrame([("f32\n2\n2\n3\n",), ("f32\n3\n2\n3\n",), ("x",)], "t string")
    assert rows(tensors.parse_meta(meta, "t"), "dtype", "shape") == [("f32", [2, 3]), (None, None), (None, None)]
    assert rows(frame(spark, {"a": arrays["a"]}).select(tensors.format_meta())) == [("f32\n2\n2\n3\n",)]
    assert rows(tensors.tensor_stats(frame(spark, {"x/a": arrays["a"], "x/b": arrays["b"]}, {1: 2})))[0] == ("s", "x", 2, 15, 33)


def test_ranges_of_tables_that_do_not_fill_their_last_chunk(spark, tmp_path):
    """26 vectors, one of them missing and one twice."""
    from shardframe.plans import QUERIES

    ids = [i for i in range(27) if i != 3] + [12]
    vectors = [(i, [float(i * 100 + k) for k in range(64)]) for i in ids]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, QUERIES["x4_tensor_range"].run(spark, str(tmp_path)).select("path", "a", "b", "value").collect()))
    assert got == sorted((f"t/{i // 20}", i % 20 - 5, b - 10, v[b]) for i, v in vectors if i % 20 >= 5 for b in range(10, 20))
    got = sorted(map(tuple, QUERIES["x2_flatten_columns"].run(spark, str(tmp_path)).select("path", "a", "value").collect()))
    assert got == sorted((f"t/{i // 20}", i % 20 * 24 + b - 16, v[b]) for i, v in vectors for b in range(16, 40))


def test_bytes_of_a_batch_are_made_at_once():
    """Nulls, empty cells and a slice of a batch; the elements of all cells are one array, without an object for each."""
    arrays = pa.array([[9.0], [1.0, None], None, [], [2.5]], pa.list_(pa.float32())).slice(1)
    data = tensors._encoded(arrays, "<f4")
    assert [c if c is None else np.frombuffer(c, "<f4").tolist() for c in data.to_pylist()][1:] == [None, [], [2.5]]
    assert np.isnan(np.frombuffer(data[0].as_py(), "<f4")).tolist() == [False, True]
    assert tensors._decoded(data, "<f4", np.float64).to_pylist() == [[1.0, None], None, [], [2.5]]
    assert tensors._decoded(data.slice(1), "<f4", np.float64).to_pylist() == [None, [], [2.5]]
    wide = pa.array([[2**53 + 1], [1, None], []], pa.list_(pa.int64()))
    assert tensors._encoded(wide.slice(0, 1), "<i8")[0].as_py() == (2**53 + 1).to_bytes(8, "little")
    assert tensors._decoded(pa.array([], pa.binary()), "<i4", np.int64).to_pylist() == []
    with pytest.raises(ValueError):
        tensors._decoded(pa.array([b"abc"]), "<i4", np.int64)
