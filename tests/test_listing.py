import io
import os
import random

import pytest

from shardframe.sources import files


def tree(root, spec):
    for name, size in spec.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(b"x" * size)


@pytest.mark.parametrize("driver, task", [(1000, 20_000), (0, 0), (3, 2), (10**9, 1)])
def test_listing_in_rounds(spark, tmp_path, rows, monkeypatch, driver, task):
    monkeypatch.setattr(files, "DRIVER_ENTRIES", driver)
    monkeypatch.setattr(files, "TASK_ENTRIES", task)
    spec = {f"flat/f{k}": k for k in range(40)} | {"/".join("abcdefgh"[: k + 1]) + "/leaf": k for k in range(8)}
    spec |= {f"wide/d{k}/e{k % 3}/x": 1 for k in range(20)} | {"top": 3, "empty_file": 0}
    hidden = {"_temporary/x": 1, ".hidden": 1, "wide/_skip/y": 1, "wide/d1/.part": 1}
    tree(tmp_path, spec | hidden)
    os.makedirs(tmp_path / "no" / "files")
    got = rows(files.list_files(spark, str(tmp_path)))
    assert got == sorted((f"file:{tmp_path}/{name}", size) for name, size in spec.items())
    assert rows(files.list_files(spark, f"{tmp_path}/wide/d1*")) == sorted((f"file:{tmp_path}/{n}", s) for n, s in spec.items() if n.startswith("wide/d1"))
    assert rows(files.list_files(spark, [f"{tmp_path}/top", f"{tmp_path}/a"])) == sorted((f"file:{tmp_path}/{n}", s) for n, s in spec.items() if n == "top" or n.startswith("a/"))


def test_a_large_folder_is_not_held_by_the_driver(spark, tmp_path, monkeypatch):
    n = 5000
    tree(tmp_path, {f"many/f{k:05d}": 0 for k in range(n)} | {"deep/" + "/".join(f"l{k}" for k in range(60)) + "/f": 0})
    held = []
    plain = spark.createDataFrame

    def counted(data, *args, **kw):
        held.append(len(data))
        return plain(data, *args, **kw)

    monkeypatch.setattr(spark, "createDataFrame", counted)
    monkeypatch.setattr(files, "TASK_ENTRIES", 10)
    assert files.list_files(spark, [f"{tmp_path}/many", f"{tmp_path}/deep"]).count() == n + 1
    assert max(held) <= 2


@pytest.mark.parametrize("block, asked", [(7, 3), (1, 1), (64, 1 << 20), (1000, 10)])
def test_lines_of_blocks(monkeypatch, block, asked):
    monkeypatch.setattr(files, "REQUEST", asked)
    r = random.Random(block)
    for _ in range(60):
        data = bytes(r.choice(b"\n\nab\r") for _ in range(r.randint(1, 90)))
        want = data.split(b"\n")
        want = want[:-1] if want[-1] == b"" else want
        got, counts = [], []
        for start in range(0, len(data), block):
            stop = min(start + block, len(data))
            mine = list(files.lines_of(io.BytesIO(data), start, stop))
            counts.append(files.lines_begun(io.BytesIO(data), start, stop))
            assert counts[-1] == len(mine)
            got += mine
        assert got == want


def test_one_long_line_is_read_once(monkeypatch):
    """A line over many blocks belongs to the first; the others read up to its end only to see that none begins in them."""
    data = b"a" * 5_000_000 + b"\nb\n"
    assert [len(x) for x in files.lines_of(io.BytesIO(data), 0, 1000)] == [5_000_000]
    assert list(files.lines_of(io.BytesIO(data), 4_999_000, len(data))) == [b"b"]


def test_read_lines(spark, tmp_path, rows):
    r = random.Random(4)
    texts = {f"f{k}.txt": "".join(r.choice(["line é\n", "\n", "x\r\n", "long " * 40 + "\n", "no end"]) for _ in range(r.randint(0, 60))) for k in range(12)}
    texts["empty.txt"] = ""
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    for block in (50, 1 << 20):
        got = rows(files.read_lines(spark, str(tmp_path), block), "path", "line_no", "text")
        want = []
        for name, text in texts.items():
            lines = text.split("\n")
            lines = lines[:-1] if lines[-1] == "" else lines
            want += [(f"file:{tmp_path}/{name}", k, t.rstrip("\r")) for k, t in enumerate(lines)]
        assert got == sorted(want, key=repr)
