import random

import numpy as np
import pytest

from shardframe.sources import records as R


def brute(data, path):
    """Records by hopping from the front, with the statuses that the index gives."""
    rows, at, k = [], 0, 0
    while at < len(data):
        head = data[at : at + 12]
        if len(head) == 12 and int.from_bytes(head[8:], "little") != R.masked_crc(head[:8]):
            return [*rows, (path, k, at, len(data), "bad length checksum")]
        n = int.from_bytes(head[:8], "little", signed=True) if len(head) == 12 else -1
        end = at + 16 + n
        if n < 0 or end > len(data):
            return [*rows, (path, k, at, len(data), "truncated")]
        good = int.from_bytes(data[end - 4 : end], "little") == R.masked_crc(data[at + 12 : end - 4])
        rows.append((path, k, at, end, "ok" if good else "bad payload checksum"))
        at, k = end, k + 1
    return rows


def encoded(payloads):
    return b"".join(R.encode_records(payloads))


def files_of(seed):
    """Files of many kinds: records inside payloads, payloads longer than regions, damage of every kind, zeros."""
    r = random.Random(seed)
    some = lambda n, most=200: [r.randbytes(r.randint(0, most)) for _ in range(n)]
    nested = encoded(some(60))
    deep = encoded([encoded([nested, *some(5)]), nested, *some(20)])
    files = {
        "plain": encoded(some(300)),
        "empty_payloads": encoded([b""] * 400),
        "nested": encoded([*some(10), nested, *some(10), nested, nested, *some(30)]),
        "deep": encoded([*some(3), deep, *some(40), deep]),
        "huge": encoded([*some(5), nested * 8, *some(5)]),
        "zeros": encoded([bytes(3000), *some(10), bytes(9000), *some(10)]),
        "shifted": encoded([*some(4), r.randbytes(7) + nested + r.randbytes(3), *some(60)]),
        "one": encoded([nested]),
        "tiny": encoded([b"x"]),
    }
    bad = bytearray(files["plain"])
    bad[len(bad) // 2] ^= 1
    files["damaged"] = bytes(bad)
    rows = brute(files["plain"], "")
    at = rows[200][2]
    bad = bytearray(files["plain"])
    bad[at] ^= 1
    files["bad_length"] = bytes(bad)
    files["cut"] = files["nested"][:-9]
    files["cut_head"] = files["plain"][: rows[250][2] + 5]
    files["payload_crc"] = bytes(files["nested"][:-1]) + bytes([files["nested"][-1] ^ 1])
    return files


@pytest.mark.parametrize("region, search", [(97, 40), (1000, 1 << 20), (4096, 300), (10**9, 1 << 20)])
def test_regions_give_the_index_of_one_pass(spark, tmp_path, rows, monkeypatch, region, search):
    monkeypatch.setattr(R, "SEARCH_BYTES", search)
    monkeypatch.setattr(R, "io_parts", lambda spark: 8)
    want = []
    for name, data in files_of(region).items():
        (tmp_path / f"{name}.rec").write_bytes(data)
        want += brute(data, f"file:{tmp_path}/{name}.rec")
    good, bad = R.build_record_index(spark, str(tmp_path), region=region)
    got = [(*x, "ok") for x in rows(good, "path", "range_ord", "begin", "end")] + rows(bad, "path", "range_ord", "begin", "end", "reason")
    assert sorted(got) == sorted(want)
    quick, rest = R.build_record_index(spark, str(tmp_path), verify=False, region=region)
    assert quick.count() == sum(w[4] in ("ok", "bad payload checksum") for w in want)


def test_one_file_is_many_tasks(spark, tmp_path):
    r = random.Random(1)
    data = encoded([r.randbytes(r.randint(0, 2000)) for _ in range(2000)])
    (tmp_path / "a.rec").write_bytes(data)
    region = len(data) // 16
    good, bad = R.build_record_index(spark, str(tmp_path), region=region)
    assert bad.count() == 0 and good.count() == 2000
    heads = R._scan_regions(spark.createDataFrame([(str(tmp_path / "a.rec"), len(data), k, None) for k in range(16)], "path string, size long, region long, start long"), region)
    from pyspark.sql import functions as F

    with_rows = heads.filter("begin IS NOT NULL").select("region", F.spark_partition_id().alias("task")).distinct().collect()
    assert len({x["region"] for x in with_rows}) >= 15 and len({x["task"] for x in with_rows}) >= 8


def test_dead_ends_are_followed_once(tmp_path, monkeypatch):
    """Whole records in a payload lead nowhere; each is looked at a few times at most, not once for every record before it."""
    data = encoded([b"", encoded([b"ab"] * 3000), b"x", b"y"])
    path = tmp_path / "n.rec"
    path.write_bytes(data)
    reads = [0]

    class Window(R._Window):
        def read(self, at, n):
            reads[0] += 1
            return super().read(at, n)

    with R.open_file(str(path)) as handle:
        place, begins, after = R.guess_chain(Window(handle, len(data)), 100, len(data))
    rows = brute(data, "")
    assert place == rows[2][2] and after == len(data) and list(begins) == [rows[2][2], rows[3][2]]
    assert reads[0] < 4 * 3000


def test_head_places():
    r = random.Random(2)
    data = b"junk" + encoded([r.randbytes(50)]) + bytes(100) + encoded([b""])
    found = R.head_places(data, 1000, 1000 + len(data))
    assert found.tolist() == [1004, 1000 + 4 + 66 + 100]
    assert R.head_places(b"short", 0, 5).tolist() == []
    assert np.array_equal(R.head_places(data[:20], 0, 20), [])
