import random

import pytest
from pyspark.sql import functions as F

from shardframe.operators import index
from shardframe.plans import QUERIES

IDX = [(0, "/data/a.rec", 0, 0, 116), (0, "/data/a.rec", 1, 116, 232), (1, "/data/b.rec", 0, 0, 66)]
SCHEMA = "file_ord bigint, path string, range_ord bigint, begin bigint, end bigint"


def idx(spark):
    return spark.createDataFrame(IDX, SCHEMA)


def test_named_and_selected(spark, rows):
    named = index.named_ranges(idx(spark))
    assert rows(named, "sample_id", "path", "begin") == [(0, "/data/a.rec", 0), (1, "/data/a.rec", 116), (2, "/data/b.rec", 0)]
    ids = spark.createDataFrame([(0, 2), (1, 0), (2, 2)], "position bigint, sample_id bigint")
    found, lost = index.select_ranges(named, ids.unionByName(spark.createDataFrame([(3, 99)], ids.schema)))
    assert rows(lost) == [(3, 99, "unknown sample")]
    assert rows(found, "position", "path", "end") == [(0, "/data/b.rec", 66), (1, "/data/a.rec", 116), (2, "/data/b.rec", 66)]


def test_stats_and_regions(spark, rows):
    assert rows(index.index_stats(idx(spark)), "path", "n_ranges", "indexed_bytes") == [
        ("/data/a.rec", 2, 232), ("/data/b.rec", 1, 66), (None, 3, 298),
    ]
    assert rows(index.region_totals(idx(spark))) == [(2, 2, 3)]
    ids = spark.createDataFrame([(1,), (1,)], "sample_id bigint")
    assert rows(index.region_coverage(index.region_map(idx(spark)), ids)) == [(0, 2, 1), (1, 1, 0)]


def test_locate(spark, rows):
    requests = spark.createDataFrame([(7, 100, 200), (8, 298, 10)], "request bigint, pos bigint, length bigint")
    got = index.locate(index.logical_ranges(idx(spark)), requests, width=50)
    assert rows(got, "request", "path", "begin", "end") == [
        (7, "/data/a.rec", 100, 116), (7, "/data/a.rec", 116, 232), (7, "/data/b.rec", 0, 66),
    ]


def test_paths(spark, rows):
    df = spark.createDataFrame([("http://h:80/a/b",), ("/a/b",), ("file:///a/b",), ("s3://x/a",)], "path string")
    assert rows(index.set_host(df, "")) == [("/a",), ("/a/b",), ("/a/b",), ("/a/b",)]
    assert rows(index.set_host(df, "n")) == [("//n/a/b",), ("file://n/a/b",), ("http://n/a/b",), ("s3://n/a",)]
    assert rows(index.rebase_paths(df, "/a", "/z")) == [("/z/b",), ("file:///z/b",), ("http://h:80/z/b",), ("s3://x/z",)]
    good, bad = index.localize_index(df, "n:1")
    assert rows(good) == [("http://n:1/a/b",), ("http://n:1/a/b",)]
    assert rows(bad, "path") == [("http://h:80/a/b",), ("s3://x/a",)]


def test_check_and_md5(spark, rows):
    files = spark.createDataFrame([("/data/a.rec", 232), ("/data/b.rec", 60), ("/data/c.rec", 1)], "path string, size bigint")
    assert rows(index.check_index(idx(spark), files), "path", "status") == [
        ("/data/a.rec", "ok"), ("/data/b.rec", "size mismatch"), ("/data/c.rec", "not indexed"),
    ]
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "path string, md5 string")
    b = spark.createDataFrame([("x", "1"), ("y", "3"), ("z", "4")], "path string, md5 string")
    assert rows(index.verify_md5(a, b), "path", "status") == [("x", "ok"), ("y", "mismatch"), ("z", "missing")]


def test_lookup_reports_unknown_samples(spark, rows):
    ids = spark.createDataFrame([(0, 0), (1, 3), (2, 7)], "position bigint, sample_id bigint")
    found, lost = index.lookup_samples(idx(spark), ids, 2)
    assert rows(found, "position", "size") == [(0, 116)]
    assert rows(lost) == [(1, 3, "unknown sample"), (2, 7, "unknown sample")]


def test_shard(spark, rows):
    named = index.named_ranges(idx(spark))
    assert rows(index.index_shard(named, 0, 2), "sample_id") == [(0,), (1,)]
    assert rows(index.index_shard(named, 1, 2), "sample_id") == [(2,)]
    assert rows(index.index_shard(named, 4, 5), "sample_id") == []


def test_long_file_uses_several_keys(spark, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 4)
    df = spark.range(23).select(
        F.expr("if(id < 20, 0L, 1L)").alias("file_ord"), F.lit("p").alias("path"), F.expr("if(id < 20, id, id - 20)").alias("range_ord"),
        F.col("id").alias("begin"), (F.col("id") + 1).alias("end"),
    )
    got = index.named_ranges(df).select("sample_id", "begin").collect()
    assert sorted(r.sample_id for r in got) == list(range(23)) and all(r.sample_id == r.begin for r in got)


@pytest.mark.parametrize("name", ["i2_far_ids", "d14_far_samples"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_far_ids_are_unknown_at_every_size(spark, name, sf):
    events = spark.read.parquet(f"/root/testdata/{sf}/events.parquet")
    assert QUERIES[name].run(spark, f"/root/testdata/{sf}").count() == events.filter("event_id % 10 = 0").count() > 0


def test_bitmaps_of_sets_and_their_unions(spark, rows):
    """Sets of many files, over several bitmaps of a file; unions by the first part of the set's name."""
    r = random.Random(3)
    named = [(f"job{r.randrange(3)}", r.randrange(4), r.randrange(5), r.choice([0, 1, 32767, 32768, 70_000, r.randrange(100_000)])) for _ in range(800)]
    placed = spark.createDataFrame(named, "job string, stage long, file_ord long, region long")
    maps = index.region_bitmaps(placed, ["job", "stage"])
    assert rows(index.bitmap_regions(maps), "job", "stage", "file_ord", "region") == sorted(set(named), key=repr)
    merged = index.merge_bitmaps(maps, ["job"])
    assert rows(index.bitmap_regions(merged), "job", "file_ord", "region") == sorted({(j, f, x) for j, _, f, x in named}, key=repr)
    files = spark.createDataFrame([(f, 100_000 + f) for f in range(5)], "file_ord long, n_ranges long")
    want = {}
    for j, _, f, x in named:
        want.setdefault((j, f), set()).add(x)
    assert rows(index.bitmap_coverage(merged, files, ["job"])) == sorted(((j, f, 100_000 + f, len(x)) for (j, f), x in want.items()), key=repr)
    assert index.bitmap_regions(index.region_bitmaps(placed.limit(0), ["job"])).count() == 0


@pytest.mark.parametrize("repeats", [0, 60])
def test_span_coverage_is_that_of_the_regions(spark, rows, repeats):
    """Spans that touch, overlap or are empty; regions at one position and, with repeats, at several."""
    r = random.Random(repeats)
    regions = [(k % 3 * (k % 4 // 2), k) for k in range(300)]
    regions += [r.choice(regions) for _ in range(repeats)]
    r.shuffle(regions)
    placed = [(p, f, x) for p, (f, x) in enumerate(regions)]
    spans = []
    for k in range(60):
        lo = r.randrange(len(regions) + 20)
        spans += [(f"job{k % 9}", k, lo, hi := lo + r.randrange(40)), *([(f"job{k % 9}", k + 100, hi, hi + 5)] if k % 3 else [])]
    files = spark.createDataFrame([(f, 1000 + f) for f in range(4)], "file_ord long, n_ranges long")
    want = {}
    for job, _, lo, hi in spans:
        for p, f, x in placed[lo:hi]:
            want.setdefault((job, f), set()).add(x)
    placed = spark.createDataFrame(placed, "position long, file_ord long, region long")
    spans = spark.createDataFrame(spans, "job string, stage long, lo long, hi long")
    got = index.span_coverage(placed, spans, files, ["job"], "stage")
    assert rows(got, "job", "file_ord", "regions", "covered") == sorted(((j, f, 1000 + f, len(x)) for (j, f), x in want.items()), key=repr)
    assert index.span_coverage(placed, spans.limit(0), files, ["job"], "stage").count() == 0


def test_span_coverage_follows_the_ends_and_files(spark):
    """Two thousand jobs read two hundred thousand regions each, which are never rows."""
    placed = spark.range(200_000).selectExpr("id AS position", "id % 2 AS file_ord", "id AS region")
    spans = spark.range(2000).selectExpr("id AS job", "0L AS stage", "0L AS lo", "200000L AS hi")
    files = spark.createDataFrame([(0, 100_000), (1, 100_000)], "file_ord long, n_ranges long")
    got = index.span_coverage(placed, spans, files, ["job"], "stage").groupBy("file_ord", "regions", "covered").count()
    assert sorted(tuple(x) for x in got.collect()) == [(f, 100_000, 100_000, 2000) for f in (0, 1)]
