import pytest
from pyspark.sql import functions as F

from shardframe.operators import allocation, catalogue, placement


def ring(spark, n=4):
    return spark.range(n).select(F.col("id").alias("host_ord"))


def test_replicas(spark, rows):
    copies = placement.replicas(ring(spark), 1)
    assert rows(copies.filter("owner = 3"), "copy", "host_ord") == [(0, 3), (1, 0)]
    with pytest.raises(Exception, match="fewer hosts than copies"):
        placement.replicas(ring(spark), 4).collect()


def test_fallback(spark, rows):
    copies = placement.replicas(ring(spark), 1)
    items = spark.createDataFrame([("x", 5)], "item string, device bigint")

    def source(*down):
        failed = spark.createDataFrame([(d,) for d in down], "host_ord bigint")
        return rows(placement.resolve_source(items, copies, failed, 4), "source", "unrecoverable")

    assert source() == [(1, False)]
    assert source(1) == [(2, False)]
    assert source(1, 2) == [(None, True)]
    failed = spark.createDataFrame([(1,), (2,)], "host_ord bigint")
    owned = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "item string, owner bigint")
    assert rows(placement.failure_impact(owned, copies, failed)) == [("x", 1, 0, False), ("y", 2, 1, True)]


def test_diff_and_groups(spark, rows):
    a = spark.createDataFrame([(0, "h", 1, "x"), (1, "h", 2, "y")], "at bigint, host string, port bigint, item string")
    b = spark.createDataFrame([(0, "h", 1, "x"), (1, "g", 2, "y")], "at bigint, host string, port bigint, item string")
    assert rows(placement.placement_diff(a, b), "host", "side") == [("g", "only_right"), ("h", "common"), ("h", "only_left")]
    assert rows(placement.placement_relation(a, b, "at")) == [(False, False)]
    assert rows(placement.placement_relation(a, a, "at")) == [(True, False)]
    assert placement.others(a, "h", 1).count() == 1 and placement.on_host(b, "g").count() == 1
    peers = spark.createDataFrame([(0, "1.2.3.4"), (1, "1.2.3.4"), (2, "4.3.2.1")], "rank bigint, host string")
    assert rows(placement.host_groups(peers), "rank", "local_rank", "local_size", "master", "host_count") == [
        (0, 0, 2, 0, 2), (1, 1, 2, 0, 2), (2, 0, 1, 2, 2),
    ]


TREE = [("/", True), ("/a", True), ("/a/b", True), ("/a/c", True), ("/a/b/x.txt", False), ("/a/b/y.txt", False), ("/a/c/z.txt", False), ("/ab", False)]


def tree(spark):
    return spark.createDataFrame([(p, d, 0 if d else 5, 1) for p, d in TREE], "path string, is_dir boolean, size bigint, version bigint")


def test_catalogue(spark, rows):
    kept, counts = catalogue.path_delete(tree(spark), "/a")
    assert rows(counts) == [(3, 3)] and rows(kept, "path") == [("/",), ("/ab",)]
    assert rows(catalogue.path_find(tree(spark), "/a/b", "x"), "path") == [("/a/b/x.txt",)]
    assert rows(catalogue.path_list(tree(spark), "a/c"), "path") == [("/a/c",), ("/a/c/z.txt",)]
    assert rows(catalogue.path_stats(tree(spark)).filter("path = '/a'")) == [("/a", 2, 3, 2, 15)]


def test_upsert(spark, rows):
    new = spark.createDataFrame(
        [("/a/b/x.txt", False, 9, 2), ("n//m/k", False, 1, 2), ("/ab/under", False, 1, 2)], "path string, is_dir boolean, size bigint, version bigint"
    )
    cat, bad = catalogue.path_upsert(tree(spark), new, replace=True)
    assert rows(cat.filter("path IN ('/a/b/x.txt', '/n/m/k', '/n/m', '/n')"), "path", "is_dir", "size") == [
        ("/a/b/x.txt", False, 9), ("/n", True, 0), ("/n/m", True, 0), ("/n/m/k", False, 1),
    ]
    assert rows(bad, "path", "reason") == [("/ab/under", "parent is a file")]
    cat, bad = catalogue.path_upsert(tree(spark), new, replace=False)
    assert rows(cat.filter("path = '/a/b/x.txt'"), "size") == [(5,)]
    assert rows(bad, "path", "reason") == [("/a/b/x.txt", "path exists"), ("/ab/under", "parent is a file")]


def test_equal_shares(spark):
    jobs = spark.createDataFrame([(i, i, 10 if i == 2 else None) for i in range(1, 6)], "job bigint, arrive bigint, finish bigint")
    got = {r.time: r for r in allocation.equal_shares(jobs, 4, 4).collect()}
    assert [got[t].share for t in range(1, 6)] == [16, 8, 4, 4, 2]
    assert (got[2].host_lo, got[2].host_hi, got[4].idle, got[10].share) == (2, 4, 0, 4)
    assert got[5].hosts == 0 and got[10].slot is None
