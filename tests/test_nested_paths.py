import random

import pytest
from pyspark.sql import functions as F

from shardframe.operators import catalogue

SCHEMA = "path string, is_dir boolean, size long, version long"


def tree(seed, n, depth):
    """A full catalogue: every parent of a path is listed."""
    r = random.Random(seed)
    names = ["a", "a-b", "a.b", "b", "é", "10", "9", "a\x01", "zz"]
    files = {"/" + "/".join(r.choice(names) + str(r.randrange(3)) for _ in range(r.randint(1, depth))) + f"/f{k}" for k in range(n)}
    dirs = {"/"} | {f.rsplit("/", k)[0] for f in files for k in range(1, f.count("/"))}
    rows = [(f, False, r.randrange(100), 1) for f in files] + [(d, True, 0, 0) for d in dirs]
    r.shuffle(rows)
    return rows


def brute(rows):
    """Numbers below each path, and its place when all are sorted by components."""
    parts = {p: [x for x in p.split("/") if x] for p, *_ in rows}
    order = sorted(parts, key=lambda p: [x.encode() for x in parts[p]])
    out = []
    for path, is_dir, *_ in rows:
        own = parts[path]
        below = [(q, d, s) for q, d, s, _ in rows if q != path and parts[q][: len(own)] == own]
        at = order.index(path)
        children = sum(len(parts[q]) == len(own) + 1 for q, _, _ in below)
        out.append((path, at, at + 1 + len(below), children, sum(not d for _, d, _ in below), sum(d for _, d, _ in below), sum(s for *_, s in below)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_nested_order_against_brute_force(spark, rows, ranges):
    made = tree(ranges, 120, 6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        got = catalogue.nested_order(spark.createDataFrame(made, SCHEMA))
        assert rows(got, "path", "at", "until", "children", "files", "dirs", "bytes") == brute(made)
        kept = {r["path"]: (r["is_dir"], r["size"], r["version"]) for r in got.collect()}
        assert kept == {p: tuple(x) for p, *x in made}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_deep_and_flat(spark, rows):
    deep = [("/" + "/".join(f"d{k}" for k in range(n)), True, 0, 0) for n in range(1, 60)] + [("/", True, 0, 0), ("/" + "/".join(f"d{k}" for k in range(60)), False, 7, 1)]
    flat = [("/z", True, 0, 0)] + [(f"/z/f{k}", False, 1, 1) for k in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows(catalogue.nested_order(spark.createDataFrame(deep + flat, SCHEMA)), "path", "at", "until", "children", "files", "dirs", "bytes")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(deep + flat)


def test_subtrees_are_ranges(spark, rows):
    made = tree(9, 60, 4)
    nested = catalogue.nested_order(spark.createDataFrame(made, SCHEMA))
    for root in ("/", made[0][0], next(p for p, d, *_ in made if d and p != "/")):
        want = sorted(p for p, *_ in made if root == "/" or p == root or p.startswith(root + "/"))
        assert sorted(r["path"] for r in catalogue.subtree(nested, root).collect()) == want
    assert catalogue.subtree(nested, "/none").count() == 0


def test_no_explode_in_the_plan(spark, capsys):
    catalogue.path_stats(spark.createDataFrame(tree(1, 20, 3), SCHEMA)).explain()
    assert "Generate" not in capsys.readouterr().out
    assert catalogue.path_stats(spark.createDataFrame([], SCHEMA)).count() == 0
