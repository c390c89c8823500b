import hashlib
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardframe.operators import skew
from shardframe.operators.ordinal import following, hashed_order, run_lengths, running
from shardframe.operators.skew import dyadic_cells, overlap_join, spread_join


def test_running_with_a_hot_group(spark):
    rng = random.Random(3)
    data = [("hot" if i % 3 else f"g{i % 7}", i, rng.randint(0, 9)) for i in range(2000)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "g string, k bigint, v bigint")
    got = {(r.g, r.k): r for r in running(df, ["k"], ["g"], {"before": F.col("v")}, total="n", parts=7).collect()}
    seen, sums = {}, {}
    totals = {g: sum(1 for x in data if x[0] == g) for g, _, _ in data}
    for g, k, v in sorted(data):
        r = got[(g, k)]
        assert (r.position, r.before, r.n) == (seen.get(g, 0), sums.get(g, 0), totals[g])
        seen[g] = seen.get(g, 0) + 1
        sums[g] = sums.get(g, 0) + v


def test_running_keeps_null_groups(spark, rows):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "g string, k bigint")
    assert rows(running(df, ["k"], ["g"]), "g", "k", "position") == [("a", 1, 0), (None, 1, 0), (None, 2, 1)]


def test_hashed_order_is_a_permutation(spark):
    got = hashed_order(spark.range(1000), "id", 7).collect()
    assert sorted(r.position for r in got) == list(range(1000))
    assert {r.n_samples for r in got} == {1000}
    assert [r.sample_id for r in sorted(got)] != list(range(1000))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 2), min_size=1, max_size=40))
def test_run_lengths(spark, values):
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], "g string, k bigint, v bigint")
    got = sorted((r["run"], r["v"], r["count"]) for r in run_lengths(df, ["g"], ["k"], "v").collect())
    want = []
    for v in values:
        if want and want[-1][1] == v:
            want[-1][2] += 1
        else:
            want.append([len(want), v, 1])
    assert got == [tuple(w) for w in want]


def test_following(spark, rows):
    points = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("a", 9, "z"), ("b", 1, "w")], "g string, t bigint, n string")
    series = spark.createDataFrame([("a", 1, 10), ("a", 5, 50), ("a", 7, 70), ("c", 2, 1)], "g string, t bigint, v bigint")
    at = following(points, series, ["g"], "t", ["v"], parts=3)
    assert rows(at, "n", "next_t", "next_v") == [("w", None, None), ("x", 1, 10), ("y", 5, 50), ("z", None, None)]
    later = following(points, series, ["g"], "t", ["v"], strict=True, parts=3)
    assert rows(later, "n", "next_t") == [("w", None), ("x", 5), ("y", 7), ("z", None)]


def test_spread_join_equals_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "fits_broadcast", lambda df: False)
    big = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(500)], "k bigint, i bigint")
    small = spark.createDataFrame([(k, f"v{k}") for k in range(0, 400, 2)], "k bigint, v string")
    for how in ("inner", "left"):
        plain = sorted(map(tuple, big.join(small, "k", how).select("k", "i", "v").collect()), key=repr)
        salted = spread_join(big, small, ["k"], ["i"], how, bytes_per_copy=20 * 128)
        assert sorted(map(tuple, salted.select("k", "i", "v").collect()), key=repr) == plain


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.integers(0, 60), st.integers(0, 25)), min_size=1, max_size=12),
    st.lists(st.tuples(st.integers(0, 60), st.integers(0, 25)), min_size=1, max_size=12),
    st.integers(1, 30),
)
def test_overlap_join_equals_brute_force(spark, left, right, width):
    a = spark.createDataFrame([(i, lo, lo + n) for i, (lo, n) in enumerate(left)], "i bigint, a bigint, b bigint")
    b = spark.createDataFrame([(i, lo, lo + n) for i, (lo, n) in enumerate(right)], "j bigint, c bigint, d bigint")
    got = sorted((r.i, r.j) for r in overlap_join(a, b, ("a", "b"), ("c", "d"), width, bytes_per_copy=3 * 128).collect())
    want = sorted(
        (i, j) for i, (x, n) in enumerate(left) for j, (y, m) in enumerate(right) if n and m and max(x, y) < min(x + n, y + m)
    )
    assert got == want


def test_hot_keys_are_split_by_bytes(spark, monkeypatch):
    """A key of few but large rows is salted; every other key keeps one copy."""
    monkeypatch.setattr(skew, "fits_broadcast", lambda df: False)
    big = spark.createDataFrame([(i % 3, i, bytearray(5000 if i % 3 == 0 else 1)) for i in range(60)], "k bigint, i bigint, d binary")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k bigint, v string")
    seen = {}
    stored = skew.store
    monkeypatch.setattr(skew, "store", lambda df, name: seen.setdefault(name, stored(df, name)))
    joined = spread_join(big, small, ["k"], ["i"], weight=F.length("d"), bytes_per_copy=20_000)
    assert sorted((r.k, r.i, r.v) for r in joined.collect()) == sorted((i % 3, i, "abc"[i % 3]) for i in range(60))
    assert [(r.k, r["_copies"]) for r in seen["hot-keys"].collect()] == [(0, 6)]


def test_sides_are_broadcast_by_their_true_size(spark):
    """Neither cells that Spark takes for small are broadcast, nor the big side of a join."""
    a = spark.range(20).select(F.col("id").alias("i"), (F.col("id") * 50).alias("a"), (F.col("id") * 50 + F.expr("shiftleft(1L, id)")).alias("b"))
    b = spark.range(9000).select(F.col("id").alias("j"), F.col("id").alias("c"), (F.col("id") + 1).alias("d"))
    joined = overlap_join(a, b, ("a", "b"), ("c", "d"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    # What remains is the list of hot keys.
    assert "SortMergeJoin" in plan
    assert joined.count() == sum(max(0, min(9000, i * 50 + 2**i) - i * 50) for i in range(20))
    big, small = spark.range(10).withColumnRenamed("id", "k"), spark.range(1000).selectExpr("id AS k", "id AS v")
    plan = spread_join(big, small, ["k"], ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan


def test_overlap_join_finds_its_own_width(spark):
    a = spark.createDataFrame([(0, 0, 1_000_000), (1, 5, 6), (2, 2_000_000, 2_000_001)], "i bigint, a bigint, b bigint")
    b = spark.createDataFrame([(0, 4, 10), (1, 999_999, 1_000_001)], "j bigint, c bigint, d bigint")
    assert sorted((r.i, r.j) for r in overlap_join(a, b, ("a", "b"), ("c", "d")).collect()) == [(0, 0), (0, 1), (1, 0)]


@pytest.mark.parametrize("bucket_rows", [3, 1 << 18])
def test_hashed_order_buckets_follow_the_rows(spark, bucket_rows):
    got = hashed_order(spark.range(500), "id", 7, bucket_rows=bucket_rows).collect()
    want = sorted(range(500), key=lambda i: (hashlib.md5(f"7:{i}".encode()).hexdigest(), i))
    assert [r.sample_id for r in sorted(got, key=lambda r: r.position)] == want


def test_dyadic_cells_make_up_the_interval(spark):
    r = random.Random(3)
    spans = [(a, a + n) for a, n in ((r.randint(-5000, 5000), r.choice([0, 1, 2, 7, 300, 4000])) for _ in range(300))]
    spans += [(0, 10**15), (-(10**15), 3), (7, 8), (2**62, 2**62 + 5)]
    df = spark.createDataFrame(spans, "a bigint, b bigint")
    for bits in (0, 3):
        for row in df.select("a", "b", dyadic_cells("a", "b", bits).alias("c")).collect():
            if row["a"] >= row["b"]:
                assert row["c"] is None
                continue
            first, stop = row["a"] >> bits, ((row["b"] - 1) >> bits) + 1
            cells = sorted((c["cell"] << c["level"], (c["cell"] + 1) << c["level"]) for c in row["c"])
            assert cells[0][0] == first and cells[-1][1] == stop
            assert all(x[1] == y[0] for x, y in zip(cells, cells[1:]))
            assert len(cells) <= 2 * (stop - first).bit_length()


@pytest.mark.parametrize("width", [None, 1, 64])
def test_overlap_join_with_lengths_of_all_scales(spark, width):
    r = random.Random(9)

    def spans(n):
        made = []
        for k in range(n):
            size = int(2 ** r.uniform(0, 40)) if r.random() < 0.1 else r.choice([0, 1, 1, 50, 1000])
            at = r.randint(-(10**6), 10**6)
            made.append((k, at, at + size))
        return made

    left, right = spans(250), spans(180)
    a = spark.createDataFrame(left, "i bigint, a bigint, b bigint")
    b = spark.createDataFrame(right, "j bigint, c bigint, d bigint")
    want = sorted((i, j) for i, x, y in left for j, u, v in right if x < y and u < v and x < v and u < y)
    got = sorted((t.i, t.j) for t in overlap_join(a, b, ("a", "b"), ("c", "d"), width).collect())
    assert got == want and len(want) == len(set(want))


def test_one_long_interval_among_many(spark, monkeypatch):
    """One range of a billion mean lengths among 100,000: its rows follow the digits of its length."""
    n = 100_000
    short = spark.range(n).select(F.col("id").alias("i"), (F.col("id") * 100).alias("a"), (F.col("id") * 100 + 80).alias("b"))
    short = short.unionByName(spark.createDataFrame([(n, 3, 3 + 80 * 10**9)], "i bigint, a bigint, b bigint"))
    asked = spark.createDataFrame([(0, 500, 700), (1, 99 * 100, 99 * 100 + 1), (2, 10**10, 10**10 + 5), (3, 5 * 10**6, 5 * 10**6 + 10**4)], "j bigint, c bigint, d bigint")
    made = []
    plain = skew.spread_join

    def counted(big, small, *args, **kw):
        made.append((big.count(), small.count()))
        return plain(big, small, *args, **kw)

    monkeypatch.setattr(skew, "spread_join", counted)
    got = sorted((t.j, t.i) for t in overlap_join(short, asked, ("a", "b"), ("c", "d")).collect())
    spans = [(k, 100 * k, 100 * k + 80) for k in range(n)] + [(n, 3, 3 + 80 * 10**9)]
    want = sorted((j, i) for j, c, d in ((0, 500, 700), (1, 9900, 9901), (2, 10**10, 10**10 + 5), (3, 5 * 10**6, 5 * 10**6 + 10**4)) for i, a, b in spans if a < d and c < b)
    assert got == want
    (big, small), = made
    assert big <= 16 * n and small <= 4 * 100
