from pyspark.sql import functions as F

from shardframe import functions as sf
from shardframe.functions.paths import ancestors, base_name, parent_path
from shardframe.plans import QUERIES


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_sizes(spark):
    assert one(spark, sf.show_size(F.lit(1023))) == "1023"
    assert one(spark, sf.show_size(F.lit(1024))) == "1.0KiB"
    assert one(spark, sf.show_size(F.lit(1280))) == "1.2KiB"  # ties go to even
    assert one(spark, sf.show_size(F.lit(1 << 41))) == "2.0Ti"
    assert one(spark, sf.show_rate(F.lit(1024.0))) == "1024.00 B/s"
    assert one(spark, sf.show_rate(F.lit(3.5 * 1024 * 1024))) == "3.50 MiB/s"
    assert one(spark, sf.show_bytes(F.lit(1 << 20))) == "1048576"
    assert one(spark, sf.show_bytes(F.lit(3 << 19))) == "1.500MiB"


def test_numbers(spark):
    assert one(spark, sf.floor_pow2(F.lit(33))) == 32
    assert one(spark, sf.floor_pow2(F.lit(0))) == 0
    assert one(spark, sf.floor_pow2(F.lit((1 << 62) + 5))) == 1 << 62
    assert one(spark, sf.ceil_div(F.lit(7), F.lit(4))) == 2
    assert one(spark, sf.percent(F.lit(1), F.lit(4))) == 25.0
    assert one(spark, sf.eta(F.lit(10.0), F.lit(0), F.lit(5))) is None
    assert one(spark, sf.eta(F.lit(10.0), F.lit(2), F.lit(6))) == 20.0


def test_paths(spark):
    assert one(spark, sf.trim_last_ext(F.lit("a/b/c.x.y.z"))) == "a/b/c.x.y"
    assert one(spark, sf.trim_last_ext(F.lit("a.b/.rc"))) == "a.b/.rc"
    assert one(spark, sf.append_path(F.lit("http://h:1/a/"), F.lit("/b/c"))) == "http://h:1/a/b/c"
    assert one(spark, sf.append_path(F.lit("/a"), F.lit("b"))) == "/a/b"
    assert one(spark, sf.rel_path(F.lit("https://h/a/b.rec"))) == "a/b.rec"
    assert one(spark, sf.path_parts(F.lit("//a//b/"))) == ["a", "b"]
    assert one(spark, parent_path(F.lit("/a/b"))) == "/a"
    assert one(spark, parent_path(F.lit("/"))) is None
    assert one(spark, base_name(F.lit("/a/b"))) == "b"
    assert one(spark, ancestors(F.lit("/a/b/c"))) == ["/", "/a", "/a/b"]
    assert one(spark, ancestors(F.lit("/"))) == []


def test_peers(spark, rows):
    assert one(spark, sf.ipv4_to_long(F.lit("1.2.3.4"))) == 16909060
    assert one(spark, sf.ipv4_to_long(F.lit("1.2.3.400"))) is None
    assert one(spark, sf.long_to_ipv4(F.lit(16909060))) == "1.2.3.4"
    df = spark.createDataFrame([("1.2.3.4:8080,1.2.3.4:8081,4.3.2.1:8080",), ("x:1,1.1.1.1:99999",)], "p string")
    good, bad = sf.parse_peers(df, "p")
    assert rows(good, "rank", "host", "port") == [(0, "1.2.3.4", 8080), (1, "1.2.3.4", 8081), (2, "4.3.2.1", 8080)]
    assert rows(bad, "rank", "entry") == [(0, "x:1"), (1, "1.1.1.1:99999")]


def test_sizes_beyond_a_bigint(spark, rows, tmp_path):
    """Large keys: their product has texts, and a number only where a bigint holds it."""
    keys = [(3_000_001, 59_999, 1), (20, 30, 2), (None, 3, 1)]
    spark.createDataFrame(keys, "l_partkey bigint, l_suppkey bigint, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = QUERIES["f1_show_size"].run(spark, str(tmp_path))
    assert dict(got.dtypes)["n"] == "bigint"
    wide = 3_000_001**2 * 60_000 * 1001
    assert wide > 1 << 63
    large = (None, f"{wide / 2**40:.1f}Ti", f"{wide / 2**30:.2f} GiB/s", f"{wide / 2**30:.3f}GiB")
    told = [r for r in rows(got, "n", "size", "rate", "bytes") if r[1] is not None]
    assert sorted(told, key=repr) == sorted([large, (24812400, "23.7MiB", "23.66 MiB/s", "23.663MiB")], key=repr)
    assert got.count() == 3
