"""JSON sets that describe configurations: structures, rank maps, model keys, schedules, degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardframe.operators.structure import flatten_structure
from shardframe.sources.files import read_texts

# The published folder and file layout.
CONFIG = r"(pp\d+/mp\d+/dp\d+)/"
RANK_FILE = r"pp\d+/mp\d+/dp\d+/rank(\d+)/mp_rank_\d+(?:_\d+)?\.json$"


def _texts(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One row per small JSON file with a name."""
    return read_texts(spark, root, rf"/{name}$").withColumnRenamed("text", "json")


def _degree(name: str) -> Column:
    return F.regexp_extract("config_id", rf"{name}(\d+)", 1).try_cast("bigint")


def read_structures(spark: SparkSession, root: str) -> DataFrame:
    """Structure rows of every rank file; ranks without a file have no rows."""
    docs = _texts(spark, root, r"mp_rank_[^/]*\.json").select(
        F.regexp_extract("file", CONFIG, 1).alias("config_id"),
        F.regexp_extract("file", RANK_FILE, 1).try_cast("bigint").alias("rank"),
        "json",
    )
    return flatten_structure(docs.filter(F.col("rank").isNotNull()))


def config_degrees(df: DataFrame) -> DataFrame:
    """Add the degrees that ``config_id`` names."""
    return df.withColumns({"pp_size": _degree("pp"), "mp_size": _degree("mp"), "dp_size": _degree("dp")})


def read_rank_map(spark: SparkSession, root: str) -> DataFrame:
    """``(config_id, rank, pp, mp, dp)`` of every ``rank_map.json``."""
    kind = "map<string, struct<pp_rank: bigint, mp_rank: bigint, dp_rank: bigint>>"
    rows = _texts(spark, root, r"rank_map\.json").select(
        F.regexp_extract("file", CONFIG, 1).alias("config_id"), F.explode(F.from_json("json", kind)).alias("rank", "r")
    )
    return rows.select(
        "config_id", F.col("rank").try_cast("bigint").alias("rank"), F.col("r.pp_rank").alias("pp"),
        F.col("r.mp_rank").alias("mp"), F.col("r.dp_rank").alias("dp"),
    )


def read_model_keys(spark: SparkSession, root: str) -> DataFrame:
    """``(config_id, rank, key_ord, path, parts)`` of every ``model_keys.json``, in file order."""
    rows = _texts(spark, root, r"model_keys\.json").select(
        F.regexp_extract("file", CONFIG, 1).alias("config_id"),
        F.explode(F.from_json("json", "map<string, array<array<string>>>")).alias("rank", "keys"),
    )
    keys = rows.select("config_id", F.col("rank").try_cast("bigint").alias("rank"), F.posexplode("keys").alias("key_ord", "parts"))
    return keys.select(
        "config_id", "rank", F.col("key_ord").cast("bigint").alias("key_ord"), F.array_join("parts", "/").alias("path"), "parts"
    )


def read_schedule(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(job, point, step, time, size)`` of schedule files: a JSON list of points; job is the file name."""
    texts = read_texts(spark, paths).select(F.regexp_extract("file", r"([^/]+)\.json$", 1).alias("job"), F.col("text").alias("value"))
    kind = "array<struct<step: bigint, time: bigint, size: bigint>>"
    rows = texts.select("job", F.posexplode(F.from_json("value", kind)).alias("point", "p"))
    return rows.select("job", F.col("point").cast("bigint").alias("point"), "p.step", "p.time", "p.size")


def read_para_configs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(job, size, mp, dp, pp)`` of degree files: a JSON map from size to degrees."""
    texts = read_texts(spark, paths).select(F.regexp_extract("file", r"([^/]+)\.json$", 1).alias("job"), F.col("text").alias("value"))
    kind = "map<string, struct<mp_size: bigint, dp_size: bigint, pp_size: bigint>>"
    rows = texts.select("job", F.explode(F.from_json("value", kind)).alias("size", "d"))
    return rows.select(
        "job", F.col("size").try_cast("bigint").alias("size"),
        *[F.col(f"d.{d}_size").alias(d) for d in ("mp", "dp", "pp")],
    )
