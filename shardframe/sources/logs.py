"""Training logs as lines and metric tables as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardframe.sources.files import READ_BLOCK, read_lines


def read_logs(spark: SparkSession, paths: str | list[str], block: int = READ_BLOCK) -> DataFrame:
    """``(run_id, file, line_no, text)``; the run is the folder of the file."""
    return read_lines(spark, paths, block).select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("run_id"),
        F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("file"),
        "line_no",
        "text",
    )


def write_metrics(df: DataFrame, path: str) -> None:
    """Write a metric table as CSV with a header."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read such a table back."""
    return spark.read.option("header", "true").schema(schema).csv(path)


def read_manifest(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(path, md5)`` of manifest lines ``md5 path``."""
    lines = read_lines(spark, paths).filter(F.col("text").rlike(r"^[0-9a-f]{32} +.+$"))
    return lines.select(
        F.regexp_extract("text", r"^[0-9a-f]{32} +(.+)$", 1).alias("path"), F.substring("text", 1, 32).alias("md5")
    )
