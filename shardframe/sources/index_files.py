"""Text indexes of record files.

Layout: a count of files, then per file a line ``path n`` and ``n`` lines ``begin end``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardframe.operators.index import file_counts
from shardframe.operators.ordinal import neighbour, running
from shardframe.operators.skew import overlap_join
from shardframe.session import cut_lineage
from shardframe.sources.files import read_lines

_RANGE = r"^(\d+) (\d+)$"
_HEADER = r"^(.+) (\d+)$"


def _global_lines(lines: DataFrame) -> DataFrame:
    """Line numbers over all part files in name order; a row per part file is combined."""
    parts = lines.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return lines.join(bases, "path").select((F.col("line_no") + F.col("base")).alias("line"), "text")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(file_ord, path, range_ord, begin, end)`` of an index file, or of a folder of its parts in name
    order, and the violations: headers whose count does not fit, lines that are neither, a wrong total.
    """
    lines = cut_lineage(_global_lines(read_lines(spark, path)))
    body = lines.filter("line > 0").withColumn("_range", F.col("text").rlike(_RANGE))
    headers = body.filter(~F.col("_range") & F.col("text").rlike(_HEADER)).select(
        F.col("line").alias("_at"),
        F.regexp_extract("text", _HEADER, 1).alias("path"),
        F.regexp_extract("text", _HEADER, 2).try_cast("bigint").alias("n"),
    )
    placed = running(headers, ["_at"], position="file_ord")
    spans = placed.select(
        "file_ord", "path", "n", (F.col("_at") + 1).alias("_lo"), (F.col("_at") + 1 + F.col("n")).alias("_hi")
    )
    ranges = body.filter("_range").select(
        "line", (F.col("line") + 1).alias("_next"),
        F.regexp_extract("text", _RANGE, 1).try_cast("bigint").alias("begin"),
        F.regexp_extract("text", _RANGE, 2).try_cast("bigint").alias("end"),
    )
    owned = overlap_join(ranges, spans, ("line", "_next"), ("_lo", "_hi"), 65536, spread_by=["line"])
    index = owned.select(
        "file_ord", "path", (F.col("line") - F.col("_lo")).alias("range_ord"), "begin", "end"
    )
    counted = spans.join(file_counts(index), "file_ord", "left")
    short = counted.filter(F.coalesce("n_ranges", F.lit(0)) != F.col("n")).select(
        (F.col("_lo") - 1).alias("line"), F.lit("count does not fit").alias("reason")
    )
    odd = body.filter(~F.col("_range") & ~F.col("text").rlike(_HEADER)).select("line", F.lit("not an index line").alias("reason"))
    stray = ranges.join(owned.select("line"), "line", "left_anti").select("line", F.lit("range without a file").alias("reason"))
    n_files = placed.agg(F.count(F.lit(1))).scalar()
    total = lines.filter("line = 0").filter(
        F.coalesce(F.col("text").try_cast("bigint") != n_files, F.lit(True))
    ).select("line", F.lit("wrong number of files").alias("reason"))
    return index, short.unionByName(odd).unionByName(stray).unionByName(total)


def write_index(index: DataFrame, path: str) -> None:
    """Write an index as a folder of text parts in order."""
    files = index.groupBy("file_ord", "path").agg(F.count(F.lit(1)).alias("n"))
    top = files.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(-1).cast("bigint").alias("f"), F.lit(-1).cast("bigint").alias("r"), F.col("n").cast("string").alias("value")
    )
    heads = files.select(F.col("file_ord").alias("f"), F.lit(-1).cast("bigint").alias("r"), F.concat_ws(" ", "path", F.col("n")).alias("value"))
    rows = index.select(F.col("file_ord").alias("f"), F.col("range_ord").alias("r"), F.concat_ws(" ", "begin", "end").alias("value"))
    top.unionByName(heads).unionByName(rows).orderBy("f", "r").select("value").write.mode("overwrite").text(path)


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    """Flat ``begin end`` lines as ``(path, ord, begin, end)``."""
    lines = read_lines(spark, path).filter(F.col("text").rlike(_RANGE))
    return lines.select(
        "path", F.col("line_no").alias("ord"),
        F.regexp_extract("text", _RANGE, 1).try_cast("bigint").alias("begin"),
        F.regexp_extract("text", _RANGE, 2).try_cast("bigint").alias("end"),
    )


def offsets_to_ranges(offsets: DataFrame) -> DataFrame:
    """Single offsets ``(path, ord, offset)`` to ranges up to the next offset; the last one only closes."""
    nexts = neighbour(offsets, ["path"], "ord", {"end": "offset"}, 1)
    return nexts.filter(F.col("end").isNotNull()).select("path", "ord", F.col("offset").alias("begin"), "end")
