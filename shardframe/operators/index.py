"""Operators on byte-range indexes: ``(file_ord, path, range_ord, begin, end)``, all ends exclusive."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from shardframe.functions.numbers import ceil_div
from shardframe.functions.paths import uri_base, uri_host, uri_path, uri_rest, uri_scheme
from shardframe.operators.ordinal import depth_pieces, following, running
from shardframe.operators.skew import overlap_join, spread_join
from shardframe.session import store

# Ranges of one file that share a join key; a longer file uses several keys.
BLOCK = 65536
# Bits of one of Spark's bitmaps.
BITMAP_BITS = 32768


def join_files(ranges: DataFrame, files: DataFrame, n_col: str, drop_n: bool = True) -> DataFrame:
    """Attach per-file columns to ranges on ``(file_ord, range_ord div BLOCK)``, so no file is a hot key."""
    blocks = files.withColumn("_block", F.explode(F.expr(f"sequence(0L, ({n_col} - 1) div {BLOCK}L)")))
    keyed = ranges.withColumn("_block", F.expr(f"range_ord div {BLOCK}L"))
    joined = keyed.join(blocks, ["file_ord", "_block"]).drop("_block")
    return joined.drop(n_col) if drop_n else joined


def file_counts(idx: DataFrame) -> DataFrame:
    """Range count per file."""
    return idx.groupBy("file_ord").agg(F.count(F.lit(1)).alias("n_ranges"))


def named_ranges(idx: DataFrame) -> DataFrame:
    """Add the global ``sample_id``: files in order, ranges of a file in order."""
    offsets = running(file_counts(idx), ["file_ord"], sums={"first_id": F.col("n_ranges")}, position="_f").drop("_f")
    joined = join_files(idx, offsets, "n_ranges")
    return joined.select(*idx.columns, (F.col("first_id") + F.col("range_ord")).alias("sample_id"))


def select_ranges(ranges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranges of ``ids(position, sample_id)``, position kept, repeats kept, and the ids that have none."""
    known = ranges.withColumn("_known", F.lit(True))
    joined = spread_join(ids, known, ["sample_id"], ["position"], "left")
    found = joined.filter("_known").drop("_known")
    return found, joined.filter("_known IS NULL").select(*ids.columns, F.lit("unknown sample").alias("reason"))


def index_stats(idx: DataFrame) -> DataFrame:
    """Range count and indexed bytes per file and in total (``path`` null)."""
    per_file = idx.groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("begin")).alias("b")
    )
    # The rollup multiplies rows, so it runs on the per-file sums.
    return per_file.rollup("path").agg(F.sum("n").alias("n_ranges"), F.sum("b").alias("indexed_bytes"))


def take_files(idx: DataFrame, n: int) -> DataFrame:
    """Ranges of the first ``n`` files."""
    return idx.filter(F.col("file_ord") < n)


def set_host(idx: DataFrame, host: str) -> DataFrame:
    """Replace the host of every path; an empty host also removes the scheme."""
    tail = F.concat(uri_path("path"), uri_rest("path"))
    if not host:
        return idx.withColumn("path", tail)
    scheme = uri_scheme("path")
    lead = F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit(""))
    return idx.withColumn("path", F.concat(lead, F.lit(f"//{host}"), tail))


def rebase_paths(idx: DataFrame, old: str, new: str) -> DataFrame:
    """Replace the first occurrence of ``old`` in every path."""
    at = F.instr("path", old)
    swapped = F.concat(
        F.substring(F.col("path"), F.lit(1), at - 1), F.lit(new), F.substring(F.col("path"), at + len(old), F.length("path"))
    )
    return idx.withColumn("path", F.when(at > 0, swapped).otherwise(F.col("path")))


def localize_index(idx: DataFrame, host: str) -> tuple[DataFrame, DataFrame]:
    """Local paths as ``http://host/path``; entries with another scheme go to the violations table."""
    local = uri_scheme("path").isin("", "file")
    plain = F.regexp_replace(uri_path("path"), r"^file:(//)?", "")
    served = idx.filter(local).withColumn("path", F.concat(F.lit(f"http://{host}"), plain))
    bad = idx.filter(~local).groupBy("path").agg(F.count(F.lit(1)).alias("n_ranges"))
    return served, bad.withColumn("reason", F.lit("non-local file"))


def check_index(idx: DataFrame, files: DataFrame, index_uri: str = "") -> DataFrame:
    """Compare indexed bytes with ``files(path, size)``; one row per path on either side."""
    indexed = idx.groupBy("path").agg(F.sum(F.col("end") - F.col("begin")).alias("indexed_bytes"))
    joined = indexed.join(files.select("path", "size"), "path", "full_outer")
    status = (
        F.when(F.col("size").isNull(), "missing file")
        .when(F.col("indexed_bytes").isNull(), "not indexed")
        .when(F.col("size") < 0, "no size")
        .when(F.col("size") != F.col("indexed_bytes"), "size mismatch")
        .otherwise("ok")
    )
    same = uri_host("path") == uri_host(F.lit(index_uri))
    return joined.select("path", "indexed_bytes", "size", status.alias("status"), same.alias("same_domain"))


def logical_ranges(idx: DataFrame, order: tuple[str, ...] = ("file_ord", "range_ord")) -> DataFrame:
    """Add ``start`` and ``stop``: the place of each range in the concatenation of all ranges."""
    placed = running(idx, list(order), sums={"start": F.col("end") - F.col("begin")}, position="_p").drop("_p")
    return placed.withColumn("stop", F.col("start") + F.col("end") - F.col("begin"))


def locate(placed: DataFrame, requests: DataFrame, width: int | None = None) -> DataFrame:
    """Physical segments of logical windows ``requests(request, pos, length)``.

    ``placed`` comes from :func:`logical_ranges`. Windows past the end give what exists. ``width`` is the
    bucket width in bytes; without one it follows the mean lengths of windows and ranges.
    """
    wanted = requests.select("request", "pos", (F.col("pos") + F.col("length")).alias("until"))
    pairs = overlap_join(wanted, placed, ("pos", "until"), ("start", "stop"), width, spread_by=["request"])
    lo = F.greatest("pos", "start") - F.col("start")
    hi = F.least("until", "stop") - F.col("start")
    return pairs.select(
        "request",
        (F.col("start") + lo).alias("at"),
        "path",
        (F.col("begin") + lo).alias("begin"),
        (F.col("begin") + hi).alias("end"),
    )


def region_map(idx: DataFrame) -> DataFrame:
    """Sample id to ``(file_ord, region)``."""
    return named_ranges(idx).select("sample_id", "file_ord", F.col("range_ord").alias("region"))


def region_totals(idx: DataFrame) -> DataFrame:
    """One row: file count, most regions in a file, regions in all."""
    return file_counts(idx).agg(
        F.count(F.lit(1)).alias("n_files"), F.max("n_ranges").alias("max_regions"), F.sum("n_ranges").alias("total_regions")
    )


def region_coverage(regions: DataFrame, ids: DataFrame) -> DataFrame:
    """Per file: regions in all and regions named by ``ids(sample_id)`` (repeats count once)."""
    hit = ids.select("sample_id").distinct().withColumn("_hit", F.lit(1))
    return (
        regions.join(hit, "sample_id", "left")
        .groupBy("file_ord")
        .agg(F.count(F.lit(1)).alias("regions"), F.count("_hit").alias("covered"))
    )


def region_bitmaps(placed: DataFrame, sets: Sequence[str]) -> DataFrame:
    """Which regions of each file the id sets name: ``(*sets, file_ord, bucket, bitmap)``.

    ``placed(*sets, file_ord, region)`` has a row for each id, repeats allowed. A bitmap holds 32,768 regions in 4 KB, and bitmaps are built before the
    shuffle, so what moves follows the sets and files and not the ids.
    """
    # Bits count from 1.
    at = F.col("region") + 1
    return placed.groupBy(*sets, "file_ord", F.bitmap_bucket_number(at).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap")
    )


def merge_bitmaps(bitmaps: DataFrame, sets: Sequence[str]) -> DataFrame:
    """Bitmaps of coarser sets, as all stages of a job or all of its ranks, from those of finer ones; no id moves again."""
    return bitmaps.groupBy(*sets, "file_ord", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def bitmap_coverage(bitmaps: DataFrame, files: DataFrame, sets: Sequence[str]) -> DataFrame:
    """Per set and file that it names a region of: regions in all, from ``files(file_ord, n_ranges)``, and regions covered."""
    counted = bitmaps.groupBy(*sets, "file_ord").agg(F.sum(F.bitmap_count("bitmap")).alias("covered"))
    return counted.join(files.select("file_ord", F.col("n_ranges").alias("regions")), "file_ord").select(*sets, "file_ord", "regions", "covered")


def bitmap_regions(bitmaps: DataFrame) -> DataFrame:
    """The regions of bitmaps as rows ``(…, file_ord, region)``."""
    keep = [f for f in bitmaps.schema.fields if f.name not in ("bucket", "bitmap")]
    names = [f.name for f in keep]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (bucket, bits) in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("bitmap").to_pylist())):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
                rows = batch.select(names).take(pa.array(np.full(len(at), k)))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array((bucket - 1) * BITMAP_BITS + at, pa.int64())], names=[*names, "region"])

    return bitmaps.mapInArrow(unpack, StructType([*keep, StructField("region", LongType())]))


def span_coverage(placed: DataFrame, spans: DataFrame, files: DataFrame, sets: Sequence[str], part: str) -> DataFrame:
    """:func:`bitmap_coverage` of the regions that spans of an order name: ``(*sets, file_ord, regions, covered)``.

    ``placed(position, file_ord, region)`` tells what lies at a position, ``spans(*sets, part, lo, hi)`` which positions a part of a set reads. A region at one
    position, as in any order without repeats, is counted by running counts of its file at the ends of what the set's parts cover together: work
    follows the ends and files, not the positions inside. Regions at several positions, which these counts would count twice, go into bitmaps.
    """
    placed, spans = store(placed.select("position", "file_ord", "region"), "placed"), store(spans.select(*sets, part, "lo", "hi"), "spans")
    often = placed.groupBy("file_ord", "region").agg(F.count(F.lit(1)).alias("_n"), F.min("position").alias("position"))
    often = store(often, "regions")
    once = often.filter("_n = 1").select("file_ord", "position")
    one = F.lit(1).cast("bigint")
    changes = spans.filter("lo < hi").select(
        *sets, F.explode(F.array(F.struct(F.col("lo").alias("at"), one.alias("step")), F.struct(F.col("hi").alias("at"), (-one).alias("step")))).alias("c")
    ).select(*sets, "c.at", "c.step")
    # Ends of parts that touch or overlap are none of what they cover together.
    edges = depth_pieces(changes, sets).filter("times > 0").select(
        *sets, F.explode(F.array(F.struct(F.col("lo").alias("position"), (-one).alias("sign")), F.struct(F.col("hi").alias("position"), one.alias("sign")))).alias("e")
    ).groupBy(*sets, "e.position").agg(F.sum("e.sign").alias("sign")).filter("sign <> 0")
    edges = store(edges, "edges")
    counted = store(once.groupBy("file_ord").agg(F.count(F.lit(1)).alias("_all")), "counted")
    ends = edges.select("position").distinct().crossJoin(counted.select("file_ord"))
    before = running(once, ["position"], ["file_ord"], position="count")
    found = following(ends, before, ["file_ord"], "position", ["count"]).join(counted, "file_ord")
    counts = store(found.select("position", "file_ord", F.coalesce("next_count", "_all").alias("count")).filter("count > 0"), "counts")
    met = spread_join(edges, counts, ["position"], list(sets))
    single = met.groupBy(*sets, "file_ord").agg(F.sum(F.col("sign") * F.col("count")).alias("covered")).filter("covered > 0")
    single = single.join(files.select("file_ord", F.col("n_ranges").alias("regions")), "file_ord").select(*sets, "file_ord", "regions", "covered")
    repeated = often.filter("_n > 1").select("file_ord", "region")
    if repeated.isEmpty():
        return single
    again = placed.join(repeated, ["file_ord", "region"]).withColumn("_next", F.col("position") + 1)
    maps = region_bitmaps(overlap_join(again, spans, ("position", "_next"), ("lo", "hi"), spread_by=["position"]), [*sets, part])
    several = bitmap_coverage(merge_bitmaps(maps, sets), files, sets)
    return single.unionByName(several).groupBy(*sets, "file_ord", "regions").agg(F.sum("covered").alias("covered"))


def index_shard(ranges: DataFrame, shard: int, n_shards: int) -> DataFrame:
    """Contiguous part ``shard`` of ``n_shards`` of a whole index from :func:`named_ranges`."""
    size = ranges.agg(ceil_div(F.count(F.lit(1)), n_shards)).scalar()
    return ranges.filter((F.col("sample_id") >= shard * size) & (F.col("sample_id") < (shard + 1) * size))


def lookup_samples(files: DataFrame, ids: DataFrame, per_file: int) -> tuple[DataFrame, DataFrame]:
    """Place and size of ``ids(position, sample_id)`` in files that hold ``per_file`` samples each; ids without one.

    ``files`` is an index with ``(file_ord, path, range_ord, begin, end)``.
    """
    wanted = ids.select(
        "position",
        "sample_id",
        F.expr(f"sample_id div {per_file}L").alias("file_ord"),
        F.expr(f"sample_id % {per_file}L").alias("range_ord"),
    )
    joined = spread_join(wanted, files.withColumn("_known", F.lit(True)), ["file_ord", "range_ord"], ["position"], "left")
    found = joined.filter("_known").select(
        "position", "sample_id", "file_ord", "range_ord", "path", "begin", (F.col("end") - F.col("begin")).alias("size")
    )
    return found, joined.filter("_known IS NULL").select("position", "sample_id", F.lit("unknown sample").alias("reason"))


def verify_md5(manifest: DataFrame, expected: DataFrame) -> DataFrame:
    """Compare two ``(path, md5)`` tables: ok, mismatch, missing (expected only), unexpected."""
    a = manifest.select("path", F.col("md5").alias("actual"))
    b = expected.select("path", F.col("md5").alias("expected"))
    status = (
        F.when(F.col("actual").isNull(), "missing")
        .when(F.col("expected").isNull(), "unexpected")
        .when(F.col("actual") == F.col("expected"), "ok")
        .otherwise("mismatch")
    )
    return a.join(b, "path", "full_outer").select("path", "actual", "expected", status.alias("status"))
