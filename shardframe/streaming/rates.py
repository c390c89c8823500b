"""Windowed rates and latest steps. Every function takes and returns a DataFrame, streaming or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from shardframe.session import new_shared_path

WATERMARK = "1 hour"


def _windowed(events: DataFrame, interval: str, slide: str | None, watermark: str) -> tuple[DataFrame, Column]:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    span = F.window("ts", interval, slide) if slide else F.window("ts", interval)
    return (timed.withWatermark("ts", watermark) if timed.isStreaming else timed), span


def stream_rate(events: DataFrame, interval: str = "1 second", slide: str | None = None, watermark: str = WATERMARK) -> DataFrame:
    """Throughput of ``events(run_id, ts, n)`` per window; windows without events are not emitted."""
    timed, span = _windowed(events, interval, slide, watermark)
    sums = timed.groupBy(span.alias("window"), "run_id").agg(F.sum("n").alias("total"))
    seconds = F.unix_micros("window.end") - F.unix_micros("window.start")
    return sums.select(
        "run_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "total",
        (F.col("total") * 1000000 / seconds).alias("rate"),
    )


def stream_miss_rate(accesses: DataFrame, interval: str, slide: str | None = None, watermark: str = WATERMARK) -> DataFrame:
    """Share of misses of ``accesses(run_id, ts, hit)`` per window, null where ``hit`` is always null."""
    timed, span = _windowed(accesses, interval, slide, watermark)
    counts = timed.groupBy(span.alias("window"), "run_id").agg(
        F.count(F.when(~F.col("hit"), 1)).alias("misses"), F.count("hit").alias("accesses")
    )
    rate = F.when(F.col("accesses") > 0, F.col("misses") / F.col("accesses"))
    return counts.select("run_id", F.col("window.start").alias("start"), "misses", "accesses", rate.alias("miss_rate"))


def stream_latest_step(steps: DataFrame) -> DataFrame:
    """Latest step of ``steps(job, ts, step)`` by time, then step; older rows that come late change nothing.

    One state row per job. Run it in update mode.
    """
    return steps.groupBy("job").agg(F.max(F.struct("ts", "step")).alias("m")).select("job", "m.step", "m.ts")


def latest(versions: DataFrame, keys: list[str]) -> DataFrame:
    """The newest version of each row of :func:`run_available` in update mode, windows still open included."""
    rest = [c for c in versions.columns if c not in (*keys, "batch")]
    newest = versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_v"))
    return newest.select(*keys, *[F.col("_v")[c].alias(c) for c in rest])


def run_available(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming DataFrame over all data at hand into Parquet in the shared folder and read it back.

    Append mode writes a window once it is closed, so windows that are open at the end are missing. Update mode
    writes every version; the newest one of a row has the highest ``batch``, see :func:`latest`. How much a
    micro-batch takes is set where the stream is read (``maxFilesPerTrigger``).
    """
    spark: SparkSession = df.sparkSession
    out, state = new_shared_path(spark, name), new_shared_path(spark, f"{name}-state")
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(out)
        schema = df.schema
    else:
        # A batch that runs again overwrites its own folder, so each counts once.
        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        query = writer.foreachBatch(write).start()
        schema = StructType([*df.schema.fields, StructField("batch", LongType())])
    query.awaitTermination()
    return spark.read.schema(schema).parquet(out)
