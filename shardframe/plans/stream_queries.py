"""Streams over the ``events`` file, a bounded number of files per micro-batch. Open windows count as they stand."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardframe import streaming
from shardframe.plans.registry import query, table
from shardframe.session import new_shared_path, store
from shardframe.sources import files

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Files of a micro-batch.
MAX_FILES = 64
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# Micro-batches of the shuffled arrival.
ARRIVALS = 6
# Rows of a file of them, about.
ARRIVAL_ROWS = 1_000_000


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", MAX_FILES).parquet(sf)


def text_of(column):
    """A window start as text in the session's zone, which is also the zone of the cast to a timestamp."""
    return F.date_format(column, "yyyy-MM-dd HH:mm")


@query(
    "t1_stream_rate",
    """WITH e AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS w FROM events)
    SELECT event_type AS run_id, strftime(w, '%Y-%m-%d %H:%M') AS start, sum(user_id)::BIGINT AS total, round(sum(user_id) / 3600, 6) AS rate
    FROM e GROUP BY 1, w""",
)
def t1(spark, sf):
    events = event_stream(spark, sf).select(F.col("event_type").alias("run_id"), "ts", F.col("user_id").alias("n"))
    rates = streaming.latest(streaming.run_available(streaming.stream_rate(events, "1 hour"), "rate", "update"), ["run_id", "start", "end"])
    return rates.select("run_id", text_of("start").alias("start"), "total", F.round("rate", 6).alias("rate"))


@query(
    "t1_sliding_rate",
    """WITH s AS (SELECT unnest(range(2)) AS k), e AS (SELECT events.*, time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR * k AS w FROM events, s)
    SELECT event_type AS run_id, strftime(w, '%Y-%m-%d %H:%M') AS start, sum(user_id)::BIGINT AS total
    FROM e GROUP BY 1, w""",
)
def t1_sliding(spark, sf):
    events = event_stream(spark, sf).select(F.col("event_type").alias("run_id"), "ts", F.col("user_id").alias("n"))
    rates = streaming.latest(streaming.run_available(streaming.stream_rate(events, "12 hours", "6 hours"), "sliding", "update"), ["run_id", "start", "end"])
    return rates.select("run_id", text_of("start").alias("start"), "total")


@query(
    "t2_stream_miss_rate",
    """WITH e AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS w, CASE WHEN event_type <> 'view' THEN value > 20 END AS hit FROM events)
    SELECT 'u' || (user_id % 5) AS run_id, strftime(w, '%Y-%m-%d %H:%M') AS start, count(*) FILTER (NOT hit) AS misses, count(hit) AS accesses,
      round(CASE WHEN count(hit) > 0 THEN count(*) FILTER (NOT hit) / count(hit) END, 6) AS miss_rate
    FROM e GROUP BY 1, w""",
)
def t2(spark, sf):
    accesses = event_stream(spark, sf).select(
        F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("run_id"),
        "ts",
        F.when(F.col("event_type") != "view", F.col("value") > 20).alias("hit"),
    )
    rates = streaming.latest(streaming.run_available(streaming.stream_miss_rate(accesses, "1 hour"), "miss", "update"), ["run_id", "start"])
    return rates.select("run_id", text_of("start").alias("start"), "misses", "accesses", F.round("miss_rate", 6).alias("miss_rate"))


@query("t3_stream_latest_step", "SELECT user_id AS job, arg_max(event_id, (ts, event_id)) AS step FROM events GROUP BY user_id")
def t3(spark, sf):
    steps = event_stream(spark, sf).select(F.col("user_id").alias("job"), "ts", F.col("event_id").alias("step"))
    updates = streaming.run_available(streaming.stream_latest_step(steps), "step", mode="update")
    return updates.groupBy("job").agg(F.max_by("step", "batch").alias("step"))


# Signups finish a stage and views start one; of repeated finishes the first counts. Markers of the last hour wait for the watermark.
T4_SQL = """WITH m AS (SELECT * FROM events WHERE event_type IN ('signup', 'view')),
    e AS (SELECT user_id, event_id, ts, event_type = 'view' AS started FROM m WHERE ts <= (SELECT max(ts) - INTERVAL 1 HOUR FROM m)),
    c AS (SELECT *, coalesce(sum(started::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM e),
    gaps AS (SELECT user_id, g, min(ts) FILTER (NOT started) AS f, min(ts) FILTER (started) AS s FROM c GROUP BY 1, 2)
    SELECT 'u' || user_id AS run_id, strftime(f, '%Y-%m-%d %H:%M') AS finished, round((epoch_us(s) - epoch_us(f)) / 1000000, 3) AS gap
    FROM gaps WHERE f IS NOT NULL AND s IS NOT NULL"""


@query("t4_stream_marker_latency", T4_SQL)
def t4(spark, sf):
    gaps = marker_gaps(spark, sf, "365 days", event_stream(spark, sf))
    return gaps.select("run_id", text_of("finished").alias("finished"), F.round("gap", 3).alias("gap"))


# The events in files by the hour of their arrival, up to 59 minutes after they happened; a micro-batch is one part, with its rows shuffled.
@query("t4_shuffled_arrival", T4_SQL)
def t4_shuffled(spark, sf):
    out = new_shared_path(spark, "arrivals")
    events = table(spark, sf, "events").filter(F.col("event_type").isin("signup", "view"))
    late = F.make_dt_interval(mins=F.pmod(F.xxhash64("event_id"), F.lit(60)).cast("int"))
    arrived = store(events.withColumn("arrived", F.date_trunc("hour", F.col("ts") + late)), "arrivals")
    bounds = arrived.agg(F.min("arrived").alias("lo"), F.max("arrived").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    cuts = [bounds.lo + (bounds.hi - bounds.lo) * k / ARRIVALS for k in range(ARRIVALS)] + [None]
    # Files are read in the order of their age, so the parts are written one after the other. Each is as many files as a micro-batch takes, and each file a task.
    each = -(-bounds.n // (ARRIVALS * ARRIVAL_ROWS)) or 1
    for k, (a, b) in enumerate(zip(cuts, cuts[1:]), 1):
        part = arrived.filter((F.col("arrived") >= a) & (F.lit(True) if b is None else F.col("arrived") < b)).drop("arrived")
        part.withColumn("_r", F.xxhash64("event_id")).repartition(each, "_r").sortWithinPartitions("_r").drop("_r").write.mode("append").parquet(out)
        # A partition without rows is no file.
        lacking = k * each - files.list_files(spark, out).count()
        for _ in range(lacking):
            spark.createDataFrame([], events.schema).coalesce(1).write.mode("append").parquet(out)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", each).parquet(out)
    gaps = marker_gaps(spark, sf, "365 days", stream)
    return gaps.select("run_id", text_of("finished").alias("finished"), F.round("gap", 3).alias("gap"))


def marker_gaps(spark, sf, timeout, stream):
    events = stream.filter(F.col("event_type").isin("signup", "view")).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run_id"), "ts", (F.col("event_type") == "view").alias("started")
    )
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return streaming.run_available(streaming.stream_marker_latency(events, timeout=timeout), "gaps")
    finally:
        spark.conf.set(PROVIDER, before)


# Walks each user's markers in time order: open holds the first finish that no start has closed within 12 hours.
@query(
    "t4_open_gaps",
    """WITH RECURSIVE e AS (
      SELECT user_id, epoch_us(ts) AS t, event_type = 'view' AS started,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type = 'view') AS k
      FROM events WHERE event_type IN ('signup', 'view')
        AND ts <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events WHERE event_type IN ('signup', 'view'))),
    walk AS (
      SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS open, NULL::BIGINT AS f, NULL::BIGINT AS s FROM (SELECT DISTINCT user_id FROM e)
      UNION ALL
      SELECT w.user_id, e.k,
             CASE WHEN w.open IS NULL OR e.t - w.open > 43200000000 THEN CASE WHEN e.started THEN NULL ELSE e.t END
                  WHEN e.started AND e.t > w.open THEN NULL ELSE w.open END,
             CASE WHEN w.open IS NOT NULL AND (e.t - w.open > 43200000000 OR (e.started AND e.t > w.open)) THEN w.open END,
             CASE WHEN w.open IS NOT NULL AND e.t - w.open <= 43200000000 AND e.started AND e.t > w.open THEN e.t END
      FROM walk w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1),
    tail AS (
      SELECT user_id, arg_max(coalesce(open, -1), k) AS open FROM walk GROUP BY user_id)
    SELECT 'u' || user_id AS run_id, strftime(make_timestamp(f), '%Y-%m-%d %H:%M') AS finished, round((s - f) / 1000000, 3) AS gap FROM walk WHERE f IS NOT NULL
    UNION ALL
    SELECT 'u' || user_id, strftime(make_timestamp(open), '%Y-%m-%d %H:%M'), NULL FROM tail
    WHERE open >= 0 AND open // 1000 + 43200000 <= (SELECT epoch_us(max(ts)) FROM events WHERE event_type IN ('signup', 'view')) // 1000 - 3600000""",
)
def t4_open(spark, sf):
    """Gaps under a timeout of 12 hours, which many of them exceed."""
    gaps = marker_gaps(spark, sf, "12 hours", event_stream(spark, sf))
    return gaps.select("run_id", text_of("finished").alias("finished"), F.round("gap", 3).alias("gap"))
