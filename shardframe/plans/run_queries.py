"""Log lines and metric series rendered from ``events``, ``orders`` and ``lineitem``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from shardframe.operators import placement, runs
from shardframe.operators.ordinal import running
from shardframe.plans.placement_queries import RING, failed, hosts, items
from shardframe.plans.registry import query, table

# Run = event type and user mod 8, file = run and user mod 3. Some lines are error texts.
RENDERED = """
WITH ev AS (
  SELECT *, event_type || '-' || (user_id % 8) AS run_id, event_type || '-' || (user_id % 8) || '-' || (user_id % 3) AS file,
    event_type = 'error' AND event_id % 40 = 0 AS failed, event_type = 'signup' AND event_id % 60 = 0 AS oom,
    event_type = 'view' AND user_id % 8 < 2 AND user_id % 3 < user_id % 8 + 1 AS quiet
  FROM events)
"""


def events(spark, sf):
    return table(spark, sf, "events")


def wall_time():
    """Epoch seconds of ``ts`` whatever the session time zone."""
    return F.expr(
        "(datediff(CAST(ts AS date), DATE'1970-01-01') * 86400000000L + hour(ts) * 3600000000L + minute(ts) * 60000000L"
        " + CAST(extract(SECOND FROM ts) * 1000000 AS bigint)) / 1000000D"
    )


def step_logs(spark, sf):
    run = F.concat("event_type", F.lit("-"), (F.col("user_id") % 8).cast("string"))
    failed_line = (F.col("event_type") == "error") & (F.col("event_id") % 40 == 0)
    oom = (F.col("event_type") == "signup") & (F.col("event_id") % 60 == 0)
    quiet = (F.col("event_type") == "view") & (F.col("user_id") % 8 < 2) & (F.col("user_id") % 3 < F.col("user_id") % 8 + 1)
    step = F.format_string(
        " iteration %d/ 999999 | elapsed time per iteration (ms): %.2f | global batch size: %d | lm loss: 1.0E+00 |",
        "event_id", F.col("value") * 1000, F.col("user_id") + 1,
    )
    text = (
        F.when(failed_line, "RuntimeError: lost peer")
        .when(oom, "CUDA out of memory. Tried to allocate")
        .when(quiet, "loading")
        .otherwise(step)
    )
    return events(spark, sf).select(
        run.alias("run_id"),
        F.concat(run, F.lit("-"), (F.col("user_id") % 3).cast("string")).alias("file"),
        F.col("event_id").alias("line_no"),
        text.alias("text"),
    )


@query(
    "l1_parse_kv_lines",
    RENDERED
    + """SELECT event_id AS line_no, printf('%.2f', value * 1000) AS ms, (user_id + 1)::VARCHAR AS batch, '1.0E+00' AS loss
    FROM ev WHERE NOT (failed OR oom OR quiet)""",
)
def l1(spark, sf):
    kv = runs.parse_kv_lines(step_logs(spark, sf)).filter(F.size("kv") > 0)
    if_present = kv.select(
        "line_no",
        F.col("kv")["elapsed time per iteration (ms)"].alias("ms"),
        F.col("kv")["global batch size"].alias("batch"),
        F.col("kv")["lm loss"].alias("loss"),
    )
    return if_present.filter(F.col("ms").isNotNull())


@query(
    "l2_step_times",
    RENDERED
    + """, f AS (SELECT run_id, file, bool_or(oom) AS oom, count(*) FILTER (NOT (failed OR oom OR quiet)) AS n,
        sum(round(value * 1000, 2)) FILTER (NOT (failed OR oom OR quiet)) AS total,
        arg_min(round(value * 1000, 2), event_id) FILTER (NOT (failed OR oom OR quiet)) AS first FROM ev GROUP BY 1, 2),
    s AS (SELECT *, CASE WHEN oom THEN 'OOM' WHEN n > 0 THEN 'ok' ELSE 'error' END AS status FROM f),
    b AS (SELECT run_id, min(file) FILTER (status <> 'error') AS file FROM s GROUP BY run_id)
    SELECT run_id, CASE WHEN status = 'ok' AND n > 1 THEN round((total - first) / (n - 1) / 1000, 1) END AS step_time,
      coalesce(status, 'error') AS status FROM b LEFT JOIN s USING (run_id, file)""",
)
def l2(spark, sf):
    return runs.step_times(step_logs(spark, sf))


@query(
    "l3_throughput",
    RENDERED
    + """SELECT run_id, round(CASE WHEN bool_or(failed) THEN 0.0 ELSE avg((user_id + 1) / round(value * 1000, 2) * 1000)
      FILTER (NOT (failed OR oom OR quiet)) END, 6)::DOUBLE AS throughput FROM ev GROUP BY run_id""",
)
def l3(spark, sf):
    return runs.throughput(step_logs(spark, sf)).withColumn("throughput", F.round("throughput", 6))


# Run names from orders: two naming schemes.
NAMES = """
WITH n AS (SELECT o_orderkey, 1 + o_custkey % 4 AS mp, 1 + o_orderkey % 3 AS dp, 1 + o_custkey % 2 AS pp,
             CASE WHEN o_orderstatus = 'F' THEN 'gpt' ELSE 'bert' END AS model FROM orders)
"""


def run_names(spark, sf):
    model = F.when(F.col("o_orderstatus") == "F", "gpt").otherwise("bert")
    mp, dp, pp = F.col("o_custkey") % 4 + 1, F.col("o_orderkey") % 3 + 1, F.col("o_custkey") % 2 + 1
    short = F.format_string("logs-%s-2.7B-128-8-mp%d-dp%d-pp%d", model, mp, dp, pp)
    long = F.format_string("logs-%s-xl-wiki-%d-%d-%d-128-8", model, mp * dp * pp, pp, mp)
    return table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, short).otherwise(long).alias("run_id")
    )


@query(
    "l4_parse_run_id",
    NAMES
    + """SELECT o_orderkey, mp, dp, pp, CASE WHEN odd THEN model END AS model, CASE WHEN odd THEN 'xl' END AS model_size,
      CASE WHEN odd THEN 'wiki' END AS dataset, CASE WHEN odd THEN mp * dp * pp END AS cluster_size,
      CASE WHEN odd THEN 128::BIGINT END AS batch_size, CASE WHEN odd THEN 8::BIGINT END AS micro_batch_size
    FROM (SELECT *, o_orderkey % 2 = 1 AS odd FROM n)""",
)
def l4(spark, sf):
    return runs.parse_run_id(run_names(spark, sf)).drop("run_id")


@query("l4_select_runs", NAMES + "SELECT o_orderkey, mp, dp, pp FROM n WHERE mp * dp * pp = 8 AND model = 'gpt'")
def l4_select(spark, sf):
    parsed = runs.parse_run_id(run_names(spark, sf))
    return runs.select_runs(parsed, "gpt", 8).select("o_orderkey", "mp", "dp", "pp")


SERIES = """WITH m AS (SELECT event_type AS run_id, 'k' || (json_extract(props, '$.k')::BIGINT % 7) AS tag,
  epoch_us(ts) / 1000000.0::DOUBLE AS wall_time, event_id AS step, value FROM events)
"""


def metrics(spark, sf):
    tag = F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("bigint") % 7).cast("string"))
    return events(spark, sf).select(
        F.col("event_type").alias("run_id"), tag.alias("tag"), wall_time().alias("wall_time"), F.col("event_id").alias("step"), "value"
    )


@query(
    "l5_merge_series",
    SERIES
    + """SELECT run_id, step, round(wall_time, 3) AS wall_time, value, row_number() OVER (ORDER BY wall_time, step) - 1 AS point
    FROM m""",
)
def l5(spark, sf):
    m = metrics(spark, sf)
    parts = [m.filter(F.col("run_id") == r) for r in ("click", "error", "purchase", "signup", "view")]
    merged = runs.merge_series(*parts)
    return merged.select("run_id", "step", F.round("wall_time", 3).alias("wall_time"), "value", "point")


@query(
    "l6_zero_time",
    SERIES + "SELECT run_id, step, round((wall_time - min(wall_time) OVER (PARTITION BY run_id)) / 60, 6) AS wall_time FROM m",
)
def l6(spark, sf):
    zeroed = runs.zero_time(metrics(spark, sf))
    return zeroed.select("run_id", "step", F.round("wall_time", 6).alias("wall_time"))


@query(
    "l6_zero_time_all",
    SERIES + "SELECT run_id, step, round((wall_time - min(wall_time) OVER ()) / 60, 6) AS wall_time FROM m",
)
def l6_all(spark, sf):
    zeroed = runs.zero_time(metrics(spark, sf), scope="all")
    return zeroed.select("run_id", "step", F.round("wall_time", 6).alias("wall_time"))


MINUTES = SERIES + ", z AS (SELECT *, (wall_time - min(wall_time) OVER (PARTITION BY run_id)) / 60 AS t FROM m)"


@query(
    "l7_add_pauses",
    MINUTES
    + """, d AS (SELECT *, floor(max(t) OVER (PARTITION BY run_id)) AS len FROM z)
    SELECT run_id, step, round(t + 35 * greatest(0, least(floor(t / 70), ceil(len / 70) - 1)), 6) AS wall_time FROM d""",
)
def l7(spark, sf):
    paused = runs.add_pauses(runs.zero_time(metrics(spark, sf)), 35)
    return paused.select("run_id", "step", F.round("wall_time", 6).alias("wall_time"))


# Points to find: every order's date plus its key in minutes, for one of the five runs.
@query(
    "l7_first_at_or_after",
    """WITH p AS (SELECT event_id AS step, event_id * 3 AS wall_time, CASE event_id % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'none' END AS run_id FROM events)
    SELECT p.run_id, p.step, p.wall_time, e.event_id * 2 AS next_wall_time, e.value AS next_value
    FROM p ASOF LEFT JOIN events e ON e.event_type = p.run_id AND p.wall_time <= e.event_id * 2""",
)
def l7_first(spark, sf):
    ev = events(spark, sf)
    run = F.when(F.col("event_id") % 3 == 0, "click").when(F.col("event_id") % 3 == 1, "view").otherwise("none")
    points = ev.select(run.alias("run_id"), F.col("event_id").alias("step"), (F.col("event_id") * 3).alias("wall_time"))
    series = ev.select(F.col("event_type").alias("run_id"), (F.col("event_id") * 2).alias("wall_time"), "value")
    return runs.first_at_or_after(points, series, ["value"])


@query(
    "l8_cut_to_common_step",
    """WITH m AS (SELECT user_id AS run_id, event_id AS step, value FROM events)
    SELECT run_id, step, value FROM m WHERE step <= (SELECT min(s) FROM (SELECT max(step) AS s FROM m GROUP BY run_id))""",
)
def l8(spark, sf):
    series = events(spark, sf).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), "value")
    return runs.cut_to_common_step(series)


@query(
    "l8_final_points",
    SERIES + "SELECT run_id, max(step) AS final_step, round(arg_max(wall_time, step), 3) AS final_time FROM m GROUP BY run_id",
)
def l8_final(spark, sf):
    return runs.final_points(metrics(spark, sf)).withColumn("final_time", F.round("final_time", 3))


def smooth_sql(window: int, order: int) -> str:
    """Smoothing as weighted sums; the weights come from the same least-squares rule."""
    half = window // 2

    def rows(kind: str, at: float, k: int) -> list[str]:
        x = np.vander(np.arange(window) - at, order + 1, increasing=True)
        return [f"('{kind}',{k},{j},{w!r}::DOUBLE)" for j, w in enumerate(map(float, np.linalg.pinv(x)[0]))]

    weights = rows("mid", (window - 1) / 2, 0)
    for k in range(half):
        weights += rows("head", k, k) + rows("tail", window - half + k, k)
    return f"""WITH w(kind, k, j, c) AS (VALUES {','.join(weights)}),
    s AS (SELECT event_type AS run_id, event_id AS step, ln(1 + value) AS value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i,
                 count(*) OVER (PARTITION BY event_type) AS n FROM events),
    p AS (SELECT *, CASE WHEN i < {half} THEN 'head' WHEN i >= n - {half} THEN 'tail' ELSE 'mid' END AS kind,
            CASE WHEN i < {half} THEN i WHEN i >= n - {half} THEN i - n + {half} ELSE 0 END AS k,
            CASE WHEN i < {half} THEN 0 WHEN i >= n - {half} THEN n - {window} ELSE i - {window - 1 - half} END AS lo FROM s)
    SELECT p.run_id, p.step, round(sum(w.c * s.value), 6) AS smoothed
    FROM p JOIN w USING (kind, k) JOIN s ON s.run_id = p.run_id AND s.i = p.lo + w.j WHERE p.n >= {window} GROUP BY 1, 2"""


def losses(spark, sf):
    """A loss-like series per run."""
    return metrics(spark, sf).select("run_id", "step", F.log1p("value").alias("value"))


@query("l9_smooth_16_2", smooth_sql(16, 2))
def l9(spark, sf):
    smoothed = runs.smooth(losses(spark, sf), 16, 2)
    return smoothed.select("run_id", "step", F.round("smoothed", 6).alias("smoothed"))


@query("l9_smooth_50_5", smooth_sql(50, 5))
def l9_wide(spark, sf):
    smoothed = runs.smooth(losses(spark, sf), 50, 5)
    return smoothed.select("run_id", "step", F.round("smoothed", 6).alias("smoothed"))


def marker_logs(spark, sf):
    """A log per user: signups finish a stage, views start one, at time ``value``."""
    text = (
        F.when(F.col("event_type") == "signup", F.format_string("Finished pretrain %.2f", "value"))
        .when(F.col("event_type") == "view", F.format_string("Start pretrain %.2f", "value"))
        .when(F.col("event_type") == "click", F.format_string("State transformation took %.2fs", "value"))
        .when(F.col("event_type") == "purchase", F.format_string("Step: %d,\tLoss: %.2f", "event_id", "value"))
        .otherwise(F.format_string("retry Step: %d,\tLoss: %.2f", "event_id", "value"))
    )
    return events(spark, sf).select(
        F.col("event_type").alias("run_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"),
        F.col("event_id").alias("line_no"),
        text.alias("text"),
    )


FINISHED, STARTED = r"Finished pretrain (\d+\.\d+)", r"Start pretrain (\d+\.\d+)"


@query(
    "l10_marker_latency",
    """WITH a AS (SELECT user_id, arg_min(value, event_id) AS t, min(event_id) AS line FROM events WHERE event_type = 'signup' GROUP BY 1),
    b AS (SELECT e.user_id, arg_min(value, event_id) AS t FROM events e JOIN a ON a.user_id = e.user_id AND event_id > line
          WHERE event_type = 'view' GROUP BY 1)
    SELECT 'u' || u.user_id AS file, a.t AS begin_time, b.t AS end_time, round(b.t - a.t, 6) AS latency
    FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN a USING (user_id) LEFT JOIN b USING (user_id)""",
)
def l10(spark, sf):
    return runs.marker_latency(marker_logs(spark, sf), FINISHED, STARTED).withColumn("latency", F.round("latency", 6))


@query(
    "l10_marker_gaps",
    """SELECT 'u' || a.user_id AS file, a.event_id AS line_no, a.value AS begin_time, b.value AS end_time, round(b.value - a.value, 6) AS latency
    FROM (SELECT * FROM events WHERE event_type = 'signup') a
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.event_id < b.event_id""",
)
def l10_gaps(spark, sf):
    return runs.marker_gaps(marker_logs(spark, sf), FINISHED, STARTED).withColumn("latency", F.round("latency", 6))


@query(
    "l11_extract_first",
    """SELECT 'u' || user_id AS file, arg_min(value, event_id) FILTER (event_type = 'click') AS value FROM events GROUP BY user_id""",
)
def l11(spark, sf):
    return runs.extract_first(marker_logs(spark, sf), r"State transformation took (\d+\.\d+)s")


def steps_of_users(spark, sf):
    ev = events(spark, sf).select(F.col("user_id").alias("run_id"), "event_id", "value")
    return running(ev, ["event_id"], ["run_id"], position="_i").select(
        "run_id", (F.col("_i") + 1).alias("step"), (F.col("event_id") % 128 + 1).alias("samples"), F.col("value").alias("seconds")
    )


@query(
    "l12_rate_summary",
    """WITH s AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i,
        event_id % 128 + 1 AS samples, value FROM events),
    r AS (SELECT run_id, i // 10 AS mark, sum(samples) / sum(value) AS rate, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) = 10)
    SELECT run_id, round(avg(rate), 6) AS mean, round(1.96 * stddev_pop(rate), 6)::DOUBLE AS margin FROM r GROUP BY run_id""",
)
def l12(spark, sf):
    summary = runs.rate_summary(steps_of_users(spark, sf), 10)
    return summary.select("run_id", F.round("mean", 6).alias("mean"), F.round("margin", 6).alias("margin"))


@query(
    "l13_schedule_points",
    """WITH s AS (SELECT o_custkey AS run_id, o_orderkey AS step,
        (CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 4 ELSE 16 END) AS size FROM orders),
    p AS (SELECT *, coalesce(lag(size) OVER (PARTITION BY run_id ORDER BY step), 0) AS prev FROM s)
    SELECT run_id, step * 128 - 1 AS progress, prev::BIGINT AS size FROM p WHERE step <> 0
    UNION ALL SELECT run_id, step * 128, size FROM p WHERE step = 0 OR size <> 0""",
)
def l13(spark, sf):
    first = F.substring("o_orderpriority", 1, 1)
    size = F.when(first == "1", 0).when(first == "2", 4).otherwise(16).cast("bigint")
    schedule = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("step"), size.alias("size")
    )
    return runs.schedule_points(schedule, 128)


@query(
    "l14_subsample",
    """SELECT run_id, step, value FROM (SELECT event_type AS run_id, event_id AS step, value,
      row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i FROM events) WHERE i % 7 = 0""",
)
def l14(spark, sf):
    return runs.subsample(metrics(spark, sf).select("run_id", "step", "value"), 7)


@query(
    "l15_throughput_matrix",
    """WITH t AS (SELECT 'c' || (o_custkey % 11) AS model, 'm' || (o_orderkey % 4) AS config,
        CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS v FROM orders)
    SELECT model, round(avg(v) FILTER (config = 'm0'), 6) AS m0, round(avg(v) FILTER (config = 'm1'), 6) AS m1,
      round(avg(v) FILTER (config = 'm2'), 6) AS m2, round(avg(v) FILTER (config = 'm3'), 6) AS m3
    FROM t WHERE v > 0 GROUP BY model""",
)
def l15(spark, sf):
    rate = F.when(F.col("o_orderstatus") == "F", 0.0).when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))
    results = table(spark, sf, "orders").select(
        F.concat(F.lit("c"), (F.col("o_custkey") % 11).cast("string")).alias("model"),
        F.concat(F.lit("m"), (F.col("o_orderkey") % 4).cast("string")).alias("config"),
        rate.alias("throughput"),
    )
    matrix = runs.throughput_matrix(results, "model", "config", ["m0", "m1", "m2", "m3"])
    return matrix.select("model", *[F.round(c, 6).alias(c) for c in ("m0", "m1", "m2", "m3")])


@query(
    "l16_parse_losses",
    "SELECT 'u' || user_id AS file, event_id AS line_no, event_id AS step, value AS loss FROM events WHERE event_type = 'purchase'",
)
def l16(spark, sf):
    return runs.parse_losses(marker_logs(spark, sf)).drop("run_id")


@query(
    "l17_recovery_times",
    RING
    + """, f AS (SELECT item, item % 150 AS run_id, alive > 0 AS recoverable FROM items JOIN res ON owner = device // 8 WHERE owner_down),
    a AS (SELECT user_id, arg_min(value, event_id) AS t, min(event_id) AS line FROM events WHERE event_type = 'signup' GROUP BY 1),
    b AS (SELECT a.user_id, any_value(a.t) AS t, arg_min(value, event_id) AS u FROM events e JOIN a ON a.user_id = e.user_id AND event_id > line
          WHERE event_type = 'view' GROUP BY 1)
    SELECT item, 'u' || run_id AS run_id, recoverable, round(u - t + CASE WHEN recoverable THEN 0 ELSE 360 END, 6)::DOUBLE AS recovery,
      round(u - t + 360, 6)::DOUBLE AS baseline FROM f LEFT JOIN b ON run_id = user_id""",
)
def l17(spark, sf):
    owned = items(spark, sf).select("item", F.expr("device div 8").alias("owner"))
    impact = placement.failure_impact(owned, placement.replicas(hosts(spark, sf), 2), failed(spark, sf))
    failures = impact.select(
        "item", F.concat(F.lit("u"), (F.col("item") % 150).cast("string")).alias("run_id"), "recoverable"
    )
    latencies = runs.marker_latency(marker_logs(spark, sf), FINISHED, STARTED).select(F.col("file").alias("run_id"), "latency")
    times = runs.recovery_times(failures, latencies, 50, 7.2)
    return times.withColumn("recovery", F.round("recovery", 6)).withColumn("baseline", F.round("baseline", 6))


@query("l18_metric_tags", SERIES + "SELECT run_id, tag, count(*) AS points FROM m GROUP BY run_id, tag")
def l18(spark, sf):
    return runs.metric_tags(metrics(spark, sf))


@query("l18_extract_tag", SERIES + "SELECT run_id, step, value FROM m WHERE tag = 'k3'")
def l18_tag(spark, sf):
    return runs.extract_tag(metrics(spark, sf), "k3").drop("wall_time")
