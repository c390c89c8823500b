"""Training logs ``(run_id, file, line_no, text)`` and metric series ``(run_id, tag, wall_time, step, value)``."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardframe.functions.numbers import as_col
from shardframe.operators.ordinal import following, neighbour, running

# The texts that the training programs print.
ERROR_MARKERS = ("RuntimeError", "OutOfMemoryError", "IndexError")
OOM_MARKER = "CUDA out of memory"
STEP_MS = r"elapsed time per iteration \(ms\): (\d+\.\d+)"
STEP_LINE = "elapsed time per iteration"
STEP_MS_KEY = "elapsed time per iteration (ms)"
BATCH_KEY = "global batch size"
LOSS_LINE = r"^Step: (\d+).*Loss: (\d*\.\d*)"
RUN_DEGREES = r"mp(\d+)-dp(\d+)-pp(\d+)"
RUN_NAME = r"^logs-(.+)-(.+)-(.+)-(\d+)-(\d+)-(\d+)-(\d+)-(\d+)"


def capture(text, pattern: str, group: int = 1) -> Column:
    """A capture group, null where the pattern does not occur."""
    text = as_col(text)
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def kv_map(text) -> Column:
    """``k: v | k: v`` as a map; parts without exactly one colon are skipped, the last of equal keys wins."""
    pairs = F.filter(F.transform(F.split(as_col(text), r"\|"), lambda p: F.split(p, ":")), lambda kv: F.size(kv) == 2)
    entries = F.transform(pairs, lambda kv: F.struct(F.trim(kv[0]).alias("k"), F.trim(kv[1]).alias("v")))
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["k"] == e["k"]),
    )
    return F.map_from_entries(last)


def kv_value(text, key: str) -> Column:
    """One key's value of such a line without building the map; null where it is absent."""
    return capture(text, rf"^(?:.*\|)?\s*\Q{key}\E\s*:\s*([^|:]*?)\s*(?:\|.*)?$")


def parse_kv_lines(logs: DataFrame) -> DataFrame:
    """Add the ``kv`` map to every line."""
    return logs.withColumn("kv", kv_map("text"))


def step_times(logs: DataFrame) -> DataFrame:
    """Mean step time per run in seconds without the first iteration, and a status.

    The first file of a run (by name) that is not an error decides. One iteration alone gives null.
    """
    ms = capture("text", STEP_MS).try_cast("double")
    files = logs.groupBy("run_id", "file").agg(
        F.bool_or(F.col("text").contains(OOM_MARKER)).alias("oom"),
        F.count(ms).alias("n"),
        F.sum(ms).alias("total"),
        F.min_by(ms, F.when(ms.isNotNull(), F.col("line_no"))).alias("first"),
    )
    status = F.when(F.col("oom"), "OOM").when(F.col("n") > 0, "ok").otherwise("error")
    seconds = F.when(
        (status == "ok") & (F.col("n") > 1), F.round((F.col("total") - F.col("first")) / (F.col("n") - 1) / 1000, 1)
    )
    rated = files.select("run_id", "file", status.alias("status"), seconds.alias("step_time"))
    decides = F.when(F.col("status") != "error", F.col("file"))
    best = rated.groupBy("run_id").agg(F.min_by(F.struct("status", "step_time"), decides).alias("b"))
    return best.select("run_id", "b.step_time", F.coalesce("b.status", F.lit("error")).alias("status"))


def throughput(logs: DataFrame) -> DataFrame:
    """Mean samples per second per run; 0 when an error marker occurs, null without step lines."""
    failed = F.lit(False)
    for marker in ERROR_MARKERS:
        failed = failed | F.col("text").contains(marker)
    batch, ms = (kv_value("text", key).try_cast("double") for key in (BATCH_KEY, STEP_MS_KEY))
    rate = F.when(F.col("text").contains(STEP_LINE), batch / F.nullif(ms, F.lit(0.0)) * 1000)
    runs = logs.groupBy("run_id").agg(F.bool_or(failed).alias("failed"), F.avg(rate).alias("rate"))
    return runs.select("run_id", F.when(F.col("failed"), F.lit(0.0)).otherwise(F.col("rate")).alias("throughput"))


def parse_run_id(df: DataFrame, column: str = "run_id") -> DataFrame:
    """Degrees and experiment settings from a run name, null where the name has none."""

    def number(pattern: str, group: int) -> Column:
        return capture(column, pattern, group).try_cast("bigint")

    cluster, pp, mp = number(RUN_NAME, 4), number(RUN_NAME, 5), number(RUN_NAME, 6)
    return df.select(
        "*",
        F.coalesce(number(RUN_DEGREES, 1), mp).alias("mp"),
        F.coalesce(number(RUN_DEGREES, 2), F.floor(cluster / F.nullif(pp * mp, F.lit(0))).cast("bigint")).alias("dp"),
        F.coalesce(number(RUN_DEGREES, 3), pp).alias("pp"),
        capture(column, RUN_NAME, 1).alias("model"),
        capture(column, RUN_NAME, 2).alias("model_size"),
        capture(column, RUN_NAME, 3).alias("dataset"),
        cluster.alias("cluster_size"),
        number(RUN_NAME, 7).alias("batch_size"),
        number(RUN_NAME, 8).alias("micro_batch_size"),
    )


def select_runs(parsed: DataFrame, name: str, size: int, column: str = "run_id") -> DataFrame:
    """Runs of one cluster size whose name contains ``name``."""
    return parsed.filter((F.col("mp") * F.col("dp") * F.col("pp") == size) & F.col(column).contains(name))


def merge_series(*series: DataFrame) -> DataFrame:
    """Union of metric series in time order, with the 0-based ``point`` of each row."""
    merged = series[0]
    for other in series[1:]:
        merged = merged.unionByName(other)
    ties = [c for c in merged.columns if c not in ("wall_time", "step")]
    return running(merged, ["wall_time", "step", *ties], position="point")


def zero_time(df: DataFrame, scope: str = "run") -> DataFrame:
    """Wall time in minutes since the first point of the run, or of all runs (``scope='all'``)."""
    if scope == "all":
        first = df.agg(F.min("wall_time")).scalar()
        return df.withColumn("wall_time", (F.col("wall_time") - first) / 60)
    starts = df.groupBy("run_id").agg(F.min("wall_time").alias("_t0"))
    joined = df.join(starts, "run_id")
    return joined.withColumn("wall_time", (F.col("wall_time") - F.col("_t0")) / 60).drop("_t0")


def add_pauses(df: DataFrame, interval: int = 35) -> DataFrame:
    """Shift times by ``interval`` from every multiple of twice the interval on (below the run's length)."""
    period = 2 * interval
    lengths = df.groupBy("run_id").agg(F.floor(F.max("wall_time")).cast("bigint").alias("_len"))
    joined = df.join(lengths, "run_id")
    pauses = F.least(F.floor(F.col("wall_time") / period), F.ceil(F.col("_len") / period) - 1)
    return joined.withColumn(
        "wall_time", F.col("wall_time") + interval * F.greatest(F.lit(0), pauses)
    ).drop("_len")


def first_at_or_after(points: DataFrame, series: DataFrame, columns: Sequence[str] = ("step", "value")) -> DataFrame:
    """First series row at or after each point ``(run_id, wall_time, …)``."""
    return following(points, series, ["run_id"], "wall_time", columns)


def cut_to_common_step(df: DataFrame) -> DataFrame:
    """All runs up to the smallest final step."""
    common = df.groupBy("run_id").agg(F.max("step").alias("s")).agg(F.min("s")).scalar()
    return df.filter(F.col("step") <= common)


def final_points(df: DataFrame) -> DataFrame:
    """Final step of each run and its time."""
    return df.groupBy("run_id").agg(
        F.max("step").alias("final_step"), F.max_by("wall_time", F.struct("step", "wall_time")).alias("final_time")
    )


def fit_weights(window: int, order: int, at: float) -> np.ndarray:
    """Weights whose dot product with a window is its least-squares polynomial at offset ``at``."""
    x = np.arange(window) - at
    return np.linalg.pinv(np.vander(x, order + 1, increasing=True))[0]


def smooth(df: DataFrame, window: int, order: int, value: str = "value", along: Sequence[str] = ("step",)) -> DataFrame:
    """Savitzky–Golay smoothing per run: adds ``smoothed``.

    Interior points take the polynomial of the window around them at its centre, the first and last
    ``window // 2`` points that of the first and last full window. Runs shorter than a window keep null.
    Runs are cut into blocks with a margin of one window, so a long run is many small groups.
    """
    block = max(4096, 4 * window)
    placed = running(df, list(along), ["run_id"], position="_i", total="_n").withColumn("_id", F.col("_i"))
    own = F.expr(f"_i div {block}L")
    near = F.array_distinct(
        F.array(
            F.expr(f"greatest(0L, _i - {window}L) div {block}L"), own, F.expr(f"least(_n - 1, _i + {window}L) div {block}L")
        )
    )
    # Only the position and value travel to the neighbour blocks.
    spread = placed.select("run_id", "_i", "_n", F.col(value).cast("double").alias("_v"), F.explode(near).alias("_b"))
    half = window // 2
    back = window - 1 - half  # points of the window before the current one

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        i, v, n, b = pdf["_i"].to_numpy(), pdf["_v"].to_numpy(), int(pdf["_n"].iloc[0]), int(pdf["_b"].iloc[0])
        mine = i[(i // block) == b]
        out = np.full(len(mine), np.nan)
        if n >= window:
            centre = np.convolve(v, fit_weights(window, order, (window - 1) / 2)[::-1], mode="valid")
            inner = (mine >= half) & (mine < n - half)
            out[inner] = centre[mine[inner] - back - i[0]]
            for k in np.flatnonzero(~inner):
                start = 0 if mine[k] < half else n - window
                out[k] = v[start - i[0] : start - i[0] + window] @ fit_weights(window, order, float(mine[k] - start))
        return pd.DataFrame({"run_id": pdf["run_id"].iloc[0], "_i": mine, "smoothed": out})

    kind = df.schema["run_id"].dataType.simpleString()
    fitted = spread.groupBy("run_id", "_b").applyInPandas(fit, f"run_id {kind}, _i bigint, smoothed double")
    values = fitted.select("run_id", "_i", F.when(~F.isnan("smoothed"), F.col("smoothed")).alias("smoothed"))
    return placed.join(values, ["run_id", "_i"]).select(*df.columns, "smoothed")


def marker_latency(logs: DataFrame, begin: str, end: str, by: str = "file") -> DataFrame:
    """Time from the first ``begin`` capture to the first ``end`` capture on a later line; null when missing."""
    lines = logs.select(
        by, "line_no", capture("text", begin).try_cast("double").alias("a"), capture("text", end).try_cast("double").alias("b")
    )
    firsts = lines.groupBy(by).agg(
        F.min_by("a", F.when(F.col("a").isNotNull(), F.col("line_no"))).alias("begin_time"),
        F.min(F.when(F.col("a").isNotNull(), F.col("line_no"))).alias("begin_line"),
    )
    ends = lines.filter(F.col("b").isNotNull()).select(by, "line_no", "b")
    later = ends.join(firsts.select(by, "begin_line"), by).filter(F.col("line_no") > F.col("begin_line"))
    end_times = later.groupBy(by).agg(F.min_by("b", "line_no").alias("end_time"))
    return firsts.join(end_times, by, "left").select(
        by, "begin_time", "end_time", (F.col("end_time") - F.col("begin_time")).alias("latency")
    )


def marker_gaps(logs: DataFrame, begin: str, end: str, by: str = "file") -> DataFrame:
    """Every ``begin`` capture with the next later ``end`` capture of the same file or run."""
    lines = logs.select(
        by, "line_no", capture("text", begin).try_cast("double").alias("a"), capture("text", end).try_cast("double").alias("b")
    )
    starts = lines.filter(F.col("a").isNotNull()).select(by, "line_no", F.col("a").alias("begin_time"))
    ends = lines.filter(F.col("b").isNotNull()).select(by, "line_no", F.col("b").alias("time"))
    paired = following(starts, ends, [by], "line_no", ["time"], strict=True)
    return paired.select(
        by, "line_no", "begin_time", F.col("next_time").alias("end_time"), (F.col("next_time") - F.col("begin_time")).alias("latency")
    )


def extract_first(logs: DataFrame, pattern: str, by: str = "file") -> DataFrame:
    """First captured number per log, null when it never occurs."""
    number = capture("text", pattern).try_cast("double")
    return logs.groupBy(by).agg(F.min_by(number, F.when(number.isNotNull(), F.col("line_no"))).alias("value"))


def windowed_rates(df: DataFrame, period: int = 10) -> DataFrame:
    """Rate per full period of steps from ``(run_id, step, samples, seconds)``, steps from 1."""
    return (
        df.groupBy("run_id", F.expr(f"(step - 1) div {period}L").alias("mark"))
        .agg((F.sum("samples") / F.sum("seconds")).alias("rate"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") == period)
        .drop("n")
    )


def rate_summary(df: DataFrame, period: int = 10) -> DataFrame:
    """Mean rate per run and 1.96 population standard deviations."""
    return windowed_rates(df, period).groupBy("run_id").agg(
        F.avg("rate").alias("mean"), (1.96 * F.stddev_pop("rate")).alias("margin")
    )


def schedule_points(schedule: DataFrame, batch: int) -> DataFrame:
    """Polyline ``(run_id, progress, size)`` of a size schedule ``(run_id, step, size)``."""
    placed = running(schedule.select("run_id", "step", "size"), ["step"], ["run_id"], position="_k")
    prev = neighbour(placed, ["run_id"], "_k", {"_before": "size"}, -1)
    at = F.col("step") * batch
    before = F.struct((at - 1).alias("progress"), F.coalesce("_before", F.lit(0)).cast("bigint").alias("size"))
    here = F.struct(at.alias("progress"), F.col("size").cast("bigint").alias("size"))
    points = F.when(F.col("step") == 0, F.array(here)).when(F.col("size") == 0, F.array(before)).otherwise(F.array(before, here))
    return prev.select("run_id", F.explode(points).alias("p")).select("run_id", "p.progress", "p.size")


def subsample(df: DataFrame, every: int, along: Sequence[str] = ("step",)) -> DataFrame:
    """Every n-th point of each run, the first one included."""
    return running(df, list(along), ["run_id"], position="_i").filter(F.col("_i") % every == 0).drop("_i")


def throughput_matrix(df: DataFrame, row: str, config: str, configs: Sequence[str] | None = None) -> DataFrame:
    """Throughput per row key and configuration without failed (null or 0) results."""
    kept = df.filter(F.col("throughput") > 0).groupBy(row)
    return (kept.pivot(config, list(configs)) if configs else kept.pivot(config)).agg(F.avg("throughput"))


def parse_losses(logs: DataFrame) -> DataFrame:
    """``(run_id, file, line_no, step, loss)`` of lines that start with a step and hold a loss."""
    return logs.filter(F.col("text").rlike(LOSS_LINE)).select(
        "run_id",
        "file",
        "line_no",
        F.regexp_extract("text", LOSS_LINE, 1).try_cast("bigint").alias("step"),
        F.regexp_extract("text", LOSS_LINE, 2).try_cast("double").alias("loss"),
    )


def recovery_times(failures: DataFrame, latencies: DataFrame, lost_steps: float, step_time: float) -> DataFrame:
    """Recovery per failure and what falling back to the last checkpoint would take.

    ``failures(run_id, recoverable)``, ``latencies(run_id, latency)`` in seconds.
    """
    rerun = F.lit(float(lost_steps) * float(step_time))
    joined = failures.join(latencies, "run_id", "left")
    return joined.select(
        *failures.columns,
        (F.col("latency") + F.when(F.col("recoverable"), F.lit(0.0)).otherwise(rerun)).alias("recovery"),
        (F.col("latency") + rerun).alias("baseline"),
    )


def metric_tags(metrics: DataFrame) -> DataFrame:
    """Number of points per run and tag."""
    return metrics.groupBy("run_id", "tag").agg(F.count(F.lit(1)).alias("points"))


def extract_tag(metrics: DataFrame, tag: str) -> DataFrame:
    """One tag's series."""
    return metrics.filter(F.col("tag") == tag).select("run_id", "wall_time", "step", "value")
