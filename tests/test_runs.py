import numpy as np
import pytest

from shardframe.operators import runs

LINES = """ iteration 10/ 50 | elapsed time per iteration (ms): 2000.0 | global batch size: 128 | lm loss: 9.1E+00 |
 iteration 20/ 50 | elapsed time per iteration (ms): 1000.0 | global batch size: 128 | lm loss: 8.7E+00 |
Finished pretrain 100.5
Start pretrain 112.0
State transformation took 8.250000s
Step: 10,\tLoss: 1.250000
RESULT Img/sec: 301.4 +-2.1""".split("\n")


def logs(spark, files):
    data = [(f.split("/")[0], f, i, t) for f, lines in files.items() for i, t in enumerate(lines)]
    return spark.createDataFrame(data, "run_id string, file string, line_no bigint, text string")


def test_log_measures(spark, rows):
    df = logs(spark, {"a/1": LINES, "b/1": [*LINES, "x OutOfMemoryError y"], "c/1": ["CUDA out of memory"], "d/1": LINES[:1], "e/1": ["-"], "e/2": LINES[:3]})
    assert rows(runs.throughput(df)) == [("a", 96.0), ("b", 0.0), ("c", None), ("d", 64.0), ("e", 96.0)]
    assert rows(runs.step_times(df)) == [("a", 1.0, "ok"), ("b", 1.0, "ok"), ("c", None, "OOM"), ("d", None, "ok"), ("e", 1.0, "ok")]
    finished, started = r"Finished pretrain (\d+\.\d+)", r"Start pretrain (\d+\.\d+)"
    latency = {r.file: r.latency for r in runs.marker_latency(df, finished, started).collect()}
    assert latency["a/1"] == 11.5 and latency["e/2"] is None and latency["c/1"] is None
    gaps = {r.file: r.latency for r in runs.marker_gaps(df, finished, started).collect()}
    assert gaps == {"a/1": 11.5, "b/1": 11.5, "e/2": None}
    first = {r.file: r.value for r in runs.extract_first(df, r"State transformation took (\d+\.\d+)s").collect()}
    assert first["a/1"] == 8.25 and first["d/1"] is None
    summary = {r.file: r.value for r in runs.extract_first(df, r"Img/sec: (\d+\.\d+)").collect()}
    assert summary["a/1"] == 301.4
    assert rows(runs.parse_losses(df.filter("file = 'a/1'")), "step", "loss") == [(10, 1.25)]
    kv = runs.parse_kv_lines(df.filter("file = 'd/1'")).first().kv
    assert kv == {"elapsed time per iteration (ms)": "2000.0", "global batch size": "128", "lm loss": "9.1E+00"}


def test_kv_last_value_wins(spark):
    df = logs(spark, {"a/1": ["k: 1 | k: 2 | a:b:c | x"]})
    assert runs.parse_kv_lines(df).first().kv == {"k": "2"}


def test_run_names(spark, rows):
    df = spark.createDataFrame([("logs-gpt-2.7B-128-8-mp4-dp2-pp2",), ("logs-bert-xl-wiki-16-2-4-128-8",), ("x",)], "run_id string")
    parsed = runs.parse_run_id(df)
    assert rows(parsed, "mp", "dp", "pp", "model", "cluster_size") == [(4, 2, 2, "bert", 16), (4, 2, 2, None, None), (None, None, None, None, None)]
    assert runs.select_runs(parsed, "gpt", 16).count() == 1


def test_pauses(spark):
    df = spark.createDataFrame([("r", float(t), t, 0.0) for t in range(151)], "run_id string, wall_time double, step bigint, value double")
    got = {r.step: r.wall_time for r in runs.add_pauses(df, 35).collect()}
    assert (got[69], got[70], got[139], got[140], got[150]) == (69, 105, 174, 210, 220)


def test_cut_rate_schedule(spark, rows):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(5)] + [("b", i, float(i)) for i in range(3)], "run_id string, step bigint, wall_time double")
    assert runs.cut_to_common_step(df).count() == 6
    assert rows(runs.final_points(df)) == [("a", 4, 4.0), ("b", 2, 2.0)]
    rates = spark.createDataFrame([("a", i, 10 * i, 2.0) for i in range(1, 6)], "run_id string, step bigint, samples bigint, seconds double")
    got = runs.rate_summary(rates, 2).first()
    assert got["mean"] == pytest.approx(12.5) and got.margin == pytest.approx(1.96 * 5)
    schedule = spark.createDataFrame([("a", 0, 16), ("a", 50, 8), ("a", 60, 0)], "run_id string, step bigint, size bigint")
    assert rows(runs.schedule_points(schedule, 128), "progress", "size") == [(0, 16), (6399, 16), (6400, 8), (7679, 8)]
    assert rows(runs.subsample(df, 2), "run_id", "step") == [("a", 0), ("a", 2), ("a", 4), ("b", 0), ("b", 2)]


def naive_smooth(v, window, order):
    """Fit every window on its own."""
    n, half = len(v), window // 2
    out = np.empty(n)
    for i in range(n):
        if i < half:
            start, at = 0, i
        elif i >= n - half:
            start, at = n - window, i - (n - window)
        else:
            start, at = i - (window - 1 - half), (window - 1) / 2
        centre = (window - 1) / 2
        out[i] = np.polyval(np.polyfit(np.arange(window) - centre, v[start : start + window], order), at - centre)
    return out


@pytest.mark.parametrize("window, order, n", [(50, 5, 9000), (16, 2, 40), (5, 2, 5), (16, 2, 9)])
def test_smooth(spark, window, order, n):
    v = np.random.default_rng(n).random(n)
    df = spark.createDataFrame([("r", i, float(x)) for i, x in enumerate(v)], "run_id string, step bigint, value double")
    got = [r.smoothed for r in runs.smooth(df, window, order).sort("step").collect()]
    if n < window:
        assert got == [None] * n
    else:
        assert np.allclose(got, naive_smooth(v, window, order), atol=1e-8)


def test_recovery(spark, rows):
    failures = spark.createDataFrame([("r", True), ("r", False), ("s", True)], "run_id string, recoverable boolean")
    times = spark.createDataFrame([("r", 19.6)], "run_id string, latency double")
    assert rows(runs.recovery_times(failures, times, 50, 7.2)) == [("r", False, 379.6, 379.6), ("r", True, 19.6, 379.6), ("s", True, None, None)]
