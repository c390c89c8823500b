import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shardframe import streaming
from shardframe.plans import QUERIES, stream_queries
from shardframe.plans.stream_queries import PROVIDER, ROCKSDB
from shardframe.streaming.gaps import GapProcessor

T0 = dt.datetime(2024, 1, 1)


def stream(spark, tmp_path, batches, schema):
    """Each batch is one file and one micro-batch."""
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_rate_drops_late_rows(spark, tmp_path, rows):
    # Rows count as late one batch after the watermark has passed them.
    batches = [[("r", at(1), 10), ("r", at(2), 20)], [("r", at(300), 5)], [("r", at(301), 6)], [("r", at(3), 1000), ("r", at(600), 1)]]
    df = streaming.stream_rate(stream(spark, tmp_path, batches, "run_id string, ts timestamp, n bigint"), "1 hour")
    out = streaming.run_available(df, "rate")
    assert rows(out, "run_id", "total", "rate") == [("r", 11, 11 / 3600), ("r", 30, 30 / 3600)]


def test_miss_rate_and_latest_step(spark, tmp_path, rows):
    batches = [[("r", at(1), True), ("r", at(2), False), ("q", at(2), None)], [("r", at(500), True)]]
    df = streaming.stream_miss_rate(stream(spark, tmp_path, batches, "run_id string, ts timestamp, hit boolean"), "1 hour")
    assert rows(streaming.run_available(df, "miss"), "run_id", "misses", "accesses", "miss_rate") == [("q", 0, 0, None), ("r", 1, 2, 0.5)]
    steps = stream(spark, tmp_path / "s", [[("j", at(5), 7)], [("j", at(1), 99)], [("j", at(6), 3)]], "job string, ts timestamp, step bigint")
    out = streaming.run_available(streaming.stream_latest_step(steps), "step", "update")
    assert out.groupBy("job").agg(F.max_by("step", "batch")).first()[1] == 3


def test_marker_gaps(spark, tmp_path):
    batches = [
        [("r", at(0), False), ("r", at(1), False), ("q", at(0), False)],
        [("r", at(10), True), ("r", at(12), True)],
        [("z", at(3000), True), ("z", at(3001), False)],
        [("z", at(9000), True)],
    ]
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        events = stream(spark, tmp_path, batches, "run_id string, ts timestamp, started boolean")
        out = streaming.run_available(streaming.stream_marker_latency(events, timeout="1 day"), "gaps")
        got = sorted((r.run_id, r.gap) for r in out.collect())
    finally:
        spark.conf.set(PROVIDER, before)
    assert ("r", 600.0) in got and ("q", None) in got
    assert [g for g in got if g[0] == "r"] == [("r", 600.0)]


def gaps_of(spark, tmp_path, batches, timeout):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        events = stream(spark, tmp_path, batches, "run_id string, ts timestamp, started boolean")
        out = streaming.run_available(streaming.stream_marker_latency(events, timeout=timeout), "gaps")
        return sorted(((r.run_id, r.finished, r.gap) for r in out.collect()), key=repr)
    finally:
        spark.conf.set(PROVIDER, before)


@pytest.mark.parametrize("parts", [1, 2, 10])
def test_gaps_keep_their_timeout_in_any_batches(spark, tmp_path, parts):
    """Gaps of a day at most; the rows are the same however they are cut into batches."""
    r = random.Random(5)
    marks = sorted((at(r.randint(0, 40_000)), r.choice("rq"), r.random() < 0.5) for _ in range(200))
    rows = [(run, t, started) for t, run, started in marks] + [("z", at(60_000), True)]
    size = -(-len(rows) // parts)
    got = gaps_of(spark, tmp_path, [rows[k : k + size] for k in range(0, len(rows), size)], "1 day")
    assert got == brute_gaps(rows)
    assert any(g is None for *_, g in got) and any(g is not None for *_, g in got)


def brute_gaps(rows):
    """Gaps of a day at most, by a walk over each run's markers in the order of their times."""
    want = []
    for run in "qr":
        open_ = None
        for name, t, started in sorted(rows, key=lambda x: (x[1], x[2])):
            if name != run:
                continue
            if open_ is not None and t - open_ > dt.timedelta(days=1):
                want.append((run, open_, None))
                open_ = None
            if open_ is not None and started and t > open_:
                want.append((run, open_, (t - open_).total_seconds()))
                open_ = None
            elif open_ is None and not started:
                open_ = t
        if open_ is not None:
            want.append((run, open_, None))
    return sorted(want, key=repr)


@pytest.mark.parametrize("parts, seed", [(1, 1), (3, 2), (12, 3), (12, 4)])
def test_gaps_of_shuffled_arrival(spark, tmp_path, parts, seed):
    """Rows come up to 55 minutes after their time, in any order inside a batch; many are closer than that."""
    r = random.Random(seed)
    rows = [(r.choice("rq"), at(r.randint(0, 3_000)), r.random() < 0.5) for _ in range(300)]
    rows += rows[:20]
    arrival = sorted(rows, key=lambda x: x[1] + dt.timedelta(minutes=r.uniform(0, 55)))
    arrival.append(("z", at(60_000), True))
    size = -(-len(arrival) // parts)
    batches = [r.sample(b, len(b)) for b in (arrival[k : k + size] for k in range(0, len(arrival), size))]
    assert gaps_of(spark, tmp_path, batches, "1 day") == brute_gaps(rows)


def test_a_start_between_waits_for_its_turn(spark, tmp_path):
    """Finished at 10, starts at 20 and then 15: the gap ends at 15 in one batch and in two."""
    marks = [("r", at(10), False), ("r", at(20), True), ("r", at(15), True), ("z", at(6_000), True)]
    for k, cut in enumerate(([marks], [marks[:2], marks[2:]], [[m] for m in marks])):
        assert gaps_of(spark, tmp_path / str(k), cut, "1 day") == [("r", at(10), 300.0)]


def test_markers_before_the_watermark_wait(spark, tmp_path):
    batches = [[("r", at(0), False), ("r", at(30), True), ("q", at(0), False)], [("r", at(31), False), ("r", at(80), True)]]
    # The watermark stands at 20 minutes: the start at 30 could still be overtaken.
    assert gaps_of(spark, tmp_path, batches, "1 day") == []


def test_open_windows_count_in_update_mode(spark, tmp_path, rows):
    batches = [[("r", at(1), 10)], [("r", at(2), 20), ("r", at(100), 7)]]
    df = streaming.stream_rate(stream(spark, tmp_path, batches, "run_id string, ts timestamp, n bigint"), "1 hour")
    out = streaming.latest(streaming.run_available(df, "rate", "update"), ["run_id", "start", "end"])
    assert rows(out, "run_id", "total") == [("r", 30), ("r", 7)]


class Told:
    """State, timers and clock of one run in memory; counts the calls."""

    def __init__(self):
        self.calls, self.value, self.pages, self.timers, self.now = 0, None, {}, set(), 0

    def __getattr__(self, name):
        acts = {
            "getValueState": lambda *_: self, "getMapState": lambda *_: self, "get": lambda: self.value, "getValue": lambda k: self.pages.get(k),
            "update": lambda v: setattr(self, "value", v), "clear": lambda: setattr(self, "value", None), "updateValue": self.pages.__setitem__,
            "removeKey": lambda k: self.pages.pop(k), "registerTimer": self.timers.add, "deleteTimer": self.timers.remove,
        }

        def call(*args):
            self.calls += 1
            return acts[name](*args)

        return call

    def getCurrentWatermarkInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return min(self.timers)


@pytest.mark.parametrize("pages, most", [(4, None), (8192, 12)])
def test_a_run_takes_few_calls(pages, most):
    """Hours lie between the markers of a run; they are one page and a handful of calls, or many pages with the same gaps."""
    r = random.Random(7)
    rows = sorted((r.randint(1, 30 * 86_400) * 1_000_000, r.random() < 0.5) for _ in range(200))
    told, day = Told(), 86_400 * 1_000
    gaps = GapProcessor(day, pages)
    gaps.init(told)
    told.calls = 0
    for cut in (rows[::2], rows[1::2]):
        list(gaps.handleInputRows(("q",), iter([pd.DataFrame(cut, columns=["micros", "started"])]), told))
    assert pages > 200 or len(told.pages) >= 50
    got = []
    for told.now in (15 * day, 40 * day):
        if told.timers and min(told.timers) <= told.now:
            expired = min(told.timers)
            got += [x for frame in gaps.handleExpiredTimer(("q",), told, told) for x in frame.itertuples(index=False)]
            told.timers.discard(expired)
    assert told.value is None and not told.pages and not told.timers
    want = brute_gaps([("q", dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=t), s) for t, s in rows])
    assert sorted(((x.run_id, x.finished.to_pydatetime(), None if np.isnan(x.gap) else x.gap) for x in got), key=repr) == want
    assert most is None or told.calls <= 2 * most


def test_an_arrival_of_many_files(spark, tmp_path, monkeypatch):
    """A part of the arrivals is several files and one micro-batch; equal ids leave some of them without rows."""
    monkeypatch.setattr(stream_queries, "ARRIVAL_ROWS", 10)
    r = random.Random(3)
    events = [(k if k % 3 else 0, r.randint(0, 4), at(r.randint(0, 5_000)), r.choice(["signup", "view"])) for k in range(300)]
    spark.createDataFrame(events, "event_id bigint, user_id bigint, ts timestamp, event_type string").coalesce(1).write.parquet(str(tmp_path / "t"))
    next((tmp_path / "t").glob("*.parquet")).rename(tmp_path / "events.parquet")
    want = sorted(map(tuple, QUERIES["t4_stream_marker_latency"].run(spark, str(tmp_path)).collect()))
    assert want and sorted(map(tuple, QUERIES["t4_shuffled_arrival"].run(spark, str(tmp_path)).collect())) == want
