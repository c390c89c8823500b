"""Live gaps between a run's "finished" and next "start" marker."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shardframe.streaming.rates import WATERMARK

OUTPUT = "run_id string, finished timestamp, started timestamp, gap double"


FLUSH_ROWS = 50_000
#: Markers of a run that lie in one page of its state.
PAGE_MARKS = 8192


def pair(finished: int | None, micros: np.ndarray, started: np.ndarray, timeout: int) -> tuple[list[tuple[int, int | None]], int | None]:
    """Gaps ``(finished, started)`` that markers in time order close or outlast, and the time that stays open.

    A gap older than ``timeout`` when the next marker comes is given without a start.
    """
    found = []
    at, n = 0, len(micros)
    while at < n:
        if finished is None:
            # On to the next "finished".
            step = np.flatnonzero(~started[at : at + FLUSH_ROWS])
            if not len(step):
                at += FLUSH_ROWS
                continue
            at += int(step[0])
            finished = int(micros[at])
            at += 1
            continue
        # On to the first marker past the timeout, or the first later start.
        run = slice(at, at + FLUSH_ROWS)
        late = micros[run] - finished > timeout
        step = np.flatnonzero(late | (started[run] & (micros[run] > finished)))
        if not len(step):
            at += FLUSH_ROWS
            continue
        at += int(step[0])
        if micros[at] - finished > timeout:
            found.append((finished, None))
        else:
            found.append((finished, int(micros[at])))
            at += 1
        finished = None
    return found, finished


class GapProcessor(StatefulProcessor):
    """Pairs a run's markers in the order of their times, whatever the order of their arrival within the watermark's delay.

    Markers wait in the state until the watermark has passed them; nothing earlier can come then. They lie in pages of ``PAGE_MARKS`` at most, each a
    span of time, so memory follows a page and not the micro-batch, and a run of few markers is one page: a call to the state costs more than
    pairing hundreds of markers. A timer at the earliest marker that waits wakes the run, and the pages that are passed are paired one after the other.
    Repeated markers of one time are one. What is given doesn't depend on how rows fall into batches.
    """

    def __init__(self, timeout_ms: int, page_marks: int = PAGE_MARKS):
        self.timeout_ms, self.page_marks = timeout_ms, page_marks

    def init(self, handle: StatefulProcessorHandle) -> None:
        """Declare the run: its open time in microseconds, its timer and where its pages begin; and the pages: times * 2 + (1 for a start)."""
        self.handle = handle
        self.run = handle.getValueState("run", "finished bigint, wake bigint, begins binary")
        self.pages = handle.getMapState("pages", "begin bigint", "marks binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Put the markers of one run into their pages."""
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        known, first = None, None
        for frame in rows:
            marks = np.unique(frame["micros"].to_numpy(np.int64) * 2 + frame["started"].to_numpy(bool))
            marks = marks[marks >> 1 > passed]  # what lies behind has been paired without them
            if not len(marks):
                continue
            if known is None:
                known = finished, wake, begins = self._load()
            begins = self._add(begins, marks)
            first = int(marks[0]) if first is None else min(first, int(marks[0]))
        if known is not None:
            at = (first >> 1) // 1000 - 1
            if wake is None or at < wake:
                if wake is not None:
                    self.handle.deleteTimer(wake)
                self.handle.registerTimer(at)
                wake = at
            self._save(finished, wake, begins)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Pair what the watermark has passed; a gap that it has outlasted is given without a start."""
        watermark = timerValues.getCurrentWatermarkInMs()
        passed = watermark * 1000
        finished, last, begins = self._load()
        wake, done, held = None, 0, []
        for begin in begins.tolist():
            marks = self._marks(begin)
            n = int(np.searchsorted(marks >> 1, passed, "right"))
            if n:
                found, finished = pair(finished, marks[:n] >> 1, (marks[:n] & 1).astype(bool), self.timeout_ms * 1000)
                held += [(key[0], f, s) for f, s in found]
                if len(held) >= FLUSH_ROWS:
                    yield self._rows(held)
                    held = []
            if n < len(marks):
                if n:
                    self.pages.updateValue((begin,), (marks[n:].tobytes(),))
                wake = max(int(marks[n] >> 1) // 1000 - 1, watermark)
                break
            self.pages.removeKey((begin,))
            done += 1
        if finished is not None and finished // 1000 + self.timeout_ms <= watermark:
            held.append((key[0], finished, None))
            finished = None
        if held:
            yield self._rows(held)
        if finished is not None:
            end = finished // 1000 + self.timeout_ms - 1
            wake = max(end if wake is None else min(wake, end), watermark)
        expired = expiredTimerInfo.getExpiryTimeInMs()
        if last is not None and last != expired:
            self.handle.deleteTimer(last)
        if wake is not None:
            self.handle.registerTimer(wake)
        self._save(finished, wake, begins[done:])

    def _load(self) -> tuple[int | None, int | None, np.ndarray]:
        finished, wake, begins = self.run.get() or (None, None, b"")
        return finished, wake, np.frombuffer(begins, np.int64)

    def _save(self, finished: int | None, wake: int | None, begins: np.ndarray) -> None:
        if finished is None and wake is None and not len(begins):
            self.run.clear()
        else:
            self.run.update((finished, wake, begins.tobytes()))

    def _marks(self, begin: int) -> np.ndarray:
        found = self.pages.getValue((begin,))
        return np.frombuffer(found[0], np.int64) if found else np.zeros(0, np.int64)

    def _add(self, begins: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Put sorted marks into the pages, the first of which takes all that is earlier; where the pages begin then."""
        if not len(begins):
            begins = marks[:1].copy()
        edges = np.r_[0, np.searchsorted(marks, begins[1:]), len(marks)]
        new = [begins]
        for begin, a, b in zip(begins.tolist(), edges, edges[1:]):
            if a == b:
                continue
            merged = np.union1d(self._marks(begin), marks[a:b])
            # A full page is cut; its first part keeps the name.
            for at in range(0, len(merged), self.page_marks):
                name = begin if at == 0 else int(merged[at])
                self.pages.updateValue((name,), (merged[at : at + self.page_marks].tobytes(),))
                if at:
                    new.append(merged[at : at + 1])
        return np.sort(np.concatenate(new))

    @staticmethod
    def _rows(found: list[tuple]) -> pd.DataFrame:
        run, finished, started = zip(*found)
        times = [np.array([np.datetime64("NaT") if t is None else np.datetime64(t, "us") for t in column], "datetime64[us]") for column in (finished, started)]
        gap = [None if s is None else (s - f) / 1e6 for _, f, s in found]
        return pd.DataFrame({"run_id": run, "finished": times[0], "started": times[1], "gap": gap})

    def close(self) -> None:
        """Nothing to release."""


def stream_marker_latency(events: DataFrame, timeout: str = "1 day", watermark: str = WATERMARK) -> DataFrame:
    """``(run_id, finished, started, gap)`` in seconds from ``events(run_id, ts, started)``.

    ``started`` is false for a "finished" marker. Markers are paired in the order of their times, once the watermark has passed them: the gaps are
    the same for every order of arrival within the watermark's delay and every cut into batches, and the markers of the last ``watermark`` wait.
    A gap open for longer than ``timeout`` of event time is emitted without a start, when a later marker of the run or the watermark passes it; a
    later start does not close it. Rows behind the watermark are dropped. Needs the RocksDB state store.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    rows = timed.select("run_id", "ts", F.unix_micros("ts").alias("micros"), "started")
    timeout_ms = int(pd.Timedelta(timeout).total_seconds() * 1000)
    return rows.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=GapProcessor(timeout_ms), outputStructType=OUTPUT, outputMode="append", timeMode="eventTime"
    )
