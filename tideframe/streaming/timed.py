"""Keyed streams in order of event time, with timers: rows wait until the watermark has passed them, and state of idle keys goes.

Rows of a key may come in any order within the watermark's delay. They wait in list state; a timer at the earliest of them
fires once no row before it can come any more, and then all that are final are taken in order of time. So a stream gives the
same rows as the batch form over the same events, whatever batches and restarts cut it, but for rows later than the watermark,
which Spark drops. When nothing waits, a timer at the last row's time plus ``idle`` removes what is kept of the key.

State needs the RocksDB provider, which the functions set for the session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: From the kept time (None at first) and the next one, in microseconds: the time to keep and the times to emit.
Step = Callable[[int | None, int], tuple[int, list[int]]]


class InOrder(StatefulProcessor):
    """Applies ``step`` to the times of a key in their order; ``out`` names the emitted time's column."""

    def __init__(self, key: str, ts: str, out: str, step: Step, idle_us: int):
        self.key, self.ts, self.out, self.step, self.idle_us = key, ts, out, step, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long")
        self.kept = handle.getValueState("kept", "us long, seen long")

    def _wake(self, us: int) -> None:
        """One timer a key, at the first millisecond at or after ``us``."""
        at = -(-us // 1000)
        others = list(self.handle.listTimers())
        if any(t <= at for t in others):
            return
        for t in others:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = [t.value // 1000 for pdf in rows for t in pdf[self.ts] if not pd.isna(t)]
        if times:
            self.waiting.appendList([(us,) for us in times])
            self._wake(min(times))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(row[0] for row in self.waiting.get())
        due = [us for us in waiting if us <= now]
        last, seen = self.kept.get() if self.kept.exists() else (None, None)
        if last is not None and due and due[0] - seen > self.idle_us:
            last = None  # as if the timer that removes it had come between
        out = []
        for us in due:
            if seen is not None and us - seen > self.idle_us:
                last = None
            last, emitted = self.step(last, us)
            seen = us
            out += emitted
        rest = waiting[len(due) :]
        if rest:
            self.waiting.put([(us,) for us in rest])
            self._wake(rest[0])
        else:
            self.waiting.clear()
        if seen is not None and (rest or seen + self.idle_us > now):
            self.kept.update((last, seen))
            if not rest:
                self._wake(seen + self.idle_us)
        else:
            self.kept.clear()
        yield pd.DataFrame({self.key: [key[0]] * len(out), self.out: pd.to_datetime(pd.Series(out, dtype="int64"), unit="us").astype("datetime64[ns]")})

    def close(self) -> None:
        pass


def _timed(events: DataFrame, ts: str, key: str, late: str, out: str, step: Step, idle_us: int) -> DataFrame:
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = events.where(events[key].isNotNull()).withWatermark(ts, late).select(key, ts).groupBy(key)
    kind = dict(events.dtypes)[key]
    return rows.transformWithStateInPandas(InOrder(key, ts, out, step, idle_us), f"{key} {kind}, {out} timestamp", "append", "EventTime")


def refractory_in_order(events: DataFrame, ts: str, key: str, period_us: int, late: str) -> DataFrame:
    """(key, time): events later than the last kept one by more than the period. Keys idle for a period have no state left."""

    def step(last: int | None, us: int) -> tuple[int, list[int]]:
        return (last, []) if last is not None and us <= last + period_us else (us, [us])

    return _timed(events, ts, key, late, "time", step, period_us)


def gaps_in_order(events: DataFrame, ts: str, key: str, most_us: int, idle_us: int, late: str) -> DataFrame:
    """(key, middle): a row amid each step longer than ``most_us``; after ``idle_us`` without events a key's series begins anew."""

    def step(last: int | None, us: int) -> tuple[int, list[int]]:
        return us, [(last + us) // 2] if last is not None and us - last > most_us else []

    return _timed(events, ts, key, late, "middle", step, idle_us)
