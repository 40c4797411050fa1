"""Streaming forms of the series operators: event time, watermarks and keyed state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.functions.timescales import DAY_US


def window_mean_stream(events: DataFrame, ts: str, value: str, width: str, hop: str, late: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Means of hopping windows, each emitted once the watermark has passed its end; rows that come later are dropped."""
    rows = events.withWatermark(ts, late)
    out = rows.groupBy(F.window(ts, width, hop), *keys).agg(F.avg(value).alias("value"), F.count("*").alias("n"))
    return out.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "value", "n")


def session_stream(events: DataFrame, ts: str, gap: str, late: str, keys: tuple[str, ...]) -> DataFrame:
    """Runs of events without a longer gap."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n")).select(*keys, "session_window.*", "n")


def distinct_stream(events: DataFrame, ts: str, late: str, keys: tuple[str, ...]) -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def refractory_stream(events: DataFrame, ts: str, key: str, period_us: int, late: str) -> DataFrame:
    """(key, time): events kept when later than the last kept one by more than the period, with the last kept one as state.

    Events of one key must arrive in order of time across batches; within a batch they are sorted. The state of a key goes
    once the watermark is a period past its last kept event. ``timed.refractory_in_order`` takes any order within the delay.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def keep(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        pdf = pd.concat(list(batches))
        chosen = []
        for t in sorted(pdf[ts]):
            us = t.value // 1000
            if last is None or us > last + period_us:
                chosen.append(t)
                last = us
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max((last + period_us) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({key: [k[0]] * len(chosen), "time": pd.Series(chosen, dtype="datetime64[ns]")})

    kind = dict(events.dtypes)[key]
    rows = events.withWatermark(ts, late).select(key, ts).groupBy(key)
    return rows.applyInPandasWithState(keep, f"{key} {kind}, time timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def gap_stream(events: DataFrame, ts: str, key: str, most_us: int, late: str, idle_us: int = 30 * DAY_US) -> DataFrame:
    """(key, middle): a row amid each step longer than the limit, with each key's last time as state.

    The state of a key without events goes ``idle_us`` after its last one; later events begin a new series.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def gaps(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(pd.concat(list(batches))[ts]):
            us = t.value // 1000
            if last is not None and us - last > most_us:
                out.append(pd.Timestamp((last + us) // 2, unit="us"))
            last = us if last is None else max(last, us)
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max((last + idle_us) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({key: [k[0]] * len(out), "middle": pd.Series(out, dtype="datetime64[ns]")})

    kind = dict(events.dtypes)[key]
    rows = events.withWatermark(ts, late).select(key, ts).groupBy(key)
    return rows.applyInPandasWithState(gaps, f"{key} {kind}, middle timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)
