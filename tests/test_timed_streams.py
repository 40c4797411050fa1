"""Streams with timers against their batch form, across restarts and rows that come out of order."""

import datetime as dt
import random

import pytest

from tideframe.streaming import timed as T

START = dt.datetime(2024, 1, 1)
SHAPE = "k int, ts timestamp, v double"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def refractory(times, period):
    out, last = [], None
    for t in sorted(times):
        if last is None or t > last + period:
            out.append(t)
            last = t
    return out


def gaps(times, most, idle):
    s = sorted(times)
    return [(a + b) / 2 for a, b in zip(s, s[1:]) if most < b - a <= idle]


@pytest.mark.parametrize("kind", ["refractory", "gaps"])
def test_restarted_stream_is_the_batch_form(spark, tmp_path, kind):
    rng = random.Random(7)
    rows = sorted((rng.randrange(0, 4000), rng.randrange(5)) for _ in range(300))
    rows = [(t + (3000 if t > 2500 else 0), k) for t, k in rows if k != 4 or t < 900]  # one key ends early, all rest for a while
    late = sorted(rows, key=lambda r: r[0] + rng.uniform(0, 50))  # out of order by less than the delay
    cuts = [0, 70, 71, 160, 230, len(late)]
    got, states = [], []
    for part, (low, high) in enumerate(zip(cuts, cuts[1:])):
        batch = [(k, at(t), 1.0) for t, k in late[low:high]]
        if part == len(cuts) - 2:
            batch.append((99, at(10**6), 0.0))  # time passes: all rows before are final
        spark.createDataFrame(batch + [(None, at(5), 0.0)], SHAPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SHAPE).parquet(str(tmp_path / "in"))
        out = T.refractory_in_order(stream, "ts", "k", 60_000_000, "100 seconds") if kind == "refractory" else T.gaps_in_order(stream, "ts", "k", 90_000_000, 1_000_000_000, "100 seconds")
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
        q.processAllAvailable()
        states.append(q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress else None)
        q.stop()
    by = {k: [t for t, x in rows if x == k] for k in range(5)}
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    for k, times in by.items():
        want = refractory(times, 60) if kind == "refractory" else gaps(times, 90, 1000)
        assert sorted((r[1] - START).total_seconds() for r in found if r[0] == k) == want and want
    assert {r[0] for r in found} <= set(range(5))
    assert max(s for s in states[:-1] if s is not None) > states[-1] and states[-1] <= 3  # what is left is the waiting row of the key that came last
