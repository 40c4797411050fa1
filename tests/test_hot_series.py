"""Series operators on one hot key, many equal times and an outlier, against plain versions; no Python worker in their plans."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe.operators import matching as M
from tideframe.operators import series as S
from tideframe.operators import statistics as Q

START = dt.datetime(2024, 1, 1)


def events(spark, times):
    return spark.createDataFrame([(i, k, START + dt.timedelta(seconds=t)) for i, (k, t) in enumerate(times)], "i long, k string, ts timestamp_ntz")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bucket_us", [10**15, 500_000_000])
def test_refractory_without_gaps(spark, bucket_us):
    """A hot key without any gap longer than the period: one run of all its events; ties and other keys beside it."""
    rng = random.Random(1)
    times = [("hot", t) for t in range(0, 6000, 3)] + [("hot", 300)] * 40 + [(f"k{rng.randrange(20)}", rng.randrange(6000)) for _ in range(500)] + [("one", 5)]
    df = events(spark, times)
    out = S.refractory(df, "ts", 20_000_000, ("k",), bucket_us)
    assert "Python" not in plan_of(out) and "Pandas" not in plan_of(out)
    want = []
    for key in {k for k, _ in times}:
        last = None
        for i, t in sorted(((i, t) for i, (k, t) in enumerate(times) if k == key), key=lambda x: (x[1], x[0])):
            if last is None or t > last + 20:
                want.append(i)
                last = t
    assert sorted(r["i"] for r in out.collect()) == sorted(want)
    assert S.refractory(df.limit(0), "ts", 1, ("k",)).count() == 0


def test_association_of_bursts(spark):
    """Thousands of events at the same moments: counts by numbers, without pairs."""
    a = [0] * 3000 + [100, 200, 300] * 5
    b = [1] * 4000 + [99, 160, 250, 260]
    first, second = events(spark, [("a", t) for t in a]), events(spark, [("b", t) for t in b])
    lags = [-100_000_000, 0, 60_000_000]
    got = {r["lag_us"]: r["total"] for r in M.association(first, second, "ts", lags, 10_000_000).collect()}
    assert got == {lag: sum(abs(y - x - lag / 1e6) <= 10 for x in a for y in set(b) for _ in range(b.count(y))) for lag in lags}


@pytest.mark.parametrize("limit", [50, 10**6])
def test_quantiles_beside_an_outlier(spark, limit):
    """Values bunched in a billionth of their range, many of them equal, and a hot key: intervals are cut until they are small."""
    rng = np.random.default_rng(0)
    rows = [("hot", float(x)) for x in rng.normal(0, 1e-6, 3000)] + [("hot", 0.25)] * 900 + [("hot", 1e300), ("hot", -1e300)] + [("b", float(x)) for x in range(7)] + [("c", 4.0), ("d", None), ("d", float("nan")), ("e", 5.0), ("e", 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    wanted = {"a": 0.0, "q": 0.3, "m": 0.5, "n": 0.9, "z": 1.0}
    got = {r["k"]: [r[n] for n in wanted] for r in Q.quantiles(df, "v", wanted, ("k",), buckets=16, limit=limit).collect()}
    for k in "hot", "b", "c", "e":
        assert got.pop(k) == pytest.approx([np.quantile([v for x, v in rows if x == k], q) for q in wanted.values()], rel=1e-12), k
    assert got == {}
    whole = Q.quantiles(df, "v", {"m": 0.5}, limit=limit).collect()
    assert [r["m"] for r in whole] == [statistics.median(v for _, v in rows if v is not None and v == v)]
    assert Q.quantiles(df.limit(0), "v", {"m": 0.5}, ("k",)).count() == 0


def test_gaps_in_buckets(spark):
    times = [("a", t) for t in (0, 10, 20, 30, 90, 100)] + [("b", 5)]
    df = events(spark, times).withColumn("v", F.col("i").cast("double"))
    got = sorted((r["k"], (r["ts"] - START).total_seconds(), r["v"]) for r in S.gap_fill(df, "ts", "v", ("k",), bucket_us=25_000_000).collect() if r["v"] is None)
    assert got == [("a", 60.0, None)]
