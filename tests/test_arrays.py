"""Hyperslices of stored arrays against NumPy's own indexing."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pytest

from tideframe.sources import arrays as A

S = slice
KEYS = [..., 3, -1, S(None), S(2, 9), S(None, None, -1), S(20, 2, -3), S(None, None, 7), (S(1, None, 2), 0), (2, S(None, None, -2), ...), (..., -1), (S(5, 5),), (1, 2, 3), (S(-4, None), ..., S(3, None, -1)), (S(None, None, 11), S(1, 4, 2), S(4, 1, -2)), (S(30, 40), ...)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    a = np.random.default_rng(0).normal(size=(23, 5, 6))
    path = f"file://{tmp_path_factory.mktemp('arrays')}/a"
    cells = [(*map(int, i), float(a[tuple(i)])) for i in np.ndindex(a.shape)]
    A.write_array(spark.createDataFrame(cells, "i0 long, i1 long, i2 long, value double").repartition(7), path, (4, 3, 2))
    return a, path


@pytest.mark.parametrize("key", KEYS, ids=str)
def test_like_numpy(spark, stored, key):
    a, path = stored
    want = np.asarray(a[key])
    df = A.hyperslice(spark, path, key)
    assert df.columns == [*(f"i{d}" for d in range(want.ndim)), "value"]
    assert {tuple(r[:-1]): r[-1] for r in df.collect()} == {i: want[i] for i in np.ndindex(want.shape)}


def test_only_touched_chunks_are_read(spark, stored):
    _, path = stored
    df = A.hyperslice(spark, path, (S(None, None, 12), 4))
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = next(x for x in plan.splitlines() if "PushedFilters" in x)
    assert "c0" in pushed and "c1" in pushed
    chunks = spark.read.parquet(path)
    from pyspark.sql import functions as F

    assert chunks.where(A._touched(F.col("c0"), A.selection(S(None, None, 12), (23,))[0], 4)).select("c0").distinct().count() == 2
    many = A.Along(3, 1000, 400)
    spread = spark.range(120000).where(A._touched(F.col("id"), many, 4)).collect()
    assert sorted(r["id"] for r in spread) == sorted({(3 + 1000 * k) // 4 for k in range(400)})


def test_holes_ends_and_errors(spark, stored, tmp_path):
    path = f"file://{tmp_path}/h"
    A.write_array(spark.createDataFrame([(0, 1.0), (5, 6.0), (6, None)], "i0 long, value double"), path, (3,))
    assert {r["i0"]: r["value"] for r in A.hyperslice(spark, path, ...).collect()} == {0: 1.0, 1: None, 2: None, 3: None, 4: None, 5: 6.0, 6: None}
    empty = f"file://{tmp_path}/e"
    A.write_array(spark.createDataFrame([], "i0 long, i1 long, value double"), empty, (3, 2))
    assert A.hyperslice(spark, empty, 4).count() == 0
    for key in (23, -24, (0, 0, 0, 0), (..., ...)):
        with pytest.raises(IndexError):
            A.hyperslice(spark, stored[1], key)


def test_fitting_types(spark):
    df = spark.createDataFrame(
        [(1, -3, 70000, 2**40, 1.5, 1e200, 2.0, "é", dt.datetime(2024, 1, 1, 0, 0, 0, 5000), dt.datetime(2024, 1, 1, 0, 0, 0, 7), Decimal("1.25"), None, True), (200, 5, 1, 0, 0.0, 0.0, 3.0, "abc", None, None, None, None, None)],
        "a int, b int, c int, d long, e double, f double, g double, h string, i timestamp, j timestamp, k decimal(5,2), l int, m boolean",
    )
    got = A.fitting_types(df)
    reals = ["FLOAT", "DOUBLE"]
    assert got["a"][0] == ["UINT1", "INT2", "UINT2", "INT4", "UINT4", "INT8", *reals] and got["b"][0] == ["INT1", "INT2", "INT4", "INT8", *reals]
    assert got["c"][0][0] == "INT4" and got["d"][0] == ["INT8", *reals] and got["e"][0] == reals and got["f"][0] == ["DOUBLE"] and got["g"][0][0] == "INT1"
    assert got["h"] == (["CHAR", "UCHAR"], 3) and got["i"][0] == ["TIME_TT2000", "EPOCH", "EPOCH16"] and got["j"][0] == ["TIME_TT2000", "EPOCH16", "EPOCH"]
    assert got["k"][0] == reals and got["l"][0][0] == "INT1" and "m" not in got
