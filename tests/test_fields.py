"""Fields, array reductions, rules and intervals against known values."""

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from tideframe.functions import empirical as E
from tideframe.functions import plasma as P
from tideframe.operators import bundles as B
from tideframe.operators import fields as D
from tideframe.operators import matching as M
from tideframe.operators import rules as R
from tideframe.operators import series as S
from tideframe.operators import shape as H


def _one(spark, *columns):
    return spark.range(1).select(*columns).first()


def _array(*values):
    return F.array(*(F.lit(v) for v in values))


def test_derivatives_of_a_parabola(spark):
    """Three-point differences are exact for polynomials of second degree, at the ends too."""
    rows = [(b, x, y, float(x * x + 2 * x * y + b), float(3 * y * y - x)) for b in range(2) for x in range(5) for y in range(4)]
    df = spark.createDataFrame(rows, "b int, x int, y int, u double, v double")
    out = D.with_derivatives(df, ("u", "v"), "x", "y", 1.0, ("b",)).collect()
    for r in out:
        assert np.allclose([r["du_dx"], r["du_dy"], r["dv_dx"], r["dv_dy"]], [2 * r["x"] + 2 * r["y"], 2 * r["x"], -1, 6 * r["y"]])
    assert all(abs(r["curl"] - (2 * r["x"] + 1)) < 1e-9 for r in D.curl(df, "u", "v", "x", "y", 1.0, ("b",), scale=1.0).collect())
    assert D.curl(df.limit(0), "u", "v", "x", "y", 1.0, ("b",)).isEmpty()


def test_simpson(spark):
    for x in ([0.0, 1.0, 3.0, 4.0, 7.0], [0.0, 1.0, 3.0, 4.0], [0.0, 2.0], [1.0]):
        y = [2 * a * a - a + 1 for a in x]
        got = _one(spark, B.simpson(_array(*y), _array(*x)).alias("s"))["s"]
        exact = sum(c * (x[-1] ** k - x[0] ** k) / k for k, c in ((3, 2), (2, -1), (1, 1)))
        assert abs(got - (exact if len(x) > 2 else (x[-1] - x[0]) * (y[0] + y[-1]) / 2)) < 1e-9
    pa = [2.0 * k for k in range(91)]
    flux = F.transform(_array(*pa), lambda a: E.sine_flux(F.lit(3000.0), a, F.lit(4.0)))
    r = _one(spark, B.omni_flux(flux, _array(*pa), False).alias("a"), B.omni_flux(flux, _array(*pa)).alias("b"), B.omni_flux(_array(7.0), _array(90.0)).alias("c"))
    assert abs(r["a"] - 3000.0) < 1e-4 and abs(r["b"] - 238.73241) < 1e-4 and r["c"] == 7.0


def test_log_gamma(spark):
    for x in (0.5, 1.0, 2.5, 30.25):
        assert abs(_one(spark, E.log_gamma(F.lit(x)).alias("g"))["g"] - math.lgamma(x)) < 1e-10


def test_reductions(spark):
    values = B.valid_only(_array(1.0, -1e31, 4.0), -1e31)
    r = _one(spark, B.total(values).alias("a"), B.mean(values).alias("b"), B.total(_array(1.0, 2.0)).alias("c"), B.mean(B.valid_only(_array(-1e31), -1e31)).alias("d"), B.total_uncertainty(_array(3.0, 4.0)).alias("e"), B.mean_uncertainty(_array(3.0, 4.0)).alias("f"))
    assert tuple(r) == (None, 2.5, 3.0, None, 5.0, 2.5)
    r = _one(spark, B.sliced(_array(1, 2, 3, 4, 5), 1, -1, 2).alias("a"), B.sliced(_array(1, 2, 3), -2).alias("b"), B.placed(_array(10, 20, 30), _array(1, 2), _array(1, 2, 4)).alias("c"), B.array_bins(_array(*range(10)), [4.2]).alias("d"), B.array_bins(_array(1, 2), [0.0, 9.0]).alias("e"))
    assert r["a"] == [2, 4] and r["b"] == [2, 3] and r["c"] == [1, 10, 20, 2, 30] and r["d"] == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9]] and r["e"] == [[], [0, 1], []]


def test_catalogue_rules(spark):
    rows = [
        ("flux", "TYPE", "double"), ("flux", "FILLVAL", "-1e31"), ("flux", "UNITS", "cm"), ("flux", "SHAPE", "80,48"), ("flux", "RECORDS", "10"), ("flux", "DEPEND_0", "Epoch"), ("flux", "DEPEND_1", "look"), ("flux", "DEPEND_2", "energy"),
        ("flux", "DELTA_PLUS_VAR", "err"), ("flux", "DISPLAY_TYPE", "time_series"), ("err", "TYPE", "float"), ("err", "FILLVAL", "-1e31"), ("err", "UNITS", "m"), ("err", "SHAPE", "80,48"), ("err", "RECORDS", "9"),
        ("Epoch", "SHAPE", ""), ("Epoch", "RECORDS", "11"), ("Epoch", "DISPLAY_TYPE", "time_series"), ("look", "SHAPE", "70"), ("energy", "SHAPE", "80,48"), ("energy", "DEPEND_1", "angle"), ("angle", "SHAPE", "80"),
    ]
    cat = spark.createDataFrame(rows, "variable string, attr string, value string")
    found = sorted((r["variable"], r["rule"], r["message"]) for r in R.all_checks(cat).collect())
    assert [f for f in found if f[1] == "deltas"] == [("flux", "deltas", f"DELTA_PLUS_VAR err differs in {k}") for k in ("RECORDS", "TYPE", "UNITS")]
    assert [f for f in found if f[1] == "recordcount"] == [("flux", "recordcount", "10 records but 11 of Epoch")]
    assert [f[2] for f in found if f[1] == "depsize"] == ["dimension 1 has 80 but energy 48"] or [f[2] for f in found if f[1] == "depsize"] == ["dimension 1 has 80 but look 70"]
    assert [f[0] for f in found if f[1] == "validdisplaytype"] == ["flux"]
    files = spark.createDataFrame([("/a/sat_x_20240101.cdf", "sat_x", "sat_x_20240101"), ("/a/other.cdf", "sat_x", None)], "path string, logical_source string, logical_file_id string")
    assert sorted(r["message"] for r in R.wrong_file_names(files).collect()) == ["Logical_source isn't the start of other.cdf", "no Logical_file_id"]


def test_numbers_and_times(spark):
    df = spark.createDataFrame([(k * 37 % 101,) for k in range(101)], "v long")
    assert all(r["v"] == r["row"] for r in S.row_numbers(df, ["v"], F.floor(F.col("v") / 10)).collect())
    assert S.row_numbers(df.limit(0), ["v"], F.col("v")).isEmpty()
    ts = [r["ts"] for r in H.random_times(spark, "2024-01-01", "2024-01-02", 50, 7).collect()]
    assert len(set(ts)) == 50 and all(dt.datetime(2024, 1, 1) <= t < dt.datetime(2024, 1, 2) for t in ts)
    assert ts == [r["ts"] for r in H.random_times(spark, "2024-01-01", "2024-01-02", 50, 7).collect()]
    assert H.tick_range(spark, "2024-01-02", "2024-01-01", 1000).isEmpty()


def test_field_line(spark):
    line = _one(spark, P.field_line(F.lit(3.0), F.lit(4.0), 40).alias("p"))["p"]
    size = 5 * 25 / 9
    assert len(line) == 40 and all(abs(math.hypot(*p) - size * math.sin(k * math.pi / 40) ** 2) < 1e-9 for k, p in enumerate(line))


def test_resampled_associations_hold_the_total(spark):
    start = dt.datetime(2024, 1, 1)
    a = spark.createDataFrame([(k, start + dt.timedelta(minutes=10 * k)) for k in range(60)], "id int, ts timestamp_ntz")
    out = M.association_interval(a, a, "ts", ["id"], [0, 600_000_000, 10**12], 60_000_000, 100).orderBy("lag_us").collect()
    assert [r["total"] for r in out] == [60, 59, 0] and out[0]["low"] == out[0]["high"] == 60 and out[1]["low"] <= 59 <= out[1]["high"] and out[2]["high"] == 0
