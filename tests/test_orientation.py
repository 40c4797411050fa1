"""Earth orientation, nutation series and ellipsoids as parameters; attributes and names of variables."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe.functions import frames as C
from tideframe.functions import geodesy as G
from tideframe.operators import rules as R
from tideframe.sources import grids, text

US = np.array([1.4e15, 1.7e15])
LEAPS = np.array([35.0, 37.0])


def angle(m, n):
    """Of the rotation from one matrix to the other, in arcseconds."""
    r = m @ np.swapaxes(n, 1, 2)
    return np.degrees(np.arcsin(np.linalg.norm(np.stack([r[:, 2, 1] - r[:, 1, 2], r[:, 0, 2] - r[:, 2, 0], r[:, 1, 0] - r[:, 0, 1]]), axis=0) / 2)) * 3600


def test_orientation_moves_what_it_should():
    plain = C.matrices(US, LEAPS)
    zero = C.matrices(US, LEAPS, np.zeros((2, 5)))
    assert all(np.array_equal(plain[f], zero[f]) for f in C.FRAMES)
    later = C.matrices(US, LEAPS, np.array([[0.5, 0, 0, 0, 0]] * 2))
    assert np.allclose(angle(later["GEO"], plain["GEO"]), 0.5 * 15.041067, atol=2e-3) and np.array_equal(later["ECITOD"], plain["ECITOD"])
    pole = C.matrices(US, LEAPS, np.array([[0, 3.0, 4.0, 0, 0]] * 2))
    assert np.allclose(angle(pole["GEO"], plain["GEO"]), 5.0, atol=1e-3) and np.array_equal(pole["TEME"], plain["TEME"])
    moved = C.matrices(US, LEAPS, np.array([[0, 0, 0, 0, 2.0]] * 2))
    assert np.allclose(angle(moved["ECITOD"], plain["ECITOD"]), 2.0, atol=1e-3)


def test_nutation_series_from_a_file(spark, tmp_path):
    path = tmp_path / "terms.txt"
    path.write_text("# l l' F D node psi rate eps rate\n" + "\n".join(" ".join(map(str, row)) for row in C.NUTATION) + "\nend 1 2\n")
    terms = C.read_nutation(spark, str(path))
    assert np.array_equal(terms, C.NUTATION)
    few = C.nutation(np.array([0.14]), terms[:1])[0]
    assert 0 < abs(few[0] - C.nutation(np.array([0.14]))[0][0]) < 2.5  # the other terms are below 2.5 arcseconds together
    (tmp_path / "none.txt").write_text("nothing")
    with pytest.raises(ValueError):
        C.read_nutation(spark, str(tmp_path / "none.txt"))


def test_orientation_between_days_and_over_a_leap_second(spark):
    days = [dt.datetime(2016, 12, 31), dt.datetime(2017, 1, 1), dt.datetime(2017, 1, 2)]
    known = spark.createDataFrame([(t, x, 0.1 * k, 0.2, 0.0, 0.0) for k, (t, x) in enumerate(zip(days, (-0.408, 0.591, 0.590)))], "ts timestamp_ntz, dut1 double, xp double, yp double, dpsi double, deps double")
    asked = [dt.datetime(2016, 12, 31, 12), dt.datetime(2017, 1, 1, 12), dt.datetime(2016, 1, 1), dt.datetime(2018, 1, 1)]
    us = lambda t: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    times = spark.createDataFrame([(us(t),) for t in asked], "us long")
    got = {r["us"]: r for r in C.oriented(times, known).collect()}
    assert [round(got[us(t)]["dut1"], 6) for t in asked] == [-0.4085, 0.5905, -0.408, 0.59]
    assert [round(got[us(t)]["xp"], 6) for t in asked] == [0.05, 0.15, 0.0, 0.2]


def test_other_ellipsoids(spark):
    df = spark.createDataFrame([(3000.0, 4000.0, 5000.0)], "x double, y double, z double")
    r = G.geocentric_to_geodetic(df, "x", "y", "z", G.Ellipsoid(6000.0, 0.0)).first()
    assert r["lat"] == pytest.approx(45.0) and r["alt"] == pytest.approx(math.sqrt(5e7) - 6000)
    mars = G.Ellipsoid(3396.19, 1 / 169.8944)
    p = G.geodetic_to_geocentric(F.lit(30.0), F.lit(60.0), F.lit(12.5), mars)
    back = G.geocentric_to_geodetic(spark.range(1).select(*(c.alias(n) for n, c in zip("xyz", p))), "x", "y", "z", mars).first()
    assert (back["lat"], back["lon"], back["alt"]) == pytest.approx((30.0, 60.0, 12.5)) and mars.b == pytest.approx(3376.2, abs=0.01)


def test_attributes_columns_and_variables(spark):
    a = R.attributes("data", 3)
    assert (a["VAR_TYPE"], a["DISPLAY_TYPE"], a["DEPEND_0"], a["DEPEND_1"], a["DEPEND_2"], a["FILLVAL"]) == ("data", "spectrogram", "Epoch", "", "", -1e31) and "DEPEND_3" not in a
    t = R.attributes("support_data", type="tt2000")
    assert t["UNITS"] == "ns" and t["TIME_BASE"] == "J2000" and t["FILLVAL"] == -(2**63) and "DEPEND_0" not in t and "DISPLAY_TYPE" not in t
    c = R.attributes("metadata", fixed=True, type="char")
    assert c["FILLVAL"] == " " and "VALIDMIN" not in c and "DEPEND_0" not in c
    with pytest.raises(ValueError):
        R.attributes("other")
    assert R.missing_columns(spark.range(1).withColumn("Bx", F.lit(1)), ["id", "bx", "rho"]) == ["bx", "rho"]
    assert text.table_variables('VARIABLES = "X [R]" "Y [R]", "B_x [nT]" "status"') == ["X", "Y", "B_x", "status"]


def test_density_slices(spark, tmp_path):
    (tmp_path / "mlt.dat").write_text("Slice at MLT = 6.5\nL = 2.0 2.5\n2014 4 10 1 2 3 250 1.0E+01 2.0D0\n2014 4 10 1 3 3 0 5 6\n")
    (tmp_path / "l.dat").write_text("L 4.5\nMLT 0.0 6.0 12.0\n2014 4 11 0 0 0 0 1 2 3\n")
    rows = grids.read_density_slices(spark, [str(tmp_path / "mlt.dat"), str(tmp_path / "l.dat")]).collect()
    got = sorted((r["fixed"], r["time"], r["position"], r["density"]) for r in rows)
    day = dt.datetime(2014, 4, 11)
    assert got[:3] == [(4.5, day, 0.0, 1.0), (4.5, day, 6.0, 2.0), (4.5, day, 12.0, 3.0)]
    assert got[3:5] == [(6.5, dt.datetime(2014, 4, 10, 1, 2, 3, 250000), 2.0, 10.0), (6.5, dt.datetime(2014, 4, 10, 1, 2, 3, 250000), 2.5, 2.0)] and len(got) == 7
