"""Frames, geodesy, solvers and models against known values."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe.functions import empirical as E
from tideframe.functions import frames as C
from tideframe.functions import geodesy as G
from tideframe.functions import plasma as P
from tideframe.functions import timescales as T
from tideframe.functions import vectors as V
from tideframe.operators import iterative as I
from tideframe.operators import rules as R
from tideframe.operators import series as S

WHEN = dt.datetime(2014, 8, 29, 15, 32, 13, 811285)


def _one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_frames_known_values(spark):
    us = np.array([(WHEN - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)], float)
    m = C.matrices(us, np.array([35.0]))
    for name in C.FRAMES:
        assert np.allclose(m[name][0] @ m[name][0].T, np.eye(3), atol=1e-12) and abs(np.linalg.det(m[name][0]) - 1) < 1e-12
    geo = m["GEO"][0] @ m["ECI2000"][0].T
    assert np.allclose(geo, [[-0.86046014, -0.50951631, 0.00121589], [0.50951573, -0.86046100, -0.00076888], [0.00143798, -0.00004207, 0.99999897]], atol=5e-5)
    gse = m["GSE"][0] @ m["GSM"][0].T @ [-6.6, 3.4, -2.3]
    assert np.allclose(gse, [-6.6, 4.05437055, -0.64193415], atol=2e-3)


def test_frames_round_trip(spark):
    rows = [(k, WHEN + dt.timedelta(hours=k % 3), 1.0 + k, -2.0, 0.5 * k) for k in range(20)]
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz, x double, y double, z double")
    there = C.convert(df, "ts", ("x", "y", "z"), "GEO", "SM")
    back = C.convert(there, "ts", ("x", "y", "z"), "SM", "SPH").orderBy("id").collect()
    assert all(np.allclose(r[2:], e[2:], atol=1e-9) for r, e in zip(back, rows, strict=True))
    assert C.rotations(df, "ts", "GEO", "GSM").count() == 3
    with pytest.raises(ValueError):
        C.rotations(df, "ts", "GEO", "NOWHERE")


def test_dipole_and_kepler():
    axis, moment = C.dipole(np.array([2000.0, 2020.0]))
    assert np.allclose(moment, [30119.6, 29805.9], atol=1) and axis[0, 2] > 0.98
    e = C.kepler(np.array([1.0]), np.array([0.3]))
    assert abs(e[0] - 0.3 * math.sin(e[0]) - 1.0) < 1e-8
    assert abs(math.degrees(C.sidereal_time(np.array([2451545.0]))[0]) - 280.46062) < 1e-4


def test_geodesy(spark):
    df = spark.createDataFrame([(6378.137, 0.0, 0.0), (0.0, 0.0, G.B), (0.0, 0.0, -7000.0)], "x double, y double, z double")
    out = G.geocentric_to_geodetic(df, "x", "y", "z").collect()
    assert np.allclose([r["lat"] for r in out], [0, 90, -90], atol=1e-9) and np.allclose([r["alt"] for r in out], [0, 0, 7000 - G.B], atol=1e-6)
    x, y, z = G.radial_to_geocentric(F.lit(7000.0), F.lit(30.0), F.lit(40.0))
    row = spark.range(1).select(x.alias("x"), y.alias("y"), z.alias("z"))
    back = G.geocentric_to_radial(row, "x", "y", "z").first()
    assert np.allclose([back["radius"], back["lat"], back["lon"]], [7000, 30, 40], atol=1e-7)


def test_time_values(spark):
    rows = spark.createDataFrame([(dt.datetime(2002, 2, 2, 12),), (dt.datetime(2009, 1, 1),), (dt.datetime(2016, 12, 31, 23, 59, 59),)], "ts timestamp_ntz").withColumn("us", T.utc_us(F.col("ts")))
    us = F.col("us")
    r = rows.select(T.leap_seconds(us), T.gps_seconds(us), T.modified_julian_date(us), T.ordinal_day(us), T.julian_date(us)).collect()
    assert tuple(r[0]) == (32, 696686413.0, 52307.5, 730883.5, 2452308.0)
    assert abs(r[1][2] - 54832.00000579) < 1e-8 and r[2][0] == 36
    leap = spark.range(3).select(((F.lit(T.LEAP_US[-1]) + (T.TAI_1970 + 36) * 1_000_000) + F.col("id") * 500_000).alias("tai")).select(T.utc_us_of_tai(F.col("tai"))).collect()
    assert [x[0] - T.LEAP_US[-1] for x in leap] == [-1, -1, 0]  # inside the leap second UTC stands at its last microsecond


def test_quaternions(spark):
    h = math.sqrt(0.5)
    q = tuple(F.lit(x) for x in (0.0, 0.0, h, h))
    r = _one(spark, *(c.alias(n) for c, n in zip(V.quat_rotate(q, (F.lit(1.0), F.lit(0.0), F.lit(0.0))), "xyz", strict=True)), V.quat_to_matrix(q).alias("m"))
    assert np.allclose(r[:3], [0, 1, 0]) and np.allclose(r["m"], [[0, -1, 0], [1, 0, 0], [0, 0, 1]])
    m = [[F.lit(float(x)) for x in row] for row in r["m"]]
    assert np.allclose(_one(spark, *(c.alias(n) for c, n in zip(V.quat_from_matrix(m), "xyzw", strict=True))), [0, 0, h, h])
    zero = tuple(F.lit(0.0) for _ in range(4))
    assert list(_one(spark, *(c.alias(n) for c, n in zip(V.quat_normalize(zero), "xyzw", strict=True)))) == [0, 0, 0, 1]


def test_models(spark):
    r = _one(spark, E.plasmapause_l(F.lit(3.0)).alias("a"), E.vampola_order(F.lit(3.1)).alias("b"), E.vampola_order(F.lit(9.0)).alias("c"), P.saturation_density(F.lit(4.0)).alias("d"), P.plasma_beta(F.lit(1.0), F.lit(0.0)).alias("e"), P.dipole_strength(F.lit(1.0), F.lit(0.0)).alias("f"))
    assert abs(r["a"] - (5.39 - 0.382 * 3)) < 1e-12 and abs(r["b"] - (5.38 + 0.4 * (5.078 - 5.38))) < 1e-12 and r["c"] == 0.852
    assert abs(r["d"] - 10 ** (-0.3145 * 4 + 3.9043)) < 1e-9 and r["e"] == -1.0 and r["f"] == 30400
    h, he, o = P.composition(F.lit(5.0), F.lit(150.0))
    shares = _one(spark, h.alias("a"), he.alias("b"), o.alias("c"))
    assert abs(sum(shares) - 1) < 1e-12
    df = P.densities(spark.createDataFrame([(2.0, 16.0)], "HpRho double, OpRho double".replace("Rho", "rho")))
    assert df.first()["N"] == 3.0


def test_streamlines(spark):
    x = np.linspace(-5, 5, 51)
    gx, gy = np.meshgrid(x, x)
    seeds = spark.createDataFrame([(1, 2.0, 0.0), (2, 0.0, 3.0)], "seed long, x double, y double")
    out = I.streamlines(seeds, x, x, -gy, gx, steps=400, ds=0.1).toPandas()
    assert set(out.seed) == {1, 2}
    for seed, r in ((1, 2.0), (2, 3.0)):
        assert np.allclose(np.hypot(out[out.seed == seed].x, out[out.seed == seed].y), r, atol=1e-2)
    euler = I.streamlines(seeds, x, x, np.ones_like(gx), np.zeros_like(gx), steps=5000, ds=0.1, method="euler").toPandas()
    assert euler.x.max() <= 5 and np.allclose(euler[euler.seed == 2].y, 3.0)


def test_diffusion_and_ensembles(spark):
    grid = np.linspace(3, 6, 31)
    runs = spark.createDataFrame([(k, float(l), float(l - 3)) for k in (0, 1) for l in grid], "run long, l double, psd double")
    kp = spark.createDataFrame([(k, s, 2.0 + k) for k in (0, 1) for s in range(5)], "run long, step int, kp double")
    out = I.radial_diffusion(runs, kp, 0.1).toPandas()
    assert len(out) == 2 * 5 * 31 and np.allclose(out[out.l == 3].psd, 0) and np.allclose(out[out.l == 6].psd, 3)
    flat = I.diffuse(np.full(31, 2.0), grid, np.ones(31), 0.5)
    assert np.allclose(flat, 2.0)
    rng = np.random.default_rng(1)
    states = spark.createDataFrame([(0, m, float(l), float(5 + rng.normal())) for m in range(20) for l in range(3)], "run long, member int, l double, psd double")
    obs = spark.createDataFrame([(0, 1.1, 8.0, 0.05)], "run long, l double, psd double, spread double")
    after = I.assimilate(states, obs).where("l = 1").toPandas()
    assert abs(after.psd.mean() - 8.0) < 0.2 and len(after) == 20


def test_grids(spark):
    grid = spark.createDataFrame([(i, j, 2.0 * i + 3.0 * j) for i in range(4) for j in range(5)], "i int, j int, value double")
    points = spark.createDataFrame([(0, 0.5, 0.25), (1, 2.9, 3.5), (2, 3.5, 4.0)], "id long, x double, y double")
    out = {r["id"]: r["value"] for r in I.interpolate_grid(points, grid, 0.0, 1.0, 4, 0.0, 1.0, 5).collect()}
    assert np.allclose([out[k] for k in range(3)], [1.75, 16.3, 19.0])
    leaves = spark.createDataFrame([(1, 0.0, 2.0, 0.0, 4.0), (2, 2.0, 4.0, 0.0, 4.0)], "leaf int, x0 double, x1 double, y0 double, y1 double")
    assert {r["id"]: r["leaf"] for r in I.leaf_of(points, leaves, 1.0).collect()} == {0: 1, 1: 2, 2: None} or {r["id"]: r["leaf"] for r in I.leaf_of(points, leaves, 1.0).collect()} == {0: 1, 1: 2}


def test_window_cards(spark):
    rows = [(dt.datetime(2001, 1, 1) + dt.timedelta(hours=k, minutes=30), 10.0 * (1 + k % 2)) for k in range(100)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    start = F.lit((dt.datetime(2001, 1, 1) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1))
    out = S.window_mean(df, "ts", "v", T.DAY_US, T.DAY_US // 2, start=start).orderBy("label").collect()
    assert [r["value"] for r in out] == [15.0] * 9 and out[0]["label"] == dt.datetime(2001, 1, 1, 12) and out[-1]["label"] == dt.datetime(2001, 1, 5, 12)
    gaps = spark.createDataFrame([(dt.datetime(2024, 1, 1, h), float(v)) for h, v in ((0, 30), (1, 28), (2, 27), (5, 32), (6, 35))], "ts timestamp_ntz, v double")
    filled = S.gap_fill(gaps, "ts", "v").orderBy("ts").collect()
    assert len(filled) == 6 and filled[3]["ts"] == dt.datetime(2024, 1, 1, 3, 30) and filled[3]["v"] is None
    steps = spark.createDataFrame([(v,) for v in (10, 12, 11, 9, 10, 12, 11, 9)], "v int")
    assert sorted((r["v"], r["step"]) for r in S.values_to_steps(steps, "v").collect()) == sorted(zip((10, 12, 11, 9, 10, 12, 11, 9), (1, 3, 2, 0, 1, 3, 2, 0), strict=True))


def test_rules(spark):
    rows = [("flux", "TYPE", "double"), ("flux", "FILLVAL", "-1e31"), ("flux", "DEPEND_0", "Epoch"), ("flux", "DEPEND_1", "nowhere"), ("flux", "FIELDNAM", "Flux"), ("flux", "UNITS", ""), ("flux", "VALIDMIN", "5"), ("flux", "VALIDMAX", "1"), ("Epoch", "TYPE", "bigint"), ("Epoch", "FILLVAL", "0"), ("n", "TYPE", "int")]
    cat = spark.createDataFrame(rows, "variable string, attr string, value string")
    found = {(r["variable"], r["rule"]) for r in R.all_checks(cat).collect()}
    assert found == {("flux", "depends"), ("flux", "empty_entry"), ("flux", "validrange"), ("flux", "fieldnam"), ("Epoch", "fillval"), ("n", "fillval")}
    assert {r["variable"] for r in R.main_variables(cat).collect()} == {"flux", "n"}
