"""Coordinate frames of the Earth and the Sun: rotation matrices for each distinct time, applied as column algebra.

A matrix depends on its time alone, so it is computed beside the positions, in NumPy once for each distinct time of an Arrow
batch; nothing is shuffled, joined or broadcast. Frames: ECI2000, ECIMOD, ECITOD, TEME, GEO, GSE, GSM, SM, CDMAG, with the
aliases below. Earth orientation (UT1 - UTC, polar motion, offsets of the celestial pole) is zero unless a table of it is
given, which is interpolated to each distinct time and joined by a shuffle. Nutation has the largest 21 terms of the 1980 series, which leaves
some milliarcseconds; a longer list of terms is a parameter, read from a file of the published layout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.functions.timescales import DAY_US, from_utc_us, leap_seconds, utc_us

ALIASES = {"SPH": "GEO", "GEI": "ECITOD", "TOD": "ECITOD", "MOD": "ECIMOD", "J2000": "ECI2000", "MAG": "CDMAG"}
FRAMES = ("ECI2000", "ECIMOD", "ECITOD", "TEME", "GEO", "GSE", "GSM", "SM", "CDMAG")
ARCSEC = np.pi / 648000
#: UT1 - UTC in seconds, the pole's position and the offsets of longitude and obliquity in arcseconds; lines of a series of terms.
ORIENTATION, MOST_TERMS = ("dut1", "xp", "yp", "dpsi", "deps"), 10000
#: Multiples of (l, l', F, D, node), then nutation in longitude and in obliquity, 1e-4 arcsec, with rates by century.
NUTATION = np.array(
    [
        (0, 0, 0, 0, 1, -171996, -174.2, 92025, 8.9), (0, 0, 2, -2, 2, -13187, -1.6, 5736, -3.1), (0, 0, 2, 0, 2, -2274, -0.2, 977, -0.5),
        (0, 0, 0, 0, 2, 2062, 0.2, -895, 0.5), (0, 1, 0, 0, 0, 1426, -3.4, 54, -0.1), (1, 0, 0, 0, 0, 712, 0.1, -7, 0),
        (0, 1, 2, -2, 2, -517, 1.2, 224, -0.6), (0, 0, 2, 0, 1, -386, -0.4, 200, 0), (1, 0, 2, 0, 2, -301, 0, 129, -0.1),
        (0, -1, 2, -2, 2, 217, -0.5, -95, 0.3), (1, 0, 0, -2, 0, -158, 0, -1, 0), (0, 0, 2, -2, 1, 129, 0.1, -70, 0),
        (-1, 0, 2, 0, 2, 123, 0, -53, 0), (1, 0, 0, 0, 1, 63, 0.1, -33, 0), (0, 0, 0, 2, 0, 63, 0, -2, 0), (-1, 0, 2, 2, 2, -59, 0, 26, 0),
        (-1, 0, 0, 0, 1, -58, -0.1, 32, 0), (1, 0, 2, 0, 1, -51, 0, 27, 0), (2, 0, 0, -2, 0, 48, 0, 1, 0), (-2, 0, 2, 0, 1, 46, 0, -24, 0), (0, 0, 2, 2, 2, -38, 0, 16, 0),
    ]
)
#: Dipole coefficients g10, g11, h11 in nT every five years from 1900 on, and their yearly change after the last.
DIPOLE_G10 = (
    -31543, -31464, -31354, -31212, -31060, -30926, -30805, -30715, -30654, -30594, -30554, -30500, -30421, -30334, -30220, -30100, -29992, -29873, -29775,
    -29692, -29619.4, -29554.63, -29496.57, -29441.46, -29404.8,
)
DIPOLE_G11 = (
    -2298, -2298, -2297, -2306, -2317, -2318, -2316, -2306, -2292, -2285, -2250, -2215, -2169, -2119, -2068, -2013, -1956, -1905, -1848, -1784, -1728.2,
    -1669.05, -1586.42, -1501.77, -1450.9,
)
DIPOLE_H11 = (
    5922, 5909, 5898, 5875, 5845, 5817, 5808, 5812, 5821, 5810, 5815, 5820, 5791, 5776, 5737, 5675, 5604, 5500, 5406, 5306, 5186.1, 5077.99, 4944.26, 4795.99, 4652.5,
)
DIPOLE_CHANGE = (5.7, 7.4, -25.9)


def _rows(*rows) -> np.ndarray:
    """Matrices of stacked rows: rows of components over times to (time, 3, 3)."""
    return np.stack([np.stack(np.broadcast_arrays(*r), -1) for r in rows], -2)


def _axis(k: int, angle: np.ndarray) -> np.ndarray:
    """Rotation of the frame about axis k."""
    c, s, o, z = np.cos(angle), np.sin(angle), np.ones_like(angle), np.zeros_like(angle)
    return (_rows((o, z, z), (z, c, s), (z, -s, c)), _rows((c, z, -s), (z, o, z), (s, z, c)), _rows((c, s, z), (-s, c, z), (z, z, o)))[k]


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def kepler(mean: np.ndarray, eccentricity: np.ndarray, tolerance: float = 1e-8, most: int = 100) -> np.ndarray:
    """Eccentric anomaly by Newton's method."""
    e = mean + eccentricity * np.sin(mean)
    for _ in range(most):
        step = (mean - e + eccentricity * np.sin(e)) / (1 - eccentricity * np.cos(e))
        e = e + step
        if np.all(np.abs(step) < tolerance):
            break
    return e


def sidereal_time(jd_ut1: np.ndarray) -> np.ndarray:
    """Greenwich mean sidereal time of the 1982 model, radians."""
    t = (jd_ut1 - 2451545.0) / 36525
    seconds = -19089.45159 + (8640184.812866 + (0.093104 - 6.2e-6 * t) * t) * t + 86400 * (jd_ut1 % 1 + 2451545.0 % 1)
    return (2 * np.pi / 86400 * seconds) % (2 * np.pi)


def read_nutation(spark: SparkSession, path: str) -> np.ndarray:
    """Terms of a nutation series from a text file: nine numbers a line, in the order of NUTATION; other lines are skipped.

    Amplitudes are in 1e-4 arcseconds. A series has hundreds of terms at most and travels with the tasks.
    """
    found = []
    for row in spark.read.text(path).limit(MOST_TERMS).collect():
        parts = row["value"].replace(",", " ").split()
        try:
            numbers = [float(x) for x in parts]
        except ValueError:
            continue
        if len(numbers) == 9:
            found.append(numbers)
    if not found:
        raise ValueError(f"{path}: no line of nine numbers")
    return np.array(found)


def nutation(t: np.ndarray, terms: np.ndarray = NUTATION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(longitude, obliquity) of the nutation in arcseconds and the Moon's node in radians."""
    turn = lambda a, b, c, d: np.radians((a + b * t + c * t * t + d * t**3) % 360)
    args = np.stack(
        [
            turn(134.96298139, 1325 * 360 + 198.8673981, 0.0086972, 1.78e-5), turn(357.52772333, 99 * 360 + 359.0503400, -0.0001603, -3.3e-6),
            turn(93.27191028, 1342 * 360 + 82.0175381, -0.0036825, 3.1e-6), turn(297.85036306, 1236 * 360 + 307.1114800, -0.0019142, 5.3e-6),
            turn(125.04452222, -(5 * 360 + 134.1362608), 0.0020708, 2.2e-6),
        ]
    )
    phase = terms[:, :5] @ args
    psi = ((terms[:, 5, None] + terms[:, 6, None] * t) * np.sin(phase)).sum(0) * 1e-4
    eps = ((terms[:, 7, None] + terms[:, 8, None] * t) * np.cos(phase)).sum(0) * 1e-4
    return psi, eps, args[4]


def dipole(year: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit axis in GEO, moment in nT) of the centred dipole: linear between epochs, by yearly change after the last."""
    at = 1900 + 5.0 * np.arange(len(DIPOLE_G10))
    late = np.maximum(0, year - at[-1])
    g10, g11, h11 = (np.interp(year, at, c) + d * late for c, d in zip((DIPOLE_G10, DIPOLE_G11, DIPOLE_H11), DIPOLE_CHANGE, strict=True))
    v = -np.stack([g11, h11, g10], -1)
    return _unit(v), np.linalg.norm(v, axis=-1)


def matrices(us: np.ndarray, leaps: np.ndarray, orientation: np.ndarray | None = None, terms: np.ndarray = NUTATION) -> dict[str, np.ndarray]:
    """Rotations from ECIMOD to each frame, and the dipole tilt in radians, at UTC microseconds.

    ``orientation`` has a row of ORIENTATION for each time: seconds, and four angles in arcseconds.
    """
    dut1, xp, yp, dpsi, deps = np.zeros((5, len(us))) if orientation is None else np.nan_to_num(orientation).T
    jd = us / 86400e6 + 2440587.5
    jd_tt = jd + (leaps + 32.184) / 86400
    t = (jd_tt - 2451545.0) / 36525
    # fixed values: mean obliquity, precession angles, equation of the equinoxes
    mean = (84381.448 - 46.8150 * t - 0.00059 * t**2 + 0.001813 * t**3) * ARCSEC
    zeta, zee, theta = (np.radians(a * t + b * t**2 + c * t**3) for a, b, c in ((0.6406161, 0.0000839, 5.0e-6), (0.6406161, 0.0003041, 5.1e-6), (0.5567530, -0.0001185, -1.16e-5)))
    precession = _axis(2, -zee) @ _axis(1, theta) @ _axis(2, -zeta)
    psi, eps, node = nutation(t, terms)
    psi, eps = psi + dpsi, eps + deps
    true = mean + eps * ARCSEC
    to_tod = _axis(0, -true) @ _axis(2, -psi * ARCSEC) @ _axis(0, mean)
    equinoxes = (psi * np.cos(mean) + 0.00264 * np.sin(node) + 0.000063 * np.sin(2 * node)) * ARCSEC
    gmst = sidereal_time(jd + dut1 / 86400)

    # fixed values: the Sun's eccentricity, perigee and mean longitude
    since_1900 = (jd - 2415020.0) / 36525
    ecc = 0.01675104 - 0.0000418 * since_1900 - 0.000000126 * since_1900**2
    perigee = np.radians(282.768422)
    anomaly = (2 * np.pi / 365.242191 * (jd_tt - 2447891.5) + np.radians(279.403303) - perigee) % (2 * np.pi)
    e = kepler(anomaly, ecc)
    sun_longitude = 2 * np.arctan(np.sqrt((1 + ecc) / (1 - ecc)) * np.tan(e / 2)) + perigee
    sun = np.stack([np.cos(sun_longitude), np.cos(mean) * np.sin(sun_longitude), np.sin(mean) * np.sin(sun_longitude)], -1)

    def sunward(up: np.ndarray) -> np.ndarray:
        y = _unit(np.cross(up, sun))
        return np.stack([sun, y, np.cross(sun, y)], -2)

    axis, _ = dipole(2000 + (jd - 2451544.5) / 365.25)
    axis_mod = np.einsum("nji,nj->ni", _axis(2, gmst), axis)
    gsm = sunward(axis_mod)
    seen = np.einsum("nij,nj->ni", gsm, axis_mod)
    tilt = np.arctan2(seen[:, 0], seen[:, 2])
    y = _unit(np.cross(np.array([0.0, 0.0, 1.0]), axis))
    geo = _axis(1, -xp * ARCSEC) @ _axis(0, -yp * ARCSEC) @ _axis(2, gmst + equinoxes) @ to_tod
    return {
        "ECI2000": np.swapaxes(precession, 1, 2), "ECIMOD": np.broadcast_to(np.eye(3), (len(us), 3, 3)), "ECITOD": to_tod,
        "TEME": _axis(2, equinoxes) @ to_tod, "GEO": geo, "GSE": sunward(np.stack([np.zeros_like(mean), -np.sin(mean), np.cos(mean)], -1)),
        "GSM": gsm, "SM": _axis(1, tilt) @ gsm, "CDMAG": np.stack([np.cross(y, axis), y, axis], -2) @ geo, "tilt": tilt,
    }


def _frame(name: str) -> str:
    name = ALIASES.get(name.upper(), name.upper())
    if name not in FRAMES:
        raise ValueError(f"frames are {', '.join(FRAMES)}")
    return name


def turning(us: Column, source: str, target: str, orientation: tuple[Column, ...] = (), terms: np.ndarray = NUTATION) -> Column:
    """(matrix, tilt) at UTC microseconds: row-major rotation and dipole tilt in degrees, null at null times.

    ``orientation`` has ORIENTATION as expressions beside the time.
    """
    source, target = _frame(source), _frame(target)

    @F.arrow_udf("matrix array<double>, tilt double")
    def turn(us: pa.Array, leaps: pa.Array, *known: pa.Array) -> pa.Array:
        there = np.asarray(us.is_valid())
        times, first, back = np.unique(us.drop_null().to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
        pick = lambda c: c.to_numpy(zero_copy_only=False).astype(np.float64)[there][first]
        m = matrices(times.astype(np.float64), pick(leaps), np.stack([pick(c) for c in known], 1) if known else None, terms)
        turns, tilts = np.zeros((len(us), 9)), np.zeros(len(us))
        turns[there] = (m[target] @ np.swapaxes(m[source], 1, 2)).reshape(-1, 9)[back]
        tilts[there] = np.degrees(m["tilt"])[back]
        gone = pa.array(~there)
        rows = pa.ListArray.from_arrays(pa.array(9 * np.arange(len(us) + 1), pa.int32()), pa.array(turns.ravel()))
        return pa.StructArray.from_arrays([rows, pa.array(tilts)], ["matrix", "tilt"], mask=gone)

    return turn(us, leap_seconds(us), *orientation)


def oriented(times: DataFrame, orientation: DataFrame, bucket_us: int = 30 * DAY_US) -> DataFrame:
    """``times`` (us) with ORIENTATION, linear between the rows around each of a table (ts, ORIENTATION); the ends are held.

    UT1 - UTC jumps by a second at a leap second; it is interpolated without the leap seconds and given with them.
    """
    from tideframe.operators.matching import _around

    known = orientation.select("ts", *ORIENTATION).withColumn("dut1", F.col("dut1") - leap_seconds(utc_us(F.col("ts"))))
    rows = _around(times.withColumn("ts", from_utc_us(F.col("us"))), known, "ts", (), ORIENTATION, bucket_us)
    a, b = F.col("_last"), F.col("_next")
    share = F.when(a["us"] == b["us"], 0.0).otherwise((F.col("us") - a["us"]) / (b["us"] - a["us"]))
    blend = lambda c: F.when(a.isNull(), b[c]).when(b.isNull(), a[c]).otherwise(a[c] + share * (b[c] - a[c]))
    rows = rows.select("us", *(blend(c).alias(c) for c in ORIENTATION))
    return rows.withColumn("dut1", F.col("dut1") + leap_seconds(F.col("us")))


def rotations(df: DataFrame, ts: str, source: str, target: str, orientation: DataFrame | None = None, terms: np.ndarray = NUTATION) -> DataFrame:
    """(us, matrix, tilt): row-major rotation and dipole tilt in degrees for each distinct time of ``df``.

    ``orientation`` is a table (ts, ORIENTATION) of the Earth's orientation, ``terms`` a nutation series.
    """
    times = df.select(utc_us(F.col(ts)).alias("us")).where("us is not null").distinct()
    if orientation is not None:
        times = oriented(times, orientation)
    known = () if orientation is None else tuple(F.col(c) for c in ORIENTATION)
    return times.select("us", turning(F.col("us"), source, target, known, terms).alias("_t")).select("us", "_t.matrix", "_t.tilt")


def convert(df: DataFrame, ts: str, xyz: tuple[str, str, str], source: str, target: str, orientation: DataFrame | None = None, terms: np.ndarray = NUTATION) -> DataFrame:
    """``df`` with its position columns turned from one frame into another.

    Without a table of the Earth's orientation each row's matrix is computed beside it. With one, the table is brought to the
    distinct times, and these to the rows by a join that shuffles: as many times as rows are never sent to the driver.
    """
    rows = df.withColumn("_us", utc_us(F.col(ts)))
    if orientation is None:
        rows = rows.withColumn("_m", turning(F.col("_us"), source, target, terms=terms)["matrix"])
    else:
        m = rotations(df, ts, source, target, orientation, terms)
        rows = rows.join(m.select(F.col("us").alias("_us"), F.col("matrix").alias("_m")).hint("merge"), "_us", "left")
    part = lambda k: sum((F.col("_m")[3 * k + j] * F.col(f"_{c}") for j, c in enumerate(xyz)), F.lit(0.0))
    rows = rows.withColumns({f"_{c}": F.col(c) for c in xyz}).withColumns({c: part(k) for k, c in enumerate(xyz)})
    return rows.drop("_us", "_m", *(f"_{c}" for c in xyz))


def gmst(us: Column) -> Column:
    """Greenwich mean sidereal time in radians as an expression."""
    jd = us / 86400e6 + 2440587.5
    t = (jd - 2451545.0) / 36525
    seconds = -19089.45159 + (8640184.812866 + (0.093104 - 6.2e-6 * t) * t) * t + 86400 * F.pmod(jd, F.lit(1.0))
    return F.pmod(seconds * (2 * np.pi / 86400), F.lit(2 * np.pi))
