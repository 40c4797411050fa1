"""Vectors, quaternions and angles as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hypot(*parts: Column) -> Column:
    """Root of the sum of squares."""
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def array_hypot(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def car2sph(x: Column, y: Column, z: Column) -> Column:
    """struct(r, lat, lon) in degrees; longitude 0 at the poles."""
    r = hypot(x, y, z)
    rho = hypot(x, y)
    lat = F.when(r == 0, 0.0).otherwise(F.degrees(F.atan2(z, rho)))
    return F.struct(r.alias("r"), lat.alias("lat"), F.when(rho == 0, 0.0).otherwise(F.degrees(F.atan2(y, x))).alias("lon"))


def sph2car(r: Column, lat: Column, lon: Column) -> Column:
    a, b = F.radians(lat), F.radians(lon)
    return F.struct((r * F.cos(a) * F.cos(b)).alias("x"), (r * F.cos(a) * F.sin(b)).alias("y"), (r * F.sin(a)).alias("z"))


def polar2cart(r: Column, theta: Column) -> Column:
    return F.struct((r * F.cos(theta)).alias("x"), (r * F.sin(theta)).alias("y"))


def cart2polar(x: Column, y: Column) -> Column:
    return F.struct(hypot(x, y).alias("r"), F.atan2(y, x).alias("theta"))


def mlt2rad(mlt: Column, midnight: bool = False) -> Column:
    return (mlt + (12 if midnight else 0) - 12) * (math.pi / 12)


def rad2mlt(rad: Column, midnight: bool = False) -> Column:
    return (rad + (math.pi if midnight else 0)) * (12 / math.pi) + 12


Quaternion = tuple[Column, Column, Column, Column]  # vector part, then scalar


def _norm(q: Quaternion) -> Column:
    return hypot(*q)


def quat_normalize(q: Quaternion) -> Quaternion:
    """Unit quaternion; one of almost no length becomes the identity."""
    n = _norm(q)
    tiny = n <= 1e-12
    return tuple(F.when(tiny, float(k == 3)).otherwise(F.try_divide(c, n)) for k, c in enumerate(q))


def quat_multiply(a: Quaternion, b: Quaternion) -> Quaternion:
    """Hamilton product."""
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return (
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
        aw * bw - ax * bx - ay * by - az * bz,
    )


def quat_conjugate(q: Quaternion) -> Quaternion:
    return (-q[0], -q[1], -q[2], q[3])


def quat_rotate(q: Quaternion, v: tuple[Column, Column, Column], normalize: bool = True) -> tuple[Column, Column, Column]:
    """Rotate a vector by a quaternion."""
    x, y, z, w = quat_normalize(q) if normalize else q
    # v + 2 u x (u x v + w v)
    cx, cy, cz = y * v[2] - z * v[1] + w * v[0], z * v[0] - x * v[2] + w * v[1], x * v[1] - y * v[0] + w * v[2]
    return (v[0] + 2 * (y * cz - z * cy), v[1] + 2 * (z * cx - x * cz), v[2] + 2 * (x * cy - y * cx))


def quat_to_matrix(q: Quaternion, normalize: bool = True) -> Column:
    """3 x 3 rotation matrix as an array of rows."""
    x, y, z, w = quat_normalize(q) if normalize else q
    return F.array(
        F.array(1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)),
        F.array(2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)),
        F.array(2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)),
    )


def quat_from_matrix(m: list[list[Column]]) -> Quaternion:
    """Unit quaternion of a rotation matrix, by its largest component; the scalar part is not negative where it leads."""
    trace = m[0][0] + m[1][1] + m[2][2]
    big = [1 + m[0][0] - m[1][1] - m[2][2], 1 - m[0][0] + m[1][1] - m[2][2], 1 - m[0][0] - m[1][1] + m[2][2], 1 + trace]
    d = (m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1])
    s = (m[0][1] + m[1][0], m[0][2] + m[2][0], m[1][2] + m[2][1])
    rows = [(big[0], s[0], s[1], d[0]), (s[0], big[1], s[2], d[1]), (s[1], s[2], big[2], d[2]), (*d, big[3])]
    lead = F.greatest(*big)
    pick = [F.when(lead == big[3], rows[3][k]).when(lead == big[0], rows[0][k]).when(lead == big[1], rows[1][k]).otherwise(rows[2][k]) for k in range(4)]
    scale = 2 * F.sqrt(lead)
    return tuple(p / scale for p in pick)


def in_degrees(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """``df`` with columns in degrees beside those in radians; ``names`` maps the old to the new ones."""
    return df.withColumns({new: F.degrees(old) for old, new in names.items() if old in df.columns})
