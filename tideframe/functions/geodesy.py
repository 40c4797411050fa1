"""Geodetic positions on an ellipsoid, WGS84 unless another is given, as column expressions, in kilometres and degrees."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ellipsoid:
    """Equatorial radius in kilometres and flattening."""

    a: float = 6378.137
    flat: float = 1 / 298.257223563

    @property
    def b(self) -> float:
        return self.a * (1 - self.flat)

    @property
    def e2(self) -> float:
        """Square of the first eccentricity."""
        return 1 - (self.b / self.a) ** 2

    @property
    def e2p(self) -> float:
        """Square of the second eccentricity."""
        return (self.a / self.b) ** 2 - 1


WGS84 = Ellipsoid()
B = WGS84.b


def geodetic_to_geocentric(lat: Column, lon: Column, alt: Column, body: Ellipsoid = WGS84) -> tuple[Column, Column, Column]:
    s, c = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    n = body.a / F.sqrt(1 - body.e2 * s * s)
    return (n + alt) * c * F.cos(F.radians(lon)), (n + alt) * c * F.sin(F.radians(lon)), (n * (1 - body.e2) + alt) * s


def geocentric_to_geodetic(df: DataFrame, x: str, y: str, z: str, body: Ellipsoid = WGS84) -> DataFrame:
    """``df`` with lat, lon and alt in closed form (Heikkinen's method); on the axis the latitude is that of the pole.

    The steps are columns of their own, so that each is computed once.
    """
    c = F.col
    a, b, e2, e2p = body.a, body.b, body.e2, body.e2p
    zz = c(z) * c(z)
    df = df.withColumn("_r", F.sqrt(c(x) * c(x) + c(y) * c(y)))
    df = df.withColumns({"_f": 54 * b**2 * zz, "_g": c("_r") * c("_r") + (1 - e2) * zz - e2 * (a**2 - b**2)})
    df = df.withColumn("_c", e2**2 * c("_f") * c("_r") * c("_r") / (c("_g") * c("_g") * c("_g")))
    df = df.withColumn("_s", F.cbrt(1 + c("_c") + F.sqrt(c("_c") * c("_c") + 2 * c("_c"))))
    df = df.withColumn("_t", c("_s") + 1 / c("_s") + 1)
    df = df.withColumn("_p", c("_f") / (3 * c("_t") * c("_t") * c("_g") * c("_g")))
    df = df.withColumn("_q", F.sqrt(1 + 2 * e2**2 * c("_p")))
    inner = 0.5 * a**2 * (1 + 1 / c("_q")) - c("_p") * (1 - e2) * zz / (c("_q") * (1 + c("_q"))) - 0.5 * c("_p") * c("_r") * c("_r")
    df = df.withColumn("_d", c("_r") - e2 * (-(c("_p") * e2 * c("_r")) / (1 + c("_q")) + F.sqrt(F.greatest(F.lit(0.0), inner))))
    df = df.withColumns({"_u": F.sqrt(c("_d") * c("_d") + zz), "_v": F.sqrt(c("_d") * c("_d") + (1 - e2) * zz)})
    pole = c("_r") <= 1e-12
    lat = F.when(pole, F.signum(c(z)) * 90.0).otherwise(F.degrees(F.atan2(c(z) * (1 + e2p * b**2 / (a * c("_v"))), c("_r"))))
    lon = F.when(pole, 0.0).otherwise(F.degrees(F.atan2(c(y), c(x))))
    alt = F.when(pole, F.abs(c(z)) - b).otherwise(c("_u") * (1 - b**2 / (a * c("_v"))))
    return df.withColumns({"lat": lat, "lon": lon, "alt": alt}).drop(*(f"_{n}" for n in "rfgcstpqduv"))


def counted_on(lat: Column, lon: Column, given_lat: Column, given_lon: Column) -> tuple[Column, Column]:
    """The same place named as another was: latitude counted on past a pole, longitude in the turn nearest to the given one."""
    past = F.abs(given_lat) > 90
    lon = F.when(past, lon + 180).otherwise(lon)
    return F.when(past, F.signum(given_lat) * 180 - lat).otherwise(lat), lon - 360 * F.round((lon - given_lon) / 360)


def geocentric_to_radial(df: DataFrame, x: str, y: str, z: str, body: Ellipsoid = WGS84) -> DataFrame:
    """``df`` with radius, geodetic latitude and longitude."""
    radius = F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y) + F.col(z) * F.col(z))
    return geocentric_to_geodetic(df, x, y, z, body).withColumn("radius", radius).drop("alt")


def radial_to_geocentric(radius: Column, lat: Column, lon: Column, body: Ellipsoid = WGS84) -> tuple[Column, Column, Column]:
    """The point at a distance from the centre on the normal of geodetic latitude ``lat``."""
    s, c = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    n, left = body.a / F.sqrt(1 - body.e2 * s * s), 1 - body.e2
    # |((n + h) c, (n (1 - e2) + h) s)| = radius, solved for h
    half = n * (c * c + left * s * s)
    h = -half + F.sqrt(half * half - n * n * (c * c + left * left * s * s) + radius * radius)
    return geodetic_to_geocentric(lat, lon, h, body)
