"""Empirical models of the magnetosphere and the solar wind as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of published fits.
DST_STAR = {"Burton": (15.8, 20.0), "OBrien": (7.26, 11.0), "Borovsky": (20.7, 27.7)}
PLASMAPAUSE = {"CA1992": (5.6, 0.46, 24, 1.0), "M2002": (5.39, 0.382, 12, 1.0), "RT1970": (5.64, 0.78, 0, 0.5)}
#: Fixed values of M2002 by local time: hours from 0 on, in runs as published, and the two coefficients.
PLASMAPAUSE_LT = ((3, 5.7, 0.42), (6, 6.05, 0.573), (6, 5.2, 0.425), (6, 4.45, 0.167), (3, 5.7, 0.42))
EV_IN_K = 1.16045221e4
VAMPOLA_ORDER = (
    5.38, 5.078, 4.669, 3.916, 3.095, 2.494, 2.151, 1.998, 1.899, 1.942, 1.974, 1.939, 1.970, 2.136, 1.775, 1.438, 1.254, 1.194, 1.046, 0.989, 0.852,
)


def l_max(dst: Column) -> Column:
    return 6.07e-5 * dst * dst + 0.0436 * dst + 9.37


def magnetopause_shape(bz: Column, p: Column) -> tuple[Column, Column]:
    """(stand-off distance, flaring) of the magnetopause."""
    r0 = (11.4 + F.when(bz >= 0, 0.013).otherwise(0.140) * bz) * F.pow(p, F.lit(-1 / 6.6))
    return r0, (0.58 - 0.01 * bz) * (1 + 0.01 * p)


def magnetopause(bz: Column, p: Column, lt: Column) -> tuple[Column, Column]:
    """(x, y) of the magnetopause at a local time in hours."""
    r0, alpha = magnetopause_shape(bz, p)
    theta = (12 - lt) * F.lit(math.pi) / 12  # not by a rounded pi / 12: far tails hang on the last digit
    r = r0 * F.pow(2 / (1 + F.cos(theta)), alpha)
    return r * F.cos(theta), r * F.sin(theta)


def dst_star(dst: Column, p: Column, model: str | tuple[float, float] = "OBrien") -> Column:
    b, c = DST_STAR[model] if isinstance(model, str) else model
    return dst - b * F.sqrt(p) + c


def expected_temperature(v: Column, model: str = "XB15", units: str = "K") -> Column:
    """Temperature expected at a solar wind speed."""
    ev = {
        "BS06": F.when(v < 372, 1.28e-8 * F.pow(v, F.lit(3.324))).otherwise(0.0572 * v - 16.79),
        "XB15": F.pow(v / 258.0, F.lit(3.113)),
        "L87": F.when(v < 500, F.pow(0.031 * v - 5.1, F.lit(2.0))).otherwise(F.pow(0.02 * v + 0.5, F.lit(2.0))) * (1e3 / EV_IN_K),
    }[model.upper()]
    return ev * EV_IN_K if units.lower() == "k" else ev


def plasmapause_l(kp_max: Column, model: str = "M2002") -> Column:
    a, b, _, power = PLASMAPAUSE[model]
    return a - b * F.pow(kp_max, F.lit(power))


def proton_fluence(energy: Column, norm: float = 3.2e7, gamma: float = -0.96, e0: float = 15.0) -> Column:
    """Fluence at an energy of the power law with an exponential end."""
    return norm * F.pow(energy, F.lit(gamma)) * F.exp(-energy / e0)


def proton_spectrum(spark, norm: float = 3.2e7, gamma: float = -0.96, e0: float = 15.0, low: float = 0.1, high: float = 600.0, steps: int = 100) -> DataFrame:
    """(energy, fluence) on a logarithmic grid."""
    e = F.pow(F.lit(10.0), math.log10(low) + F.col("id") * ((math.log10(high) - math.log10(low)) / (steps - 1)))
    return spark.range(steps).select(e.alias("energy")).withColumn("fluence", proton_fluence(F.col("energy"), norm, gamma, e0))


def vampola_order(l_shell: Column) -> Column:
    """Order of the sine pitch-angle distribution at L, by linear interpolation, ends held."""
    at = F.least(F.greatest((l_shell - 3) / 0.25, F.lit(0.0)), F.lit(float(len(VAMPOLA_ORDER) - 1)))
    k = F.least(F.floor(at), F.lit(len(VAMPOLA_ORDER) - 2)).cast("int")
    table = F.array(*map(F.lit, VAMPOLA_ORDER))
    return F.get(table, k) + (at - k) * (F.get(table, k + 1) - F.get(table, k))


def diffusion_coefficient(l_shell: Column, kp: Column, model: str = "BA2000") -> Column:
    """Radial diffusion coefficient per day."""
    if model == "const":
        return F.lit(10.0)
    a, b = {"BA2000": (F.pow(F.lit(10.0), 0.506 * kp - 9.325), 10.0), "FC2006": (F.lit(1.5e-6), 8.5), "U2008": (F.lit(7.7e-6), 6.0), "S1997": (F.lit(1.9e-10), 11.7)}[model]
    return a * F.pow(l_shell, F.lit(b))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series eight steps up, and the recurrence down."""
    z = x + 8
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - 1 / (1680 * z * z * z * z * z * z * z)
    down = x
    for k in range(1, 8):
        down = down * (x + k)
    return series - F.log(down)


def sine_flux(omni: Column, alpha: Column, order: Column) -> Column:
    """Directional flux at a pitch angle in degrees whose sine to the power ``order`` integrates to the omnidirectional one."""
    integral = math.sqrt(math.pi) * F.exp(log_gamma((order + 2) / 2) - log_gamma((order + 3) / 2))
    return omni / (2 * math.pi * integral) * F.pow(F.sin(F.radians(alpha)), order)


def gaussian_source(l_shell: Column, height: float = 1e-8, center: float = 5.0, width: float = 0.5) -> Column:
    return height * F.exp(-(l_shell - center) * (l_shell - center) / (2.0 * width * width))


def local_acceleration(l_shell: Column, kp: Column, size: float) -> Column:
    """Source of particles around L = 5.6 that grows with the square of the index."""
    return gaussian_source(l_shell, size, 5.6, 0.3) * kp * kp


def energy_grid(spark, count: int = 36, low: float = 0.1, width: float = 3e-2, power: float = 1.27) -> DataFrame:
    """(bin, low, center, width) of energy bins whose widths grow by a constant factor."""
    wide = width * F.pow(F.lit(float(power)), F.col("id").cast("double"))
    start = low + (wide - width) / (power - 1) if power != 1 else low + width * F.col("id")
    return spark.range(count).select(F.col("id").alias("bin"), start.alias("low"), (start + wide / 2).alias("center"), wide.alias("width"))


def energy_bin(energy: Column, low: float = 0.1, width: float = 3e-2, power: float = 1.27) -> Column:
    """Number of the bin of such a grid that an energy is in; null below the first."""
    share = (energy - low) / width
    at = F.log(1 + share * (power - 1)) / math.log(power) if power != 1 else share
    return F.when(energy >= low, F.floor(at).cast("long"))


def grid_place(value: Column, low: float, high: float, count: int) -> Column:
    """Number of the last of ``count`` even steps from ``low`` to ``high`` that is not above a value; null outside of them."""
    return F.when((value >= low) & (value <= high), F.floor((value - low) / ((high - low) / (count - 1))).cast("long"))


def radius_grid(spark, count: int = 20, low: float = 1.75, high: float = 6.5) -> DataFrame:
    """(id, value): ``count`` + 1 radii, the last one a step beyond ``high``."""
    return spark.range(count + 1).select("id", (low + F.col("id") * ((high - low) / (count - 1))).alias("value"))


def local_time_grid(spark, count: int = 25) -> DataFrame:
    """(id, angle, hours) around the clock, both ends included."""
    share = F.col("id") / float(count - 1)
    return spark.range(count).select("id", (share * (2 * math.pi)).alias("angle"), (share * 24.0).alias("hours"))
