"""Derived quantities of gridded fields: derivatives on regular blocks, curl, advection, surface integrals, spans.

A grid is a table of points with two coordinates; ``block`` names the columns that tell its blocks (file, frame, leaf)
apart. Derivatives are windows over one line of one block, so lines are dealt over the tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Radius of the Earth and height of the ionosphere in km, km2/Re/s2 to m/s2, proton masses per cm3 to kg/m3.
EARTH_KM, IONOSPHERE_KM = 6371.0, 110.0
ADVECTION = 1000.0 / EARTH_KM * 1.6726e-21 * 1e9


def derivative_along(value: Column, along: str, lines: tuple[str, ...], step: Column | float) -> Column:
    """Second-order derivative on a line of even ``step``: central inside, three-point at both ends; null under three points."""
    w = Window.partitionBy(*lines).orderBy(along)
    at = lambda k: F.lead(value, k).over(w) if k > 0 else F.lag(value, -k).over(w)
    first = -3.0 * value + 4.0 * at(1) - at(2)
    last = 3.0 * value - 4.0 * at(-1) + at(-2)
    inner = at(1) - at(-1)
    out = F.when(F.lag(F.col(along)).over(w).isNull(), first).when(F.lead(F.col(along)).over(w).isNull(), last).otherwise(inner)
    return out / (2.0 * (step if isinstance(step, Column) else F.lit(step)))


def with_derivatives(df: DataFrame, values: tuple[str, ...], x: str, y: str, step: Column | float, block: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``d<value>_d<x>`` and ``d<value>_d<y>`` of each value."""
    along_x = {f"d{v}_d{x}": derivative_along(F.col(v), x, (*block, y), step) for v in values}
    along_y = {f"d{v}_d{y}": derivative_along(F.col(v), y, (*block, x), step) for v in values}
    return df.withColumns(along_x).withColumns(along_y)


def curl(df: DataFrame, u: str, v: str, x: str, y: str, step: Column | float, block: tuple[str, ...] = (), scale: float = 1 / EARTH_KM, out: str = "curl") -> DataFrame:
    """du/dy - dv/dx of the components ``u`` along ``x`` and ``v`` along ``y``; km/s over Earth radii gives 1/s."""
    rows = with_derivatives(df, (u, v), x, y, step, block)
    made = [f"d{c}_d{a}" for c in (u, v) for a in (x, y)]
    return rows.withColumn(out, scale * (F.col(f"d{u}_d{y}") - F.col(f"d{v}_d{x}"))).drop(*made)


def advection(df: DataFrame, u: str, v: str, rho: str, x: str, y: str, step: Column | float, block: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the momentum carried along the flow, rho (u . grad) u, in nN/m3 as ``divmom<x>`` and ``divmom<y>``."""
    rows = with_derivatives(df, (u, v), x, y, step, block)
    flow = lambda c: (F.col(u) * F.col(f"d{c}_d{x}") + F.col(v) * F.col(f"d{c}_d{y}")) * F.col(rho) * ADVECTION
    made = [f"d{c}_d{a}" for c in (u, v) for a in (x, y)]
    return rows.withColumns({f"divmom{x}": flow(u), f"divmom{y}": flow(v)}).drop(*made)


def span(df: DataFrame, value: str, keys: tuple[str, ...], out: str = "drop") -> DataFrame:
    """(keys, greatest less least value): the potential drop of each time."""
    return df.groupBy(*keys).agg((F.max(value) - F.min(value)).alias(out))


def surface_currents(df: DataFrame, jr: str, colatitude: str, keys: tuple[str, ...], dlat: float, dlon: float) -> DataFrame:
    """(keys, net, up, down): radial currents over a hemisphere in MA, from microampere/m2 on a grid in degrees."""
    r2 = ((EARTH_KM + IONOSPHERE_KM) * 1000.0) ** 2
    part = F.col(jr) * F.sin(F.radians(colatitude)) * (math.radians(dlat) * math.radians(dlon) * r2 * 1e-12)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return df.groupBy(*keys).agg(total(part).alias("net"), total(F.when(F.col(jr) > 0, part)).alias("up"), total(F.when(F.col(jr) < 0, part)).alias("down"))


def radial_fluence(df: DataFrame, flux: str, theta: str, r: str, dtheta: float, dphi: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, r, fluence): radial flux summed over each sphere; ``r`` in Earth radii, angles in radians."""
    r_km = F.col(r) * EARTH_KM
    return df.groupBy(*keys, r).agg(F.sum(r_km * r_km * F.col(flux) * F.sin(theta) * (dtheta * dphi * 1e6)).alias("fluence"))


def omnidirectional(df: DataFrame, flux: str, width: Column, keys: tuple[str, ...]) -> DataFrame:
    """(keys, omni): positive fluxes times 4 pi and the width of their pitch-angle bin, summed."""
    return df.where(F.col(flux) > 0).groupBy(*keys).agg(F.sum(4 * math.pi * width * F.col(flux)).alias("omni"))


def scrubbed(df: DataFrame, value: str, order: str, keys: tuple[str, ...], last: float = 0.0) -> DataFrame:
    """``df`` where values that are not positive take the last positive one before them, ``last`` at the start of a series."""
    from tideframe.operators.series import carried

    rows = carried(df, keys, order, {"_kept": F.when(F.col(value) > 0, F.col(value))})
    return rows.withColumn(value, F.coalesce("_kept", F.lit(last))).drop("_kept").select(*df.columns)


def courant(speed: Column, dt: float, step: Column) -> Column:
    """Share of a cell that the flow crosses in ``dt`` seconds; ``step`` in Earth radii, speed in km/s."""
    return speed * dt / (step * EARTH_KM)


def potential_field(df: DataFrame, potential: str, l_shell: str, phi: str, step_l: float, step_phi: float, block: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the electric field ``er``, ``ephi`` and ``e`` in mV/m of a potential in kV over L and an angle in radians."""
    scale = 1e6 / (EARTH_KM * 1000)
    er = derivative_along(F.col(potential) * scale, l_shell, (*block, phi), step_l)
    ephi = derivative_along(F.col(potential) * scale / F.col(l_shell), phi, (*block, l_shell), step_phi)
    return df.withColumns({"er": er, "ephi": ephi}).withColumn("e", F.sqrt(F.col("er") * F.col("er") + F.col("ephi") * F.col("ephi")))


#: Names of older station files and those of today.
STATION_NAMES = {
    "gm_dBn": "dBnMhd", "gm_dBe": "dBeMhd", "gm_dBd": "dBdMhd", "gm_facdBn": "dBnFac", "gm_facdBe": "dBeFac", "gm_facdBd": "dBdFac", "ie_JhdBn": "dBnHal",
    "ie_JhdBe": "dBeHal", "ie_JhdBd": "dBdHal", "ie_JpBn": "dBnPed", "ie_JpBe": "dBePed", "ie_JpBd": "dBdPed",
}


def station_totals(df: DataFrame) -> DataFrame:
    """Older station tables as today's: ``dBn``, ``dBe`` and ``dBd`` are the sums of their parts, and the parts are renamed."""
    if "dBn" in df.columns:
        return df
    totals = {f"dB{axis}": sum((F.col(c) for c in df.columns if c.endswith(f"B{axis}")), F.lit(0.0)) for axis in "ned"}
    return df.withColumns(totals).withColumnsRenamed(STATION_NAMES)
