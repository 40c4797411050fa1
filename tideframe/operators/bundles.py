"""Reductions of one array dimension with fill values and uncertainties, slices, and integrals over sampled angles.

All are column expressions over arrays. An element is valid if it is neither null nor a fill value and within its limits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideframe.operators.rules import replace_invalid


def valid_only(values: Column, fill: float | None = None, low: float | None = None, high: float | None = None) -> Column:
    """The array with null for each invalid element."""
    return F.transform(values, lambda x: replace_invalid(x.cast("double"), fill, low, high))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def _count(values: Column) -> Column:
    return F.size(F.filter(values, lambda x: x.isNotNull()))


def total(values: Column) -> Column:
    """Sum over the dimension; null if an element is."""
    return F.when(_count(values) == F.size(values), _sum(values))


def mean(values: Column) -> Column:
    """Mean of the elements that are not null; null if all are."""
    return F.try_divide(_sum(values), _count(values))


def total_uncertainty(sigmas: Column) -> Column:
    """Uncertainty of a sum: in quadrature; null if an element is."""
    return F.sqrt(total(F.transform(sigmas, lambda x: x * x)))


def mean_uncertainty(sigmas: Column) -> Column:
    return F.try_divide(F.sqrt(_sum(F.transform(sigmas, lambda x: x * x))), _count(sigmas))


def sliced(values: Column, start: int = 0, stop: int | None = None, step: int = 1) -> Column:
    """Elements start, start + step ... before ``stop``; negative bounds count from the end, ``step`` is positive."""
    n = F.size(values)
    at = lambda k: F.lit(k) if k >= 0 else n + k
    low = F.greatest(at(start), F.lit(0))
    high = F.least(at(stop), n) if stop is not None else n
    return F.filter(values, lambda x, i: (i >= low) & (i < high) & ((i - low) % step == 0))


def simpson(y: Column, x: Column) -> Column:
    """Simpson's rule over unevenly spaced points; the last interval of an even number of points by a parabola through three."""
    n = F.size(y)
    at = lambda a, k: F.get(a, k)

    def piece(k: Column) -> Column:
        h0, h1 = at(x, k + 1) - at(x, k), at(x, k + 2) - at(x, k + 1)
        s = h0 + h1
        return s / 6.0 * (at(y, k) * (2.0 - h1 / h0) + at(y, k + 1) * (s * s / (h0 * h1)) + at(y, k + 2) * (2.0 - h0 / h1))

    whole = F.aggregate(F.transform(F.sequence(F.lit(0), F.floor((n - 3) / 2).cast("int")), lambda i: piece(2 * i)), F.lit(0.0), lambda a, v: a + v)
    h0, h1 = at(x, n - 2) - at(x, n - 3), at(x, n - 1) - at(x, n - 2)
    rest = at(y, n - 1) * (2 * h1 * h1 + 3 * h0 * h1) / (6 * (h0 + h1)) + at(y, n - 2) * (h1 * h1 + 3 * h0 * h1) / (6 * h0) - at(y, n - 3) * h1 * h1 * h1 / (6 * h0 * (h0 + h1))
    pair = (at(x, F.lit(1)) - at(x, F.lit(0))) * (at(y, F.lit(0)) + at(y, F.lit(1))) / 2
    return F.when(n < 2, 0.0).when(n == 2, pair).otherwise(whole + F.when(n % 2 == 0, rest).otherwise(0.0))


def omni_flux(flux: Column, angles: Column, mean_direction: bool = True) -> Column:
    """Directional flux at pitch angles in degrees to the omnidirectional one: per steradian, or over the sphere.

    One angle alone is taken as isotropic and stays.
    """
    rad = F.transform(angles, F.radians)
    inner = simpson(F.zip_with(flux, rad, lambda j, a: j * F.sin(a)), rad)
    return F.when(F.size(flux) == 1, F.get(flux, F.lit(0))).otherwise(inner * (0.5 if mean_direction else 2 * math.pi))


def array_bins(values: Column, edges: list[float]) -> Column:
    """0-based indices of a rising array, cut before the first value that reaches each edge."""
    n = F.size(values)
    cut = [F.coalesce(F.get(F.filter(F.transform(values, lambda x, i: F.when(x >= e, i)), lambda i: i.isNotNull()), F.lit(0)), n) for e in edges]
    places = F.sequence(F.lit(0), n - 1)
    parts = [F.slice(places, a + 1, F.greatest(b - a, F.lit(0))) for a, b in zip([F.lit(0), *cut], [*cut, n], strict=True)]
    return F.when(n > 0, F.array(*parts)).otherwise(F.array(*(F.slice(F.array().cast("array<int>"), 1, 0) for _ in parts)))


def placed(first: Column, second: Column, index: Column) -> Column:
    """Elements of ``first`` at the places ``index`` of the result, those of ``second`` at the others, in order."""
    every = F.transform(F.sequence(F.lit(0), F.size(first) + F.size(second) - 1), lambda i: i)
    order = F.concat(index, F.array_except(every, index))
    pairs = F.zip_with(order, F.concat(first, second), lambda i, v: F.struct(i.alias("i"), v.alias("v")))
    return F.transform(F.array_sort(pairs), lambda s: s["v"])
