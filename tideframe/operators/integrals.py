"""Cumulative integrals of functions given by their values, and where they reach given amounts.

A function is a table of (x, f) for each key; between neighbouring points it is linear. Its points are cut into buckets of
x: areas are added within buckets and shifted by the buckets before, so a long function of one key is many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.operators.series import carried, previous
from tideframe.storage import small


def cumulative(table: DataFrame, width: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """``table`` (keys, x, f) with ``before`` (x, f) of the point before, ``area`` up to each point and the ``total`` of its key.

    ``width`` is that of a bucket of x. Points without x or f are left out; of several at one x the one of smallest f counts.
    """
    clean = table.where(F.col("x").isNotNull() & F.col("f").isNotNull() & ~F.isnan("x") & ~F.isnan("f"))
    points = clean.groupBy(*keys, F.col("x").cast("double").alias("x")).agg(F.min(F.col("f").cast("double")).alias("f")).withColumn("_point", F.struct("x", "f"))
    bucket = F.floor(F.col("x") / width)
    rows = previous(points, "_point", ["x"], keys, bucket, "before").withColumn("_bucket", bucket)
    step = (F.col("x") - F.col("before.x")) * (F.col("f") + F.col("before.f")) / 2
    rows = rows.drop("_point").withColumn("_step", F.coalesce(step, F.lit(0.0)))
    inner = F.sum("_step").over(Window.partitionBy(*keys, "_bucket").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum("_step").alias("_sum"))
    whose = Window.partitionBy(*keys)  # a row for each bucket
    back = whose.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(back), F.lit(0.0)).alias("_back"), F.sum("_sum").over(whose).alias("total"))
    rows = rows.withColumn("_inner", inner).join(sums, [*keys, "_bucket"])
    return rows.withColumn("area", F.col("_back") + F.col("_inner")).drop("_bucket", "_step", "_inner", "_back")


def _reached(low: Column, high: Column, rest: Column) -> Column:
    """Where within a step the area ``rest`` is reached; ``low`` and ``high`` are (x, f) of its ends."""
    h, f0, rise = high["x"] - low["x"], low["f"], (high["f"] - low["f"]) / (high["x"] - low["x"])
    root = F.sqrt(F.greatest(f0 * f0 + 2 * rise * rest, F.lit(0.0)))
    at = F.when(f0 + root > 0, 2 * rest / (f0 + root)).otherwise(0.0)  # also right where the step is level
    return low["x"] + F.least(F.greatest(at, F.lit(0.0)), h)


def inverse_integral(table: DataFrame, targets: DataFrame, width: float, keys: tuple[str, ...] = (), parts: int = 1000) -> DataFrame:
    """``targets`` (keys, target, ...) with ``x``, up to which the integral of the key's function is ``target``.

    The function has to be non-negative. Of all places with one integral the first counts; 0 is reached at the first point;
    targets below 0 or above the whole integral have null. Points and targets are met in ``parts`` buckets of the integral.
    """
    if not keys:
        one = F.lit(0).alias("_all")
        return inverse_integral(table.select("x", "f", one), targets.select("*", one), width, ("_all",), parts).drop("_all")
    points = cumulative(table, width, keys)
    totals = points.select(*keys, "total").distinct()
    here = F.struct(F.struct("x", "f").alias("high"), F.col("before").alias("low"), (F.col("area") - F.coalesce((F.col("x") - F.col("before.x")) * (F.col("f") + F.col("before.f")) / 2, F.lit(0.0))).alias("from"))
    knots = points.groupBy(*keys, "area", "total").agg(F.min(here).alias("_knot"))  # level pieces of the integral end where they begin
    asked = targets.join(small(totals, 64), list(keys))
    asked = asked.where((F.col("target") >= 0) & (F.col("target") <= F.col("total"))).withColumn("area", F.col("target").cast("double")).withColumn("_knot", F.lit(None).cast(knots.schema["_knot"].dataType))
    asked = asked.withColumn("_asked", F.lit(True))
    rows = asked.unionByName(knots.withColumn("_asked", F.lit(False)), allowMissingColumns=True)
    bucket = F.when(F.col("total") > 0, F.floor(F.col("area") / F.col("total") * parts)).otherwise(0)
    rows = carried(rows, keys, "area", {"_end": F.col("_knot")}, bucket, ahead=True).where("_asked")
    found = F.when(F.col("_end.low").isNull(), F.col("_end.high.x")).otherwise(_reached(F.col("_end.low"), F.col("_end.high"), F.col("area") - F.col("_end.from")))
    rows = rows.select(*targets.columns, found.alias("x"))
    outside = targets.join(small(totals, 64), list(keys), "left").where(F.col("total").isNull() | F.col("target").isNull() | F.isnan("target") | (F.col("target") < 0) | (F.col("target") > F.col("total")))
    return rows.unionByName(outside.select(*targets.columns, F.lit(None).cast("double").alias("x")))


def representative_values(table: DataFrame, n: int, width: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, i, x): ``n`` values that are spread as the density ``table`` (keys, x, f) is, which need not be normalised.

    The i-th is where (i + 1/2) of ``n`` equal parts of the integral lie below. A density that is 0 everywhere gives nulls.
    """
    totals = cumulative(table, width, keys).groupBy(*keys).agg(F.max("total").alias("_total")).where(F.col("_total").isNotNull())
    i = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")
    targets = totals.select(*keys, i, "_total").select(*keys, "i", F.when(F.col("_total") > 0, (F.col("i") + 0.5) * F.col("_total") / n).alias("target"))
    return inverse_integral(table, targets, width, keys).select(*keys, "i", "x")
