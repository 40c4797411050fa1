"""Inverse integrals against the plain rule, on uneven, level, empty and single tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe.operators import integrals as N


def test_parabola_and_level_pieces(spark):
    """Known places: f = x has the integral x**2 / 2; where f is 0 the first place counts."""
    rows = [("line", float(x), float(x)) for x in range(11)] + [("gap", x, f) for x, f in ((0.0, 1.0), (1.0, 1.0), (1.5, 0.0), (4.0, 0.0), (4.5, 2.0), (6.0, 2.0))]
    rows += [("line", None, 3.0), ("line", 4.5, None), ("line", 3.0, 99.0), ("one", 7.0, 5.0), ("zero", 0.0, 0.0), ("zero", 9.0, 0.0)]
    table = spark.createDataFrame(rows, "k string, x double, f double")
    asked = [("line", 0.0, 0.0), ("line", 50.0, 10.0), ("line", 12.5, 5.0), ("line", 2.0, 2.0), ("line", 50.1, None), ("line", -1.0, None), ("line", None, None), ("gap", 1.25, 1.5), ("gap", 1.0, 1.0), ("gap", 1.5, 4.353553390593274), ("gap", 2.75, 5.0), ("one", 0.0, 7.0), ("one", 1.0, None), ("zero", 0.0, 0.0), ("none", 1.0, None)]
    targets = spark.createDataFrame([(k, t, j) for j, (k, t, _) in enumerate(asked)], "k string, target double, j int")
    for width, parts in ((1.0, 1000), (100.0, 3), (0.3, 1)):
        got = {r["j"]: r["x"] for r in N.inverse_integral(table, targets, width, ("k",), parts).collect()}
        assert len(got) == len(asked)
        for j, (_, _, x) in enumerate(asked):
            assert got[j] == (None if x is None else pytest.approx(x, abs=1e-9)), asked[j]


def test_normal_density(spark):
    """Values spread as a normal density, as its inverse distribution has them; one function without keys."""
    from statistics import NormalDist

    table = spark.range(4001).select((F.col("id") / 200 - 10).alias("x")).withColumn("f", F.exp(-F.col("x") * F.col("x") / 2))
    got = [r["x"] for r in N.representative_values(table, 200, 0.5).orderBy("i").collect()]
    assert np.allclose(got, [NormalDist().inv_cdf((i + 0.5) / 200) for i in range(200)], atol=1e-4)
    assert N.representative_values(table.limit(0), 10, 1.0).count() == 0
    flat = [r["x"] for r in N.representative_values(table.select("x", F.lit(0.0).alias("f")), 3, 1.0).collect()]
    assert flat == [None] * 3


def test_areas_over_many_buckets(spark):
    table = spark.range(100).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("x"), F.lit(1.0).alias("f"))
    rows = N.cumulative(table, 10.0, ("k",))
    assert [r["area"] for r in rows.orderBy("x").collect()] == [float(k) for k in range(100)]
