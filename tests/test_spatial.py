"""Spatial operators against plain versions on skewed, repeated, missing and empty points."""

import numpy as np
import pytest

from tideframe.operators import spatial as P


def points_of(spark, rows):
    return spark.createDataFrame([(k, float(x) if x is not None else None, float(y) if y is not None else None) for k, (x, y) in enumerate(rows)], "pid long, x double, y double")


def skewed(n=3000, seed=3):
    """A third at one place, a third in a tiny cluster, the rest spread out; two far away."""
    rng = np.random.default_rng(seed)
    rows = [(5.0, 5.0)] * (n // 3) + [tuple(p) for p in 40 + rng.normal(0, 1e-4, (n // 3, 2))] + [tuple(p) for p in rng.uniform(0, 100, (n // 3, 2))]
    return rows + [(1e4, 0.0), (0.0, 1e4)]


def brute_leaves(rows, limit, most):
    xy = np.array(rows)
    x0, y0 = xy.min(0)
    size = max(xy.max(0) - xy.min(0)) * (1 + 1e-9) or 1.0
    fine = np.floor((xy - (x0, y0)) / size * 2**26).astype(int)
    out = {}

    def grow(level, ix, iy, mine):
        if len(mine) <= limit or level == most:
            out[level, ix, iy] = len(mine)
            return
        at = mine >> (26 - level - 1)
        for a in (2 * ix, 2 * ix + 1):
            for b in (2 * iy, 2 * iy + 1):
                grow(level + 1, a, b, mine[(at[:, 0] == a) & (at[:, 1] == b)])

    grow(0, 0, 0, fine)
    return out


def brute_nearest(queries, rows, k):
    out = {}
    for q, (x, y) in enumerate(queries):
        d = sorted(((px - x) * (px - x) + (py - y) * (py - y), pid) for pid, (px, py) in enumerate(rows))
        out[q] = [(r + 1, pid) for r, (_, pid) in enumerate(d[:k])]
    return out


def nearest(spark, queries, points, k, **more):
    asked = points_of(spark, queries).withColumnRenamed("pid", "id")
    out = {}
    for r in sorted(P.nearest_points(asked, points, k, **more).collect(), key=lambda r: r["rank"]):
        out.setdefault(r["id"], []).append((r["rank"], r["pid"]))
    return out


def test_tree_of_skewed_points(spark):
    rows = skewed()
    df = points_of(spark, rows)
    tree = P.adaptive_tree(df, 50, 18)
    want = brute_leaves(rows, 50, 18)
    assert {(r["level"], r["ix"], r["iy"]): r["n"] for r in tree.leaves().collect()} == want
    assert sum(want.values()) == len(rows) and all(n <= 50 or level == 18 for (level, _, _), n in want.items())
    found = {}
    for r in P.locate(df, tree).collect():
        key = (r["leaf"]["level"], r["leaf"]["ix"], r["leaf"]["iy"])
        found[key] = found.get(key, 0) + 1
    assert found == {k: n for k, n in want.items() if n}


def test_lookups_anywhere(spark):
    """Empty places have leaves too, places outside of the box have none."""
    tree = P.adaptive_tree(points_of(spark, [(0, 0)] * 9 + [(8, 8), (7, 7), (1, 7)]), 4, 6)
    boxes = {(r["level"], r["ix"], r["iy"]): r for r in tree.leaves().collect()}
    assert sum(4.0 ** -r["level"] for r in boxes.values()) == 1
    rng = np.random.default_rng(1)
    for r in P.locate(points_of(spark, rng.uniform(-1, 9, (200, 2))), tree).collect():
        inside = 0 <= r["x"] < tree.size and 0 <= r["y"] < tree.size
        assert (r["leaf"] is not None) == inside
        if inside:
            b = boxes[tuple(r["leaf"])]
            assert b["x0"] <= r["x"] < b["x1"] and b["y0"] <= r["y"] < b["y1"]


@pytest.mark.parametrize("k", [1, 4, 30])
def test_nearest_of_skewed_points(spark, k):
    rows = skewed(900)
    rng = np.random.default_rng(2)
    queries = [tuple(q) for q in rng.uniform(-20, 120, (60, 2))] + [(5, 5), (40, 40), (41, 40), (5000, 5000), (-1e5, 0)] + rows[::97]
    assert nearest(spark, queries, points_of(spark, rows), k, limit=16) == brute_nearest(queries, rows, k)


def test_few_missing_and_no_points(spark):
    rows = [(0, 0), (3, 4), (None, 1), (float("nan"), 2), (2, float("inf"))]
    asked = [(0, 1), (None, 0)]
    assert nearest(spark, asked, points_of(spark, rows), 5) == {0: [(1, 0), (2, 1)]}
    none = points_of(spark, rows).limit(0)
    assert nearest(spark, asked, none, 3) == {}
    assert [tuple(r) for r in P.adaptive_tree(none, 5).leaves().collect()] == [(0, 0, 0, 0, 0.0, 1.0, 0.0, 1.0)]
    assert P.locate(none, P.adaptive_tree(none, 5)).count() == 0 and P.regrid(none, ("pid",), 1.0).count() == 0


def test_no_cross_join_and_no_python(spark):
    """The plan joins by equality alone, in the JVM."""
    rows = points_of(spark, skewed(300))
    plan = P.nearest_points(rows.withColumnRenamed("pid", "id"), rows, 3, limit=16)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan and "Arrow" not in plan


def test_regrid_keeps_cells_and_planes(spark):
    """Knots at the cells keep their values; a constant stays; nulls give way to the other neighbours."""
    rows = [(i, j) for i in range(6) for j in range(5)]
    df = spark.createDataFrame([(k, float(x), float(y), 2.0 * x - y if (x, y) != (3, 3) else None, 7.0) for k, (x, y) in enumerate(rows)], "pid long, x double, y double, v double, c double")
    got = {(r["x"], r["y"]): r for r in P.regrid(df, ("v", "c"), 0.5, 4).collect()}
    assert set(got) == {(i / 2, j / 2) for i in range(11) for j in range(9)} and all(r["c"] == pytest.approx(7) for r in got.values())
    assert all(got[x, y]["v"] == (2.0 * x - y if (x, y) != (3, 3) else None) for x, y in rows)
    assert got[0.5, 0.5]["v"] == pytest.approx(0.5)


def test_track_in_blocks(spark):
    """A field linear in place and time is met exactly, in blocks of two resolutions; nulls outside of the frames' times."""
    import datetime as dt

    from pyspark.sql import functions as F

    start = dt.datetime(2024, 1, 1)
    frames = []
    for m in range(4):
        for b, (x0, h) in {0: (0.0, 1.0), 1: (10.0, 0.25)}.items():
            frames += [(start + dt.timedelta(minutes=10 * m), b, i, j, 3 * (x0 + i * h) - 2 * j * h + 60 * m) for i in range(8) for j in range(8) if (m, b, i, j) != (3, 0, 7, 7)]
    frames = spark.createDataFrame(frames, "ts timestamp, b int, i int, j int, v double")
    rng = np.random.default_rng(0)
    rows = [(k, start + dt.timedelta(seconds=int(rng.integers(-60, 1900))), int(b), float(x + (10 if b else 0)), float(y)) for k, (b, x, y) in enumerate(zip(rng.integers(0, 2, 80), rng.uniform(0, 1.7, 80), rng.uniform(0, 1.7, 80)))]
    rows += [(100, start, 0, 1.0, 1.0), (101, start + dt.timedelta(minutes=30), 0, 1.0, 1.0), (102, start + dt.timedelta(minutes=29), 0, 6.5, 6.5), (103, None, 0, 1.0, 1.0), (104, start, 7, 1.0, 1.0)]
    track = spark.createDataFrame(rows, "id long, ts timestamp, b int, x double, y double")
    fine = F.col("b") == 1
    gx = (F.when(fine, 10.0).otherwise(0.0), F.when(fine, 0.25).otherwise(1.0), F.lit(8))
    gy = (F.lit(0.0), F.when(fine, 0.25).otherwise(1.0), F.lit(8))
    got = {r["id"]: r["v"] for r in P.along_track(track, frames, ("v",), gx, gy, 600_000_000, ("b",)).collect()}
    assert len(got) == len(rows)
    for k, ts, b, x, y in rows:
        late = None if ts is None else (ts - start).total_seconds()
        if late is None or not 0 <= late <= 1800 or k in (102, 104):
            assert got[k] is None
        else:
            assert got[k] == pytest.approx(3 * x - 2 * y + late / 10)
