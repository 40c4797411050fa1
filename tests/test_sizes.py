"""Steps that must grow no faster than their input, and last digits that must be those of the SQL: plans and small odd inputs."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe.functions import frames


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def at_times(spark, seconds):
    start = dt.datetime(2024, 3, 1)
    return spark.createDataFrame([(i, None if s is None else start + dt.timedelta(seconds=s), 1.0 + i, -2.0, 0.5) for i, s in enumerate(seconds)], "i long, ts timestamp_ntz, x double, y double, z double")


def test_matrices_beside_their_rows(spark):
    """Many frames of many distinct times: nothing is joined, shuffled or broadcast; null times give null positions."""
    df = at_times(spark, [0, 5, None, 5, 86400, None])
    out = df
    for a, b in (("GEO", "GSM"), ("GSM", "J2000"), ("J2000", "GEO")):
        out = frames.convert(out, "ts", ("x", "y", "z"), a, b)
    assert not any(word in plan_of(out) for word in ("Join", "Exchange"))
    got = {r["i"]: (r["x"], r["y"], r["z"]) for r in out.collect()}
    assert got[2] == got[5] == (None, None, None)
    for i in (0, 1, 3, 4):
        assert got[i] == pytest.approx((1.0 + i, -2.0, 0.5))
    tilt = at_times(spark, [None, 0]).select(frames.turning(F.unix_micros(F.col("ts").cast("timestamp")), "GEO", "GSM")["tilt"].alias("t")).collect()
    assert tilt[0]["t"] is None and np.isfinite(tilt[1]["t"])


@pytest.mark.parametrize("name", ["frames_and_back", "geocentric_in_all_frames", "dipole_tilts"])
def test_frame_queries_move_no_rows(spark, data, name):
    """Neither the rows nor the matrices of their times are shuffled, joined or broadcast, however many times there are."""
    import __spark_entry__

    plan = plan_of(__spark_entry__.queries()[name](spark, f"{data}/sf0.001"))
    assert "Scan parquet" in plan and not any(word in plan for word in ("Join", "Exchange"))


def test_orientation_is_not_broadcast(spark):
    """With a table of the Earth's orientation the matrices come by a join that shuffles."""
    df = at_times(spark, [0, 60, None])
    known = at_times(spark, [0, 86400]).select("ts", *(F.lit(0.0).alias(c) for c in frames.ORIENTATION))
    out = frames.convert(df, "ts", ("x", "y", "z"), "GEO", "J2000", orientation=known)
    assert "SortMergeJoin" in plan_of(out)
    plain = {r["i"]: r["x"] for r in frames.convert(df, "ts", ("x", "y", "z"), "GEO", "J2000").collect()}
    assert {r["i"]: r["x"] for r in out.collect()} == pytest.approx(plain)


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first()


def duck(text):
    import duckdb

    return duckdb.sql(f"select {text}").fetchall()[0]


def lit(x):
    return F.when(F.col("id") >= 0, F.lit(x))


def test_tails_of_the_magnetopause(spark):
    """Far tails hang on the last digit of the angle: the same operations as the SQL, so that the cosine is the same."""
    from tideframe.functions import empirical as E

    for lt in range(6, 19):
        got = one(spark, F.cos((12 - lit(lt)) * F.lit(np.pi) / 12), E.magnetopause(lit(-3.0), lit(20000.5), lit(lt))[0])
        cos, x = duck(f"cos((12 - {lt}) * pi() / 12), (11.4 + 0.140 * -3.0::double) * pow(20000.5::double, -1 / 6.6) * pow(2 / (1 + cos((12 - {lt}) * pi() / 12)), (0.58 - 0.01 * -3.0::double) * (1 + 0.01 * 20000.5::double)) * cos((12 - {lt}) * pi() / 12)")
        assert got["c0"] == cos
        assert got["c1"] == pytest.approx(x, rel=1e-13), lt


def test_rounding_of_the_sql(spark):
    """Ties and large numbers are rounded by scaling, as the SQL does; what is no number stays."""
    from tideframe.plans.registry import rounded

    for x, n in ((1.005, 2), (2.675, 2), (554533537942341.5, 5), (-0.285, 2), (62588443.51785, 4), (1e305, 5), (53.45, 1)):
        assert one(spark, rounded(lit(x), n))[0] == duck(f"round({x!r}::double, {n})")[0]
    got = one(spark, rounded(lit(float("inf")), 3), rounded(lit(float("nan")), 3), rounded(F.lit(None).cast("double"), 3))
    assert got[0] == float("inf") and got[1] != got[1] and got[2] is None


def table_of(tmp_path, rows):
    import duckdb

    values = ", ".join(f"({i}, timestamp '{ts}', {u}, '{kind}', {v}::double)" for i, ts, u, kind, v in rows)
    duckdb.sql(f"copy (select * from (values {values}) t(event_id, ts, user_id, event_type, value)) to '{tmp_path}/events.parquet' (format parquet)")
    return str(tmp_path)


def differs(spark, name, folder):
    import __spark_entry__
    from tests.oracle import difference, duck

    return difference(spark, duck(folder), __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name], folder)


def test_latitudes_beyond_the_pole(spark, tmp_path):
    """Values over 502.8 count the latitude past the pole."""
    rows = [(i, "2024-01-01 00:00:01", u, "click", v) for i, (u, v) in enumerate((u, v) for u in (0, 7, 25, 36, 180) for v in (0.0, 250.0, 503.0, 520.09, 560.21))]
    assert differs(spark, "geodetic_positions", table_of(tmp_path, rows)) == ""


def test_flux_of_huge_densities(spark):
    """The scale goes to the density first, so that what overflows is what overflows in the SQL."""
    from tideframe.functions.plasma import number_flux

    for n, u in ((1e306, 0.01), (1e300, 1.0), (9.12e12, 30.7)):
        assert one(spark, number_flux(lit(n), lit(u)))[0] == duck(f"1000 * {n!r}::double * {u}::double")[0]


@pytest.mark.parametrize("pair", [(0.15, 0.35), (1.25, 1.25), (2.0, 2.3), (0.05, 106.85), (77.7, 77.8)])
def test_means_at_ties(spark, tmp_path, pair):
    """Means of a minute that lie between two tenths."""
    rows = [(i, "2024-01-01 00:00:01", 1, kind, v + k) for i, (k, kind, v) in enumerate((k, kind, v) for k, kind in enumerate(("a", "b", "c", "d", "e")) for v in pair)]
    assert differs(spark, "layout_index_blocks", table_of(tmp_path, rows)) == ""


def test_derived_digits(spark, tmp_path):
    rows = [(i, "2024-01-01 00:00:01", i * 7 % 1500 + (10**6 if i % 5 == 0 else 0), "click", round(i * 37.31 % 560, 2)) for i in range(3000)]
    assert differs(spark, "all_derived", table_of(tmp_path, rows)) == ""


def test_interval_max_makes_no_pairs(spark):
    """A thousand values and ten queries in one window, ends included, against a plain version; one join, that of the keys."""
    from tideframe.operators import matching as M

    start = dt.datetime(2024, 3, 1)
    series = [(start + dt.timedelta(seconds=s % 400), float(s * 37 % 101)) for s in range(1000)]
    asked = [(i, start + dt.timedelta(seconds=s)) for i, s in enumerate((0, 5, 59, 60, 61, 120, 399, 459, 460, 5000))] + [(99, None)]
    q, s = spark.createDataFrame(asked, "i long, ts timestamp_ntz"), spark.createDataFrame(series, "ts timestamp_ntz, v double")
    for prior in (60, 7, 0):
        out = M.interval_max(q, s, "ts", "v", prior * 1_000_000, "i")
        assert plan_of(out).split("== Initial")[0].count("Join ") == 1
        want = {i: None if t is None else max((v for u, v in series if t - dt.timedelta(seconds=prior) <= u <= t), default=None) for i, t in asked}
        assert {r["i"]: r["v"] for r in out.collect()} == want


def test_diffusion_side_by_side(spark):
    """Runs of two grids and of unlike series in a batch, each as when it is alone; no group for each run."""
    from tideframe.operators import iterative as I

    grids = {r: np.linspace(3, 6, 7 if r % 2 else 13) for r in range(6)}
    kps = {r: [1.0 + r, 2.0][: 1 + r % 3 // 2] for r in range(6)}
    runs = spark.createDataFrame([(r, float(x), float(r + x * x)) for r, g in grids.items() for x in g], "run long, l double, psd double")
    kp = spark.createDataFrame([(r, j, k) for r, ks in kps.items() for j, k in enumerate(ks)], "run long, step int, kp double")
    out = I.radial_diffusion(runs, kp, 0.05)
    assert "InPandas" in plan_of(out) and "FlatMapGroups" not in plan_of(out)
    got = {(r["run"], r["step"], r["l"]): r["psd"] for r in out.collect()}
    for r, g in grids.items():
        f = r + g * g
        for j, k in enumerate(kps[r]):
            f = I.diffuse(f, g, 10 ** (0.506 * k - 9.325) * g**10, 0.05)
            assert [got.pop((r, j, x)) for x in g] == f.tolist()
    assert not got


@pytest.mark.parametrize("split", ["128m", "97b"])
def test_lines_numbered_in_splits(spark, tmp_path, split):
    """Lines of files read in many splits have the numbers of the whole file, empty lines counted; no file is read whole."""
    from tideframe.sources.text import numbered

    texts = {"a.txt": "\n".join(f"line {k}" if k % 7 else "" for k in range(300)) + "\n", "b.txt": "one\r\n\r\nthree"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        out = numbered(spark, str(tmp_path))
        assert "wholetext" not in plan_of(out).lower() and "Generate" not in plan_of(out)
        got = {(r["path"].rsplit("/", 1)[1], r["n"]): r["value"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert got == {(name, n): line for name, text in texts.items() for n, line in enumerate(text.replace("\r\n", "\n").split("\n")) if line}


def test_small_slices_go_together(spark, tmp_path):
    """Fifty slices of four points are one partition, with the rows of the slices."""
    from tideframe.sources import records as B

    rows = spark.range(200).select(F.lit("one").alias("file"), F.lit(3).alias("frame"), F.col("id").alias("point"), F.col("id").cast("double").alias("x"))
    paths = [r["path"] for r in B.write_record_frames(rows, str(tmp_path), "file", "frame", "point", ["x"], []).collect()]
    back = B.read_record_frames(spark, paths, ["x"], points=4)
    assert back.rdd.getNumPartitions() == 1
    assert sorted((r["point"], r["x"]) for r in back.collect()) == [(i, float(i)) for i in range(200)]


def test_parameters_of_many_users(spark, tmp_path):
    """Events without a value are listed too, and the files are rows of a table."""
    rows = [(i, f"2024-01-01 00:00:{i:02d}", i % 3, "click", "null" if i % 5 == 0 else i / 4) for i in range(30)]
    assert differs(spark, "layout_parameters", table_of(tmp_path, rows)) == ""
