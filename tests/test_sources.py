"""Text layouts written here and read back."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tideframe.sources import text as T


def _file(path, *rows):
    path.write_text("\n".join(rows) + "\n")
    return str(path)


def test_json_headed(spark, tmp_path):
    head = {"Time": {"NAME": "IsoDateTime", "START_COLUMN": 0}, "v": {"UNITS": "km", "START_COLUMN": 1}, "b": {"START_COLUMN": 2, "DIMENSION": [3]}, "labels": {"VALUES": ["x", "y", "z"]}}
    path = _file(tmp_path / "a.txt", *("# " + x for x in json.dumps(head, indent=1).splitlines()), "2012-09-01T00:00:00 1.5 1 2 3", "2012-09-01T01:00:00 -2.5e1 4 5 6")
    df = T.read_json_headed(spark, path)
    rows = df.orderBy("Time").collect()
    assert rows[0]["Time"] == dt.datetime(2012, 9, 1) and rows[1]["v"] == -25.0 and rows[1]["b"] == [4.0, 5.0, 6.0]
    assert df.schema["v"].metadata == {"UNITS": "km"}
    assert T.read_json_headed(spark, path, restrict=["b"]).columns == ["b"]
    out = str(tmp_path / "out")
    T.write_json_headed(df.coalesce(1), out, {"b": 3})
    assert sorted(map(str, T.read_json_headed(spark, out, header=T.json_header(spark, out)).select("v", "b").collect())) == sorted(map(str, df.select("v", "b").collect()))


def test_logs(spark, tmp_path):
    path = _file(tmp_path / "log_e20140410-000000.log", "title", "it year mo dy hr mn sc msc rho", " 200 2014 04 10 00 00 00 000 1.2E+001", " *** 2014 04 10 00 00 05 238 1.3E+001", " 300 2014 04")
    rows = T.read_log(spark, path).orderBy("time").collect()
    assert [r["it"] for r in rows] == [200.0, -1.0] and rows[1]["time"] == dt.datetime(2014, 4, 10, 0, 0, 5, 238000) and abs(rows[1]["runtime"] - 5.238) < 1e-9
    plain = _file(tmp_path / "log_n000010.log", "title", "it dt rho", " 10 0.0 12.2", " 24 0.35 12.1")
    assert [tuple(r)[1:] for r in T.read_log(spark, plain).orderBy("it").collect()] == [(10.0, 0.0, 12.2), (24.0, 0.35, 12.1)]
    name = spark.createDataFrame([("x/log_n000010.log",), ("x/z_t01020304_n5.out",), ("y/log_e20140410-000102.log",)], "p string").select(T.file_times(F.col("p")).alias("t")).select("t.*").collect()
    assert name[0]["iteration"] == 10 and name[1]["runtime"] == 102 * 3600 + 3 * 60 + 4 and name[2]["time"] == dt.datetime(2014, 4, 10, 0, 1, 2)


def test_inputs(spark, tmp_path):
    path = _file(tmp_path / "imf.dat", "words", "#TIMEDELAY", "0.0", "", "#START", "2000 1 1 0 0 0 0 1 2 3 -400 0 0 5 100000", "2000 1 1 0 1 0 500 1 2 -3 -400 0 0 5 100000")
    rows = T.read_solar_wind(spark, path).orderBy("time").collect()
    assert len(rows) == 2 and rows[1]["bz"] == -3.0 and rows[1]["time"] == dt.datetime(2000, 1, 1, 0, 1, 0, 500000)
    named = _file(tmp_path / "var.dat", "#VAR", "bz n", "#START", "2000 1 1 0 0 0 0 1 2")
    assert T.read_solar_wind(spark, named).columns == ["path", "time", "bz", "n"]
    orbit = _file(tmp_path / "sat.dat", "head", "#COOR", "SMG", "", "#START", "2000 1 1 0 0 0 0 1 2 3")
    assert tuple(T.read_orbit(spark, orbit).select("x", "y", "z", "system").first()) == (1.0, 2.0, 3.0, "SMG")
    T.write_series(T.read_orbit(spark, orbit).coalesce(1), str(tmp_path / "sat_out"), "time", ["x", "y", "z"], ("#COOR", "GSM", "#START"))
    assert tuple(T.read_orbit(spark, str(tmp_path / "sat_out")).select("z", "system").first()) == (3.0, "GSM")
    mags = _file(tmp_path / "m.mag", "  2 magnetometers: s1  s2 ", "nstep year mo dy hr mn sc msc station X dBn", "5 2000 03 21 10 45 00 000 1 3.8E+06 -1.1", "5 2000 03 21 10 45 00 000 2 1E6 2.5")
    assert {(r["station"], r["dBn"]) for r in T.read_stations(spark, mags).collect()} == {("s1", -1.1), ("s2", 2.5)}


def test_indices(spark, tmp_path):
    day = "DST0403*05RRX020   0" + "".join(f"{-k:4d}" for k in range(24)) + "   0"
    rows = T.read_hourly_index(spark, _file(tmp_path / "dst", day)).orderBy("time").collect()
    assert len(rows) == 24 and rows[5]["value"] == -5.0 and rows[5]["time"] == dt.datetime(2004, 3, 5, 5)
    kp = T.read_three_hourly_index(spark, _file(tmp_path / "kp", "YYYYMMDD", "20040305 1 2+3-4 5 6 7 8 ")).orderBy("time").collect()
    assert [round(r["value"], 3) for r in kp[:3]] == [1.0, 2.333, 2.667] and kp[7]["stop"] == dt.datetime(2004, 3, 6) and kp[0]["time"] == dt.datetime(2004, 3, 5, 1, 30)
    iaga = _file(tmp_path / "iaga", " Format                 IAGA-2002                                    |", "DATE       TIME         DOY     AE        AU   |", "2004-03-05 00:00:00.000 065    111.00    50.5", "2004-03-05 00:01:00.000 065    112.00    51.5")
    assert [(r["doy"], r["ae"], r["au"]) for r in T.read_iaga(spark, iaga).orderBy("time").collect()] == [(65, 111.0, 50.5), (65, 112.0, 51.5)]


def test_flux_epochs_and_files(spark, tmp_path):
    for p in (50, 75):
        _file(tmp_path / f"x_pctile_flux_{p}.txt", "# head", f"2000,1.5,0,0,0,{p}.0,2.0", f"2000,2.5,0,0,0,{p + 2}.0,4.0")
    flux = T.read_flux_table(spark, f"{tmp_path}/x_pctile*.txt", ["year", "doy", "x", "y", "z"], [0.1, 1.0])
    out = T.combine_percentiles(flux).orderBy("energy").collect()
    assert T.combine_percentiles(flux).columns == ["energy", "75", "50"] and tuple(out[0]) == (0.1, 76.0, 51.0)
    assert T.read_epochs(spark, _file(tmp_path / "e", "2001 2 3 4 5 6")).first()[0] == dt.datetime(2001, 2, 3, 4, 5, 6)
    assert T.read_epochs(spark, _file(tmp_path / "i", "2001-02-03T04:05:06"), iso=True).first()[0] == dt.datetime(2001, 2, 3, 4, 5, 6)
    (tmp_path / "tree" / "2001").mkdir(parents=True)
    for n in ("a_20010203.txt", "a_20010204.txt", "b.txt"):
        _file(tmp_path / "tree" / "2001" / n, "x")
    assert T.matching_files(spark, str(tmp_path / "tree"), r"%Y/a_%Y%m%d\.txt").count() == 2
    assert T.matching_files(spark, str(tmp_path / "tree"), r"%Y/a_%Y%m%d\.txt", dt.datetime(2001, 2, 4)).count() == 1


def test_names(spark):
    from tideframe.functions.timescales import date_in_name

    rows = spark.createDataFrame([("d/x_20120930_v1.cdf",), ("d/20129999.txt",), ("20120930/none.txt",)], "p string").select(date_in_name(F.col("p"))).collect()
    assert [r[0] for r in rows] == [dt.date(2012, 9, 30), None, None]


@pytest.mark.parametrize("kind", ["window", "refractory", "gap", "session", "distinct"])
def test_streams(spark, tmp_path, kind):
    from tideframe.streaming import windows as W

    rows = [(k % 2, dt.datetime(2024, 1, 1, 0, k), float(k)) for k in (0, 1, 2, 3, 4, 5, 20, 21, 50, 51)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "k int, ts timestamp, v double").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("k int, ts timestamp, v double").parquet(src)
    out = {
        "window": lambda: W.window_mean_stream(stream, "ts", "v", "10 minutes", "10 minutes", "1 minute", ("k",)),
        "refractory": lambda: W.refractory_stream(stream, "ts", "k", 180_000_000, "1 minute"),
        "gap": lambda: W.gap_stream(stream, "ts", "k", 600_000_000, "1 minute"),
        "session": lambda: W.session_stream(stream, "ts", "5 minutes", "1 minute", ("k",)),
        "distinct": lambda: W.distinct_stream(stream, "ts", "1 hour", ("k",)),
    }[kind]()
    q = out.writeStream.format("memory").queryName(f"q_{kind}").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table(f"q_{kind}").collect()
    if kind == "window":
        assert {(r["k"], r["start"].minute, r["value"]) for r in got} == {(0, 0, 2.0), (1, 0, 3.0), (0, 20, 20.0), (1, 20, 21.0)}
    elif kind == "refractory":
        assert sorted((r["k"], r["time"].minute) for r in got) == [(0, 0), (0, 4), (0, 20), (0, 50), (1, 1), (1, 5), (1, 21), (1, 51)]
    elif kind == "gap":
        assert sorted((r["k"], r["middle"].minute) for r in got) == [(0, 12), (0, 35), (1, 13), (1, 36)]
    elif kind == "session":
        assert {(r["k"], r["n"]) for r in got} == {(0, 3), (1, 3), (0, 1), (1, 1)}
    else:
        assert len(got) == 2
